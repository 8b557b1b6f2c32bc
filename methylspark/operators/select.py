"""Choice of the best strand among candidate alignments, runner-up scores, mapping quality, metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from methylspark.functions.seq import has_flag, mapq_sql

LOW = -(1 << 30)


def first_alignment(candidates: DataFrame) -> DataFrame:
    """The first alignment of each read, mate and strand (smallest ``rank``)."""
    w = Window.partitionBy("read_id", "mate", "src_strand").orderBy("rank")
    return candidates.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def best_single(candidates: DataFrame, mode: str = "end") -> DataFrame:
    """read_id, src_strand (null: unmapped), as_score, xs_score, mapq from the strands' candidates.

    The strictly greatest score wins; a tie or none leaves the read unmapped. The runner-up is the greatest
    of the winner's own second score and the other strands' scores, null below score_min. Quality is the
    smaller of the recalculated and the aligner's own.
    """
    score = F.when(F.col("flag").bitwiseAND(F.lit(4)) == 0, F.col("as_score"))
    c = candidates.withColumn("_s", score)
    order = F.struct(F.coalesce("_s", F.lit(LOW)).alias("s"), "src_strand", F.coalesce("xs_score", F.lit(LOW)).alias("xs"), "score_min", "mapq")
    g = c.groupBy("read_id").agg(F.array_sort(F.collect_list(order), lambda a, b: F.when(a["s"] > b["s"], -1).when(a["s"] < b["s"], 1).when(a["src_strand"] < b["src_strand"], -1).otherwise(1)).alias("o"))
    top, second = F.col("o")[0], F.get(F.col("o"), F.lit(1))
    runner = F.greatest(top["xs"], F.coalesce(second["s"], F.lit(LOW)))
    unique = (top["s"] > LOW) & (top["s"] > F.coalesce(second["s"], F.lit(LOW)))
    g = g.select("read_id", unique.alias("won"), top["src_strand"].alias("st"), top["s"].alias("s"), runner.alias("xs"), top["score_min"].alias("least"), top["mapq"].alias("q"))
    quality = F.least(F.expr(mapq_sql("s", "xs", "least", mode)), F.col("q"))
    won = F.col("won")
    return g.select("read_id", F.when(won, F.col("st")).alias("src_strand"), F.when(won, F.col("s")).alias("as_score"), F.when(won & (F.col("xs") >= F.col("least")), F.col("xs")).alias("xs_score"), F.when(won, quality).otherwise(0).alias("mapq"))


def best_paired(candidates: DataFrame) -> DataFrame:
    """read_id, tier, strand1, strand2 from candidates of both mates.

    Tier 1: proper pairs by score sum. Tier 2: both mates mapped on one strand. Tier 3: each mate by itself.
    A tie inside the lowest tier present leaves the pair, or the mate, without a winner.
    """
    mapped = F.col("flag").bitwiseAND(F.lit(4)) == 0
    pick = lambda m, c: F.max(F.when((F.col("mate") == m) & mapped, c))
    s = candidates.groupBy("read_id", "src_strand").agg(pick(1, F.col("as_score")).alias("a"), pick(2, F.col("as_score")).alias("b"), F.max(F.when(mapped, F.col("flag").bitwiseAND(F.lit(2)))).alias("p"))
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    s = s.withColumns({"tier": F.when(both & (F.col("p") == 2), 1).when(both, 2).otherwise(3), "sum": F.col("a") + F.col("b")})
    best = lambda v, t: F.max(F.when(t, F.struct(v.alias("v"), (-F.col("src_strand")).alias("s"))))
    w = Window.partitionBy("read_id")
    s = s.withColumn("low", F.min("tier").over(w))
    pairs = (F.col("tier") == F.col("low")) & (F.col("low") < 3)
    top = s.withColumns({"m": F.max(F.when(pairs, F.col("sum"))).over(w), "ma": F.max("a").over(w), "mb": F.max("b").over(w)})
    g = top.groupBy("read_id").agg(
        F.min("low").alias("low"), F.count_if(pairs & (F.col("sum") == F.col("m"))).alias("n"), F.count_if(F.col("a") == F.col("ma")).alias("na"), F.count_if(F.col("b") == F.col("mb")).alias("nb"),
        best(F.col("sum"), pairs).alias("p"), best(F.col("a"), F.col("a").isNotNull()).alias("x"), best(F.col("b"), F.col("b").isNotNull()).alias("y"),
    )
    paired = F.col("low") < 3
    one = F.when(paired & (F.col("n") == 1), -F.col("p.s")).when(~paired & (F.col("na") == 1), -F.col("x.s"))
    two = F.when(paired & (F.col("n") == 1), -F.col("p.s")).when(~paired & (F.col("nb") == 1), -F.col("y.s"))
    return g.select("read_id", F.col("low").alias("tier"), one.alias("strand1"), two.alias("strand2"))


def best_pairs(candidates: DataFrame, mode: str = "end") -> DataFrame:
    """One row for each read_id and mate: tier, src_strand, chrom, pos, flag, as_score, xs_score, mapq, mate_chrom, mate_pos.

    Needs read_id, mate, src_strand, flag, chrom, pos, as_score, xs_score and score_min, at most one row for
    each read, mate and strand (see ``first_alignment``). The winners are those of ``best_paired``. Both mates
    of a winning pair share a quality made from the sums of their scores; the runner-up is the best other
    strand of the tier where its sum is greater than that of the winner's own second scores. Mates that win
    singly are scored by themselves, against their own second score and the other strands' scores.
    Flags: a winner loses or gains 0x8 and gains 0x20 as its mate is mapped and reversed; a mate without a
    winner has 0x45 or 0x85 (with 0x8 if both have none), no strand, score or place, and quality 0.
    """
    mapped = ~has_flag(F.col("flag"), 4)
    fields = F.struct(F.col("as_score").alias("s"), F.coalesce("xs_score", F.lit(LOW)).alias("x"), F.col("score_min").alias("least"), "flag", "chrom", "pos")
    pick = lambda m: F.max(F.when((F.col("mate") == m) & mapped, fields))
    # both groupings use this one shuffle; a read has a few rows, so nothing is lost to partial aggregation
    dealt = candidates.repartition("read_id")
    strands = dealt.groupBy("read_id", "src_strand").agg(pick(1).alias("a"), pick(2).alias("b"), F.max(F.when(mapped, F.col("flag").bitwiseAND(F.lit(2)))).alias("p"))
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    tier = F.when(both & (F.col("p") == 2), 1).when(both, 2).otherwise(3)
    item = F.struct(F.col("src_strand").alias("st"), tier.alias("tier"), (F.col("a.s") + F.col("b.s")).alias("sum"), "a", "b")
    g = strands.groupBy("read_id").agg(F.sort_array(F.collect_list(item)).alias("o"))
    g = g.withColumn("low", F.array_min(F.transform("o", lambda x: x["tier"])))
    g = g.withColumn("pool", F.filter("o", lambda x: (x["tier"] == F.col("low")) & (F.col("low") < 3)))

    def winner(items, value):
        top = F.array_max(F.transform(items, value))
        at = F.filter(items, lambda x: value(x) == top)
        return F.when(F.size(at) == 1, at[0])

    g = g.withColumns({"w": winner(F.col("pool"), lambda x: x["sum"]), "w1": winner(F.col("o"), lambda x: x["a"]["s"]), "w2": winner(F.col("o"), lambda x: x["b"]["s"])})
    rest = F.filter("pool", lambda x: x["st"] != F.col("w.st"))
    g = g.withColumn("r", F.array_max(F.transform(rest, lambda x: F.struct(x["sum"].alias("sum"), (-x["st"]).alias("neg"), x["a"]["s"].alias("a"), x["b"]["s"].alias("b")))))
    beaten = F.coalesce(F.col("r.sum") > F.col("w.a.x") + F.col("w.b.x"), F.lit(False))
    pair = F.col("low") < 3
    g = g.withColumns({"x1": F.when(beaten, F.col("r.a")).otherwise(F.col("w.a.x")), "x2": F.when(beaten, F.col("r.b")).otherwise(F.col("w.b.x"))})

    def single(mate, w):
        others = F.array_max(F.transform(F.filter("o", lambda x: x["st"] != F.col(f"{w}.st")), lambda x: x[mate]["s"]))
        return F.greatest(F.col(f"{w}.{mate}.x"), others)

    def side(k, mate, w):
        own = F.when(pair, F.col(f"w.{mate}")).otherwise(F.col(f"{w}.{mate}"))
        x = F.when(pair, F.col(f"x{k}")).otherwise(single(mate, w))
        st = F.when(pair, F.col("w.st")).otherwise(F.col(f"{w}.st"))
        return F.struct(F.lit(k).alias("mate"), st.alias("st"), own.alias("own"), x.alias("xs"))

    g = g.select("read_id", "low", side(1, "a", "w1").alias("one"), side(2, "b", "w2").alias("two"))
    by_pair = pair & F.col("one.st").isNotNull()
    total = lambda c: F.col(f"one.{c}") + F.col(f"two.{c}")

    def row(me, other, lost):
        score = lambda c: F.when(by_pair, total(c)).otherwise(F.col(f"{me}.{c}"))
        f, mate_on = F.col(f"{me}.own.flag"), F.col(f"{other}.st").isNotNull()
        turned = F.when(has_flag(F.col(f"{other}.own.flag"), 16), 32).otherwise(0)
        kept = f.bitwiseAND(F.lit(~8)).bitwiseOR(F.when(mate_on, turned).otherwise(8))
        gone = F.lit(lost).bitwiseOR(F.when(mate_on, turned).otherwise(8))
        return F.struct(F.col(f"{me}.mate").alias("mate"), F.col(f"{me}.st").alias("src_strand"), F.col(f"{me}.own").alias("own"), F.col(f"{me}.xs").alias("xs"),
                        F.when(F.col(f"{me}.st").isNotNull(), kept).otherwise(gone).alias("flag"), F.col(f"{other}.own").alias("other"),
                        score("own.s").alias("qs"), score("xs").alias("qx"), score("own.least").alias("ql"))

    e = g.select("read_id", F.col("low").alias("tier"), F.explode(F.array(row("one", "two", 0x45), row("two", "one", 0x85))).alias("r")).select("read_id", "tier", "r.*")
    on = F.col("src_strand").isNotNull()
    both_on = on & F.col("other").isNotNull()
    return e.select(
        "read_id", "mate", "tier", "src_strand", "own.chrom", "own.pos", F.col("flag").cast("int").alias("flag"), F.col("own.s").alias("as_score"),
        F.when(F.col("xs") >= F.col("own.least"), F.col("xs")).alias("xs_score"), F.when(on, F.expr(mapq_sql("qs", "qx", "ql", mode))).otherwise(0).alias("mapq"),
        F.when(both_on, F.col("other.chrom")).alias("mate_chrom"), F.when(both_on, F.col("other.pos")).alias("mate_pos"),
    )


def pair_metrics(chosen: DataFrame) -> DataFrame:
    """One row from ``best_pairs``: reads (two a pair), concordant and discordant pairs, singletons, mapped reads of each strand."""
    on, first = F.col("src_strand").isNotNull(), F.col("mate") == 1
    n = [F.count_if(F.col("src_strand") == k).alias(f"strand{k}") for k in range(4)]
    pairs = [F.count_if(on & first & (F.col("tier") == t)).alias(name) for t, name in ((1, "concordant"), (2, "discordant"))]
    return chosen.agg(F.count("*").alias("reads"), *pairs, F.count_if(on & (F.col("tier") == 3)).alias("singletons"), *n)


def metrics(chosen: DataFrame) -> DataFrame:
    """One row: reads, mapped reads of each strand, unmapped reads, mapped percentage."""
    n = [F.count_if(F.col("src_strand") == k).alias(f"strand{k}") for k in range(4)]
    return chosen.agg(F.count("*").alias("reads"), *n, F.count_if(F.col("src_strand").isNull()).alias("unmapped"), F.format_string("%6.2f%%", F.try_divide(F.lit(100.0) * F.count("src_strand"), F.count("*"))).alias("mapped_percent"))
