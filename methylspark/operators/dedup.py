"""PCR duplicates: keys, call maps, greedy marking."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from methylspark.functions.seq import has_flag, letters, total_phred, unclipped_start
from methylspark.operators import accumulate
from methylspark.operators.staging import remove, stage_path, written


def edit_distance(m1, u1, m2, u2) -> Column:
    """Positions that one read has methylated and the other unmethylated; calls against none cost nothing.

    Maps may differ in length; words that one of them lacks hold no calls.
    """
    differ = lambda a, b: F.coalesce(a, F.lit(0)).bitwiseXOR(F.coalesce(b, F.lit(0)))
    return F.aggregate(
        F.zip_with(F.zip_with(m1, m2, differ), F.zip_with(u1, u2, differ), lambda x, y: F.bit_count(x.bitwiseAND(y))),
        F.lit(0), lambda a, x: a + x,
    )


def call_maps(xm, qual, min_phred: int = 5, words: int = 4) -> tuple[Column, Column]:
    """(methylated, unmethylated) bit maps of a call string as arrays of longs of 62 bits each.

    There are ``words`` of them, and as many more as the calls of a longer read fill.
    """
    good = F.array_join(F.zip_with(letters(xm), qual, lambda c, q: F.when(q >= min_phred, c).otherwise(".")), "")

    rest = F.regexp_extract_all(F.substring(good, 62 * words + 1, 2**31 - 1), F.lit("(?s).{1,62}"), F.lit(0))

    def word(part, ones):
        digits = F.translate(F.reverse(part), "ZXHzxh.", ones)
        return F.when(digits == "", 0).otherwise(F.conv(digits, 2, 10)).cast("long")

    def more(ones):
        return F.coalesce(F.transform(rest, lambda part: word(part, ones)), F.array().cast("array<bigint>"))

    maps = [F.concat(F.array(*[word(F.substring(good, 62 * w + 1, 62), ones) for w in range(words)]), more(ones)) for ones in ("1110000", "0001110")]
    return maps[0], maps[1]


PAIR_KEY = ["chrom1", "strand1", "start1", "chrom2", "strand2", "start2"]


def pair_rows(aln: DataFrame, read_id: str = "read_id", words: int = 4, min_phred: int = 5) -> DataFrame:
    """One row for each template: read_id, PAIR_KEY, meth, unmeth (words of both mates), calls, phred.

    Needs chrom, pos, cigar, flag, strand, second_mate, xm and qual (array). A missing or unmapped mate has a
    null chrom, strand and start and empty maps, so single ends, orphans and pairs share one rule. Clipped bases
    keep their places in the maps: ``words`` words of mate 1, as many of mate 2, and then, word by word in turn, what
    longer mates have beyond them. Templates without a mapped mate are left out.
    """
    start = unclipped_start(F.col("cigar"), F.col("pos"))
    mapped = aln.filter(~has_flag(F.col("flag"), 4) & F.col("pos").isNotNull())
    told = mapped.withColumns({"_mate": F.when(F.col("second_mate"), 2).otherwise(1), "_start": start.cast("int"), "_q": total_phred(F.col("qual"))})
    # maps are made in arrays, so only words and keys travel to the template
    # (by their letters' own places: a clip takes none away)
    told = told.select(read_id, "_mate", "chrom", "strand", "_start", "_q", "pos", F.concat(F.length("xm").cast("string"), F.lit("M")).alias("cigar"), "xm", "qual", F.lit("CT").alias("xg"))
    own = accumulate.call_maps(told, [read_id, "_mate", "chrom", "strand", "_start", "_q"], min_phred, words)
    one = own.select(read_id, "_mate", F.struct("chrom", "strand", F.col("_start").alias("start"), F.col("meth").alias("m"), F.col("unmeth").alias("u"), F.col("_q").alias("q")).alias("r"))
    g = one.groupBy(read_id).agg(*[F.max(F.when(F.col("_mate") == k, F.col("r"))).alias(f"r{k}") for k in (1, 2)])
    none = F.array_repeat(F.lit(0).cast("long"), words)
    zero = lambda x: F.coalesce(x, F.lit(0).cast("long"))

    def both(c):
        m1, m2 = [F.coalesce(f"r{k}.{c}", none) for k in (1, 2)]
        beyond = [F.slice(x, words + 1, F.size(x)) for x in (m1, m2)]
        return F.concat(F.slice(m1, 1, words), F.slice(m2, 1, words), F.flatten(F.zip_with(*beyond, lambda a, b: F.array(zero(a), zero(b)))))

    maps = [both(c).alias(n) for c, n in (("m", "meth"), ("u", "unmeth"))]
    key = [F.col(f"r{k}.{c}").alias(f"{c}{k}") for k in (1, 2) for c in ("chrom", "strand", "start")]
    phred = sum(F.coalesce(f"r{k}.q", F.lit(0)) for k in (1, 2))
    set_bits = lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + F.bit_count(x))
    return g.select(read_id, *key, *maps, phred.alias("phred")).withColumn("calls", set_bits("meth") + set_bits("unmeth"))


#: Keys with more distinct maps are settled in rounds over tables, others in arrays inside one task.
ROW_MAPS = 1 << 16
#: Maps of whole keys that a task settles together.
MAPS = 1 << 16
#: Most positions that maps of such a key are dealt out by, and how many maps a cell should come down to.
CELL_BITS, CELL_MAPS = 16, 32


def _differ(a: str, b: str) -> Column:
    """Do two rows (aliases) have a position that one has methylated and the other unmethylated?"""
    none = F.lit(0).cast("long")
    x = lambda c: F.zip_with(f"{a}.{c}", f"{b}.{c}", lambda m, n: F.coalesce(m, none).bitwiseXOR(F.coalesce(n, none)))
    return F.exists(F.zip_with(x("meth"), x("unmeth"), lambda m, u: m.bitwiseAND(u) != 0), lambda both: both)


def _bit(c: str, place) -> Column:
    """Bit ``place`` of a map's words; 0 beyond them."""
    word = F.coalesce(F.get(F.col(c), F.floor(place / 62).cast("int")), F.lit(0).cast("long"))
    return F.call_function("shiftrightunsigned", word, (place % 62).cast("int")).bitwiseAND(F.lit(1))


def _cells(maps: DataFrame) -> DataFrame:
    """Add ``cell``: a row for each cell that a map may share with a compatible one.

    For each key, positions are chosen at which most maps have a call and both calls are frequent. A cell is a choice of
    calls at these; a map is in all cells that do not contradict its own calls. Compatible maps contradict each
    other nowhere, so they share a cell. More positions are chosen as a key has more maps.
    """
    n = F.size("meth")
    place = F.explode(F.sequence(F.lit(0), n * 62 - 1))
    each = maps.select("_key", "meth", "unmeth", place.alias("place"))
    at = each.groupBy("_key", "place").agg(F.sum(_bit("meth", F.col("place"))).alias("m"), F.sum(_bit("unmeth", F.col("place"))).alias("u"), F.count("*").alias("n")).filter("m > 0 and u > 0")
    # a map without a call at a position is in twice as many cells, so such positions count for less
    score = F.least("m", "u") - (F.col("n") - F.col("m") - F.col("u"))
    order = Window.partitionBy("_key").orderBy(score.desc(), "place")
    wanted = F.ceil(F.log2(F.greatest(F.col("n") / CELL_MAPS, F.lit(1.0))))
    chosen = at.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= F.least(wanted, F.lit(CELL_BITS)))
    chosen = chosen.groupBy("_key").agg(F.sort_array(F.collect_list("place")).alias("places"))
    none = F.array(F.lit(0).cast("long"))

    def split(cells, p):
        m, u = _bit("meth", p), _bit("unmeth", p)
        one, zero = F.transform(cells, lambda c: c * 2 + 1), F.transform(cells, lambda c: c * 2)
        return F.when(m == 1, one).when(u == 1, zero).otherwise(F.concat(zero, one))

    cells = F.aggregate(F.coalesce("places", F.array().cast("array<int>")), none, split)
    return maps.join(chosen, "_key", "left").withColumn("cell", F.explode(cells)).drop("places")


def _first_independent(maps: DataFrame) -> DataFrame:
    """id of the maps that are kept, for keys with many maps, in as many rounds as decisions hang on each other.

    In a round a map is kept if no earlier undecided map is compatible with it, and then undecided maps compatible with
    one of these go. Both are existence joins by (key, cell), so compatible pairs are never listed. What is left is
    written; tables of rounds that are over are removed.
    """
    spark = maps.sparkSession
    path = stage_path(spark, "duplicates")
    left = written(_cells(maps).select("_key", "cell", F.struct("c", "p", "id").alias("o"), "id", "meth", "unmeth"), "duplicates", path)
    done = None
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    while not left.isEmpty():
        # little data, much to compare: all tasks get cells, and the joins of a round share this shuffle
        left = left.repartition(tasks, "_key", "cell")
        same = (F.col("a._key") == F.col("b._key")) & (F.col("a.cell") == F.col("b.cell")) & ~_differ("a", "b")
        held = left.alias("b").join(left.alias("a"), same & (F.col("a.o") < F.col("b.o")), "left_semi").select("id").distinct()
        kept = written(left.join(held, "id", "left_anti"), "duplicates-kept")
        ids = kept.select("id").distinct()
        rest = left.join(ids, "id", "left_anti")
        gone = rest.alias("b").join(kept.alias("a"), same, "left_semi").select("id").distinct()
        after = stage_path(spark, "duplicates")
        now = written(rest.join(gone, "id", "left_anti").select(*left.columns), "duplicates", after)
        remove(spark, path)
        left, path = now, after
        done = ids if done is None else done.unionByName(ids)
    return done if done is not None else maps.select("id")


def _words(maps: pa.Array, width: int) -> np.ndarray:
    """Maps as rows of ``width`` words; words that one lacks hold no calls."""
    sizes = pc.list_value_length(maps).to_numpy()
    out = np.zeros((len(maps), width), np.int64)
    row = np.repeat(np.arange(len(maps)), sizes)
    out[row, np.arange(len(row)) - (np.cumsum(sizes) - sizes)[row]] = maps.flatten().to_numpy()
    return out


def _first_of_each(key: np.ndarray, meth: np.ndarray, unmeth: np.ndarray) -> np.ndarray:
    """Rows that are kept, of rows sorted by key and order: the first left of every key is kept and drops what it is compatible with, until none is left."""
    left, kept = np.arange(len(key)), []
    while len(left):
        k = key[left]
        first = np.r_[True, k[1:] != k[:-1]]
        kept.append(left[first])
        head = left[first][np.cumsum(first) - 1]
        left = left[(((meth[head] ^ meth[left]) & (unmeth[head] ^ unmeth[left])) != 0).any(1)]
    return np.concatenate(kept) if kept else left


def _settled(first: DataFrame, together: int = MAPS) -> DataFrame:
    """id of the maps that are kept, for keys whose maps fit into a task: these are brought together, in order, and settled in arrays."""
    rows = first.select(F.xxhash64("_key").alias("_hash"), F.to_json("_key", {"ignoreNullFields": "false"}).alias("_key"), "c", "p", "id", "meth", "unmeth")
    # the hash decides the order of most keys, so that texts are compared where two keys share one only
    rows = rows.repartition("_hash").sortWithinPartitions("_hash", "_key", "c", "p", "id").select("_key", "id", "meth", "unmeth")

    def settle(t: pa.Table) -> pa.RecordBatch:
        key, ids, *maps = (c.combine_chunks() for c in t.columns)
        maps = [m.combine_chunks() if isinstance(m, pa.ChunkedArray) else m for m in maps]
        width = max(pc.max(pc.list_value_length(m)).as_py() or 0 for m in maps)
        code = key.dictionary_encode()
        code = code.combine_chunks() if isinstance(code, pa.ChunkedArray) else code
        kept = _first_of_each(code.indices.to_numpy(), *(_words(m, width) for m in maps))
        return pa.RecordBatch.from_arrays([ids.take(pa.array(kept))], ["id"])

    def run(batches):
        held, n = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            n += b.num_rows
            if n < together:
                continue
            t = pa.Table.from_batches(held)
            # the last key may go on in the next batch
            last = pc.index(t.column(0), t.column(0)[-1]).as_py()
            if last:
                yield settle(t.slice(0, last))
            held, n = t.slice(last).combine_chunks().to_batches(), t.num_rows - last
        if held:
            yield settle(pa.Table.from_batches(held))

    return rows.mapInArrow(run, f"id {first.schema['id'].dataType.simpleString()}")


def mark_duplicates(reads: DataFrame, key: list[str], read_id: str = "read_id", ids: DataFrame | None = None, row_maps: int = ROW_MAPS) -> DataFrame:
    """read_id, duplicate. Inside a key, reads in the order (calls desc, phred desc, read_id): a read is a
    duplicate if an earlier kept one is at distance 0.

    Needs meth and unmeth (arrays of longs), calls and phred. Reads of one key with the same maps are
    settled before: only the first of them can be kept, so a pile of identical copies reaches the
    order-dependent step as one row. ``ids`` are the same reads' ids from a cheaper source than ``reads``, where
    the maps have been derived and should not be so twice. Null keys are equal to each other.

    Keys of up to ``row_maps`` distinct maps are settled in arrays, many keys together in a task. Keys with more go through rounds: the
    first maps that nothing earlier can drop are kept together, drop what they are compatible with, and so on. A
    round needs no more than a join inside small cells of a key (see ``_cells``), so no row or task holds a whole
    key, and there are as many rounds as the longest chain of decisions that wait for each other.
    """
    first = reads.groupBy(F.struct(*key).alias("_key"), "meth", "unmeth").agg(F.max(F.struct("calls", "phred", (-F.col(read_id)).alias("neg"))).alias("top"))
    order = [(-F.col("top.calls")).alias("c"), (-F.col("top.phred")).alias("p"), (-F.col("top.neg")).alias("id")]
    first = written(first.select("_key", *order, "meth", "unmeth"), "duplicates")
    long = written(first.groupBy("_key").agg(F.count("*").alias("n")).filter(F.col("n") > row_maps).select("_key"), "duplicates")
    some = not long.isEmpty()
    short = first.join(long, "_key", "left_anti") if some else first
    kept = _settled(short).select(F.col("id").alias(read_id))
    if some:
        kept = kept.unionByName(_first_independent(first.join(long, "_key", "left_semi")).select(F.col("id").alias(read_id)))
    kept = kept.withColumn("_dup", F.lit(False))
    return (reads if ids is None else ids).select(read_id).join(kept, read_id, "left").select(read_id, F.coalesce("_dup", F.lit(True)).alias("duplicate"))


def duplicate_totals(marks: DataFrame) -> DataFrame:
    """One row: reads, duplicates and their percentage (nan of none)."""
    n = F.count_if("duplicate")
    share = F.when(F.count("*") > 0, F.format_string("%6.2f%%", F.try_divide(F.lit(100.0) * n, F.count("*")))).otherwise("nan")
    return marks.agg(F.count("*").alias("reads"), n.alias("duplicates"), share.alias("duplicate_percent"))


def flag_duplicates(aln: DataFrame, marks: DataFrame, read_id: str = "read_id") -> DataFrame:
    """Set bit 0x400 on marked reads."""
    marked = marks.filter("duplicate").select(read_id, F.lit(1024).alias("_bit"))
    return aln.join(marked, read_id, "left").withColumn("flag", F.col("flag").bitwiseOR(F.coalesce("_bit", F.lit(0)))).drop("_bit")
