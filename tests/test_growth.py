"""Steps that carried whole contigs, or a row for each base, through shuffles: what they give and how they are planned."""

import random

from pyspark.sql import functions as F

from methylspark.functions import seq
from methylspark.operators import accumulate, calling, dedup, extract, genome
from methylspark.plans import derive
from methylspark.plans.queries import queries
from methylspark.sources import sinks, text
from methylspark.streaming.site_counts import Sums

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df):
    return sorted(map(str, df.collect()))


def test_placed_reads_carry_no_contig(spark):
    assert {"contig", "seq", "qual"}.isdisjoint(derive.placed(spark, SF).columns)


def test_mates_are_resolved_in_one_row(spark):
    """overlap_resolved and paired_site_counts have no row for each base before a shuffle."""
    assert "posexplode" not in plan(queries()["paired_site_counts"](spark, SF)) and "Generate explode(transform" not in plan(queries()["overlap_resolved"](spark, SF))


def mates(spark, n=300):
    r = random.Random(5)
    out = []
    for k in range(n):
        xg, at = r.choice(["CT", "GA"]), r.randrange(50)
        for mate in r.choice([(1,), (2,), (1, 2), (1, 2), (1, 2)]):
            cigar = r.choice(["8M", "2S6M", "3M2D5M", "3M1I4M"])
            other = r.random() < 0.1
            out.append((k, mate == 2, "d" if other else "c", at + r.randrange(6), cigar, r.choice([0, 0, 0, 1024, 4]), r.choice([3, 30, 30]), xg if r.random() < 0.9 else "CT", "OT" if xg == "CT" else "OB", "".join(r.choice("zZxXhH...") for _ in range(8)), [r.randrange(40) for _ in range(8)]))
    return spark.createDataFrame(out, "read_id long, second_mate boolean, chrom string, pos int, cigar string, flag int, mapq int, xg string, strand string, xm string, qual array<int>")


def test_template_calls_equal_resolved_bases(spark):
    for bounds in (None, {"OT": (1, 7, 2, 0), "OB": (0, 6, 0, 5)}):
        t = extract.templates(mates(spark), stranded=True).select("read_id", "pair_class", F.posexplode(F.array("one", "two")).alias("m", "r")).filter("r is not null")
        used = (F.col("pair_class") != "second") & (F.col("m") == 0) | (F.col("pair_class") != "first") & (F.col("m") == 1)
        items = F.arrays_zip(seq.cigar_positions(F.col("r.cigar"), F.col("r.pos")).alias("p"), seq.letters(F.col("r.xm")).alias("c"), F.col("r.qual").alias("q"))
        b = t.filter(used).select("read_id", "r.chrom", "r.xg", "r.strand", "r.second_mate", (F.col("m") + 1).alias("mate"), F.posexplode(items).alias("i", "s")).filter("s.p is not null")
        if bounds:
            b = b.filter(extract.in_bounds(F.col("i"), F.col("strand"), F.col("second_mate"), bounds))
        want = extract.resolve_overlaps(b.select("read_id", "xg", "chrom", F.col("s.p").alias("site"), "mate", F.col("s.c").alias("call"), F.col("s.q").alias("q")), 5, ("read_id", "xg"))
        got = extract.paired_calls(mates(spark), bounds=bounds)
        kind = F.lower("call")
        want = want.select("read_id", "chrom", "site", F.when(F.col("xg") == "CT", "+").otherwise("-").alias("sign"), F.when(kind == "z", "CpG").when(kind == "x", "CHG").otherwise("CHH").alias("context"), (F.col("call") != kind).alias("methylated"))
        assert rows(got) == rows(want) and got.count() > 300
        assert rows(extract.paired_site_counts(mates(spark), bounds=bounds)) == rows(extract.site_counts(got))


def test_calls_of_odd_rows(spark):
    reads = [("CCGT", "4M", "CT", "NNccggNN"), ("TTAA", "1S2M1S", "CT", "NNCGNN"), ("GA", "2M", "GA", "ccGGNN"), ("", "0M", "CT", "NNNN"), ("ACG", "1M1I1M", "CT", "NNACGN"), ("C", "1M", "CT", None), (None, "1M", "CT", "NNCNN")]
    df = spark.createDataFrame(reads, "seq string, cigar string, xg string, ref string").withColumn("pos", F.lit(7))
    assert [r.xm for r in df.withColumn("xm", calling.call_xm()).collect()] == ["XZ..", ".z..", "Zx", "", "...", None, None]
    one = spark.createDataFrame([("ACGT", "4M", "....", "NNATGGNN")], "seq string, cigar string, xm string, ref string").withColumn("pos", F.lit(0))
    assert one.select(calling.call_xx().alias("x")).first().x.asDict() == {"xx": "1T1G", "nm": 2}


def test_qualities_as_columns(spark):
    df = spark.createDataFrame([([0, 41, 93],), ([],), (None,), ([100, 3],), ([5, None],)], "q array<int>")
    got = df.select(seq.encode_phred("q").alias("t"), seq.total_phred("q").alias("n")).collect()
    assert [r.t for r in got] == ["!J~", "", None, "\x85$", "&"] and [r.n for r in got] == [134, 0, None, 103, None]
    back = spark.createDataFrame([("!J~",), ("",), (None,), ("\x85!",)], "t string").select(seq.decode_phred(F.col("t")).alias("q"))
    assert [r.q for r in back.collect()] == [[0, 41, 93], [], None, [100, 0]]


def test_windows_and_motifs_at_borders(spark):
    r = random.Random(3)
    s = "".join(r.choice("ACGTacgt") for _ in range(70))
    c = spark.createDataFrame([("c", s)], "chrom string, seq string")
    a = spark.createDataFrame([("c", p, f"{n}M", "A" * n, 0) for p in range(66) for n in (1, 4, 9)], "chrom string, pos int, cigar string, seq string, flag int")
    got = genome.with_reference(a, c, tile=16, overlap=16, max_span=9)
    padded = "NN" + s + "N" * 20
    assert all(x.ref == padded[x.pos : x.pos + len(x.seq) + 4] for x in got.collect())
    want = [k for k in range(69) if s[k : k + 2].upper() == "CG"]
    assert sorted(x.start for x in genome.motif_positions(c, ["CG"], tile=16).collect()) == want


def test_sam_lines_with_own_contig_order(spark, tmp_path):
    c = spark.createDataFrame([("b", 0, 100), ("a", 1, 100)], "chrom string, ord long, length int")
    a = spark.createDataFrame([("q1", 0, "a", 5), ("q2", 0, "b", 9), ("q3", 0, "b", 2), ("q4", 4, None, None)], "qname string, flag int, chrom string, pos int")
    a = a.withColumns({"mapq": F.lit(1), "cigar": F.lit("2M"), "mate_chrom": F.lit("*"), "mate_pos": F.lit(-1), "tlen": F.lit(0), "seq": F.lit("AC"), "qual": F.array(F.lit(3), F.lit(4))})
    own = a.join(c.select("chrom", "ord"), "chrom", "left")
    sinks.write_sam(a, c, str(tmp_path / "x"), by_position=True)
    sinks.write_sam(own, c, str(tmp_path / "y"), by_position=True, compression="gzip")
    x, y = ([r.value for r in spark.read.text(str(tmp_path / d / "records")).collect()] for d in "xy")
    assert x == y and [v.split("\t")[0] for v in x] == ["q3", "q2", "q1", "q4"]
    assert text.read_sam(spark, str(tmp_path / "y" / "records")).filter("qname = 'q1'").first().qual == [3, 4]


def test_one_snapshot_is_not_summed_again(spark, tmp_path):
    sums = Sums(spark, str(tmp_path / "s"), every=2)
    for n in range(2):
        sums.add(spark.createDataFrame([("CpG", "c", 5, 1, 2), ("CHH", "c", 9000, n, 0)], "context string, chrom string, start int, n_meth long, n_unmeth long"), n)
    got = sums.totals()
    assert "Aggregate" not in plan(got) and rows(got) == rows(spark.createDataFrame([("CpG", "c", 5, 2, 4), ("CHH", "c", 9000, 1, 0)], got.schema))


def test_templates_maps_keep_clipped_places(spark):
    df = spark.createDataFrame([(1, False, "c", 10, "2S4M", 0, "OT", "z.Z..x", [9] * 6)], "read_id long, second_mate boolean, chrom string, pos int, cigar string, flag int, strand string, xm string, qual array<int>")
    got = dedup.pair_rows(df, words=1).first()
    assert (got.meth, got.unmeth, got.phred, got.calls, got.start1) == ([4, 0], [33, 0], 54, 3, 8)
