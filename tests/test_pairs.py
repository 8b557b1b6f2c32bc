"""Mates are brought together without windows, and written by one job."""

from pyspark.sql import functions as F

from methylspark.operators import extract
from methylspark.sources import fastq, sinks

SHAPE = "read_id long, second_mate boolean, chrom string, pos int, cigar string, flag int, mapq int, xg string, xm string, qual string"


def test_calls_of_mates_that_do_not_pass_stay(spark):
    aln = spark.createDataFrame([(1, False, "c", 5, "2M", 0, 3, "CT", "Zz", "II"), (1, True, "c", 6, "2M", 0, 30, "CT", "zX", "II"), (2, True, "c", 9, "2M", 0, 30, "CT", "Z.", "II"), (3, False, "c", 1, "2M", 1024, 3, "CT", "ZZ", "II"), (3, True, "c", 1, "2M", 0, 30, "CT", "ZZ", "II")], SHAPE)
    t = extract.templates(aln)
    assert "Window" not in t._jdf.queryExecution().executedPlan().toString()
    got = {r.read_id: r for r in t.collect()}
    assert {k: r.pair_class for k, r in got.items()} == {1: "second", 2: "second"} and got[1].one.xm is None and got[2].one is None and got[1].two.xm == "zX"
    sites = {(r.context, r.start): (r.n_meth, r.n_unmeth) for r in extract.paired_site_counts(aln).collect()}
    assert sites == {("CpG", 6): (0, 1), ("CHG", 7): (1, 0), ("CpG", 9): (1, 0)}


def test_pairs_of_one_job(spark, tmp_path):
    r = spark.range(0, 103, numPartitions=3).select(F.concat(F.lit("r"), "id").alias("name"), F.concat(F.lit("AC"), F.lpad(F.lit(""), (F.col("id") % 5).cast("int"), F.lit("G"))).alias("seq1"))
    r = r.select("name", "seq1", F.translate("seq1", "ACG", "@+I").alias("qual1"), F.reverse("seq1").alias("seq2"), F.translate(F.reverse("seq1"), "ACG", "@+I").alias("qual2"))
    conf = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
    sinks.write_fastq_pairs(r, str(tmp_path / "x"), "gzip", per_file=9)
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == conf and len(list((tmp_path / "x" / "mate=2").glob("*.gz"))) == 12
    got = fastq.read_fastq_pairs(spark, f"{tmp_path}/x/mate=1", f"{tmp_path}/x/mate=2").drop("file", "ordinal")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, r.collect()))


def test_long_gaps_and_many_cigars():
    """Mates that meet over a gap of a million bases take cells for their bases alone, and each cigar is walked once."""
    import numpy as np
    import pyarrow as pa

    from methylspark.operators import accumulate

    shape = pa.struct([("pos", pa.int32()), ("cigar", pa.string()), ("xm", pa.string()), ("qual", pa.string())])
    for gap in (3, 30_000_000):
        one = pa.array([{"pos": 10, "cigar": f"2M{gap}N2M", "xm": "ZzZ.", "qual": "IIII"}, None], shape)
        two = pa.array([{"pos": 11, "cigar": f"1M{gap}N2M1S", "xm": "Z.zZ", "qual": "?5I!"}, {"pos": 4, "cigar": "1I1M", "xm": "zX", "qual": "II"}], shape)
        row, mate, site, letter = accumulate.template_calls(pa.array(["overlap", "second"]), one, two, 5)
        got = sorted(zip(row.tolist(), site.tolist(), bytes(letter.tolist()).decode()))
        assert got == [(0, 10, "Z"), (0, 11, "z"), (0, 12 + gap, "Z"), (1, 4, "X")], gap
    accumulate._walk.cache_clear()
    row, place = accumulate._laid(pa.array(["1S2M", "3M", None, "1S2M"] * 50), np.full(200, 3))
    assert accumulate._walk.cache_info().misses <= 2 and accumulate._walk.cache_info().hits <= 2 and place[:12].tolist() == [-1, 0, 1, 0, 1, 2, -1, -1, -1, -1, 0, 1]
