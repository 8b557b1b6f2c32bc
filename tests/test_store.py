"""The store by place: equal results, no shuffle before the counts, and only the buckets of a region."""

import random

import pytest
from pyspark.sql import functions as F

from methylspark.operators import calling, extract, genome
from methylspark.sources import store

SHAPE = "read_id int, chrom string, pos int, cigar string, flag int, mapq int, xg string, seq string, qual array<int>"


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(6)
    contigs = [(f"c{k}", "".join(rng.choice("ACGT") for _ in range(n))) for k, n in enumerate((40_000, 9_000, 300, 0))]
    rows = []
    for k in range(900):
        c, s = contigs[rng.choice((0, 0, 0, 1, 2))]
        pos = rng.choice((0, 8190, 8191, 8192, rng.randrange(len(s)))) % (len(s) - 60)
        flag = 4 if k % 50 == 0 else 0
        rows.append((k, c, pos, "20M3D30M" if k % 7 == 0 else "50M", flag, 40, rng.choice(("CT", "GA")), s[pos : pos + 50], [30] * 50))
    rows += [(1000, None, None, "*", 4, 0, None, "ACGT", [30] * 4), (1001, "*", -1, "*", 4, 0, None, "ACGT", [30] * 4)]
    return spark.createDataFrame(rows, SHAPE), spark.createDataFrame(contigs, "chrom string, seq string")


def test_store_gives_what_the_join_gives(spark, tables, tmp_path):
    aln, contigs = tables
    store.write_store(aln, contigs, str(tmp_path / "s"), buckets=8)
    opened = store.open_store(spark, str(tmp_path / "s"))
    ref = lambda df: sorted((r.read_id, r.ref) for r in df.select("read_id", "ref").collect())
    assert ref(store.referenced(opened)) == ref(genome.with_reference(aln, contigs))
    sites = lambda df: sorted(map(tuple, extract.site_counts(extract.calls(extract.keep(df.withColumn("xm", calling.call_xm())))).collect()))
    want = sites(genome.with_reference(aln, contigs))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = store.referenced(opened)
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SortMergeJoin" in plan and "Bucketed: true" in plan
        assert sites(joined) == want and len(want) > 1000
        plain = genome.with_reference(aln, contigs)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" in plain
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    files = opened.alignments.select(F.input_file_name()).distinct().count()
    assert 1 < files <= 8


@pytest.mark.parametrize("chrom,start,end", [("c0", 8150, 8200), ("c0", 0, 1), ("c0", 20_000, 33_000), ("c2", 100, 101), ("c9", 0, 10), ("c1", 8999, 20_000)])
def test_regions(spark, tables, tmp_path, chrom, start, end):
    aln, contigs = tables
    store.write_store(aln, contigs, str(tmp_path / "s"), buckets=8)
    opened = store.open_store(spark, str(tmp_path / "s"))
    got = store.region(opened, chrom, start, end)
    span = lambda r: 53 if "D" in r.cigar else 50
    want = sorted(r.read_id for r in aln.collect() if not r.flag & 4 and r.chrom == chrom and r.pos < end and r.pos + span(r) > start)
    assert sorted(r.read_id for r in got.collect()) == want
    if end - start < 100:
        # shown where Spark keeps to buckets also without a join; files of other buckets are left out in either case
        spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
        try:
            plan = store.region(opened, chrom, start, end)._jdf.queryExecution().executedPlan().toString()
        finally:
            spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
        chosen = int(plan.split("SelectedBucketsCount: ")[1].split(" ")[0])
        assert chosen <= 2


def test_store_refuses_alignments_over_a_margin(spark, tables, tmp_path):
    _, contigs = tables
    far = spark.createDataFrame([(1, "c0", 5, "25M2000N25M", 0, 40, "CT", "A" * 50, [30] * 50)], SHAPE)
    with pytest.raises(Exception, match="covers more than"):
        store.write_store(far, contigs, str(tmp_path / "s"), buckets=2)
    store.write_store(far.limit(0), contigs, str(tmp_path / "none"), buckets=2)
    assert store.referenced(store.open_store(spark, str(tmp_path / "none"))).count() == 0


@pytest.mark.parametrize("max_span", [None, 60])
def test_piles_are_spread_over_the_join(spark, max_span):
    """Half of the reads stand on one tile, some are unmapped: no task gets many more than the others, and windows are the same."""
    rng = random.Random(8)
    contigs = [(f"c{k}", "".join(rng.choice("ACGT") for _ in range(60_000))) for k in range(40)]
    rows = []
    for k in range(6000):
        c, s = contigs[0 if k % 2 else rng.randrange(40)]
        pos = rng.randrange(8192, 8300) if k % 2 else rng.randrange(59_000)
        rows.append((k, c, pos, "20M3D30M" if k % 9 == 0 else "50M", 4 if k % 100 == 0 else 0, 40, "CT", s[pos : pos + 50], [30] * 50))
    aln, genome_ = spark.createDataFrame(rows, SHAPE).repartition(4), spark.createDataFrame(contigs, "chrom string, seq string")
    keys = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "8"}
    before = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        want = {r.read_id: r.ref for r in genome.with_reference(aln, genome_, max_span=max_span).collect()}
        got = genome.with_reference(aln, genome_, max_span=max_span, spread=True)
        assert {r.read_id: r.ref for r in got.collect()} == want and set(got.columns) == {*aln.columns, "ref"}
        sizes = sorted(r.n for r in genome.with_reference(aln, genome_, max_span=60, spread=True).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect())
        assert sizes[-1] < 2 * sizes[len(sizes) // 2]
        lost = aln.filter("read_id = 3").withColumn("chrom", F.lit("nowhere"))
        with pytest.raises(Exception, match="outside the genome"):
            genome.with_reference(lost, genome_, max_span=max_span, spread=True).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
