"""Counts in arrays against a row for each call."""

import random

import pytest
from pyspark.sql import functions as F

from methylspark.functions.seq import cigar_positions
from methylspark.operators import accumulate, calling, dedup, extract, genome

SHAPE = "read_id int, chrom string, pos int, cigar string, flag int, mapq int, xg string, strand string, second_mate boolean, seq string, qual array<int>"
BOUNDS = {"OT": (4, 50, 3, 25), "OB": (0, 22, 6, 0), "CTOT": (2, 0, 2, 0), "CTOB": (0, 20, 0, 28)}


@pytest.fixture(scope="module")
def reads(spark):
    rng = random.Random(12)
    contigs = [(f"c{k}", "".join(rng.choice("ACGTacgtN") for _ in range(n))) for k, n in enumerate((9000, 700, 90))]
    rows = []
    for k in range(700):
        c, s = rng.choice(contigs)
        cigar = rng.choice(["30M", "30M", "30M", "3S20M7S", "2H10M4I16M", "12M2D18M", "5=1X24M", "10M40N20M", "30I"])
        pos = rng.randrange(0, len(s) - 75)
        seq = "".join(rng.choice("ACGTN") for _ in range(30))
        xg = rng.choice(("CT", "GA"))
        strand = {"CT": ("OT", "CTOT"), "GA": ("OB", "CTOB")}[xg][rng.random() < 0.3]
        qual = None if k % 60 == 0 else [rng.randrange(0, 41) for _ in range(30)]
        rows.append((k, c, pos, cigar, 0, rng.randrange(43), xg, strand, rng.random() < 0.4, seq, qual))
    rows += [(900, None, None, "*", 4, 40, None, None, False, "ACGT", [30] * 4), (901, "c0", 100, "30M", 0, 40, "CT", "OT", False, "C" * 30, [30] * 30)]
    rows += [(902, "c0", 0, "8000M", 0, 40, "CT", "OT", False, "C" * 8000, [30] * 8000)] * 3
    df = spark.createDataFrame(rows, SHAPE).repartition(3)
    return genome.with_reference(df, spark.createDataFrame(contigs, "chrom string, seq string"))


def same(a, b):
    order = sorted(a.columns)
    assert sorted(map(repr, a.select(order).collect())) == sorted(map(repr, b.select(order).collect()))
    return a.count()


@pytest.mark.parametrize("phred,contexts,bounds", [(5, ("CpG", "CHG", "CHH"), None), (20, ("CHG", "CpG"), BOUNDS), (0, ("CHH",), None)])
@pytest.mark.parametrize("bases,sites", [(1 << 20, 1 << 21), (50, 7)])
def test_sites_in_arrays(spark, reads, phred, contexts, bounds, bases, sites):
    made = extract.keep(reads.withColumn("xm", calling.call_xm()))
    for sign in (False, True):
        want = extract.site_counts(extract.calls(made, phred, contexts, bounds), sign)
        assert same(accumulate.count_sites(made, phred, contexts, bounds, sign, bases, sites), want) > 20
        same(accumulate.count_sites(extract.keep(reads), phred, contexts, bounds, sign, bases, sites), want)


def test_mbias_in_arrays(spark, reads):
    made = extract.keep(reads.withColumn("xm", calling.call_xm()))
    for bounds in (None, BOUNDS):
        want = extract.mbias(extract.calls(made, 10, ("CpG",), bounds, ("read_id", "strand", "second_mate")))
        assert same(accumulate.count_mbias(made, 10, bounds), want) > 20
        same(accumulate.count_mbias(extract.keep(reads), 10, bounds), want)


@pytest.mark.parametrize("words", [1, 4])
def test_maps_in_arrays(spark, reads, words):
    made = reads.filter("read_id < 900").withColumn("xm", calling.call_xm())
    m, u = dedup.call_maps(F.col("xm"), F.col("qual"), words=words)
    want = made.filter("qual is not null").select("read_id", "strand", m.alias("meth"), u.alias("unmeth"))
    for source in (made, reads.filter("read_id < 900")):
        got = accumulate.call_maps(source.filter("qual is not null"), ["read_id", "strand"], words=words)
        assert same(got.drop("calls"), want) > 600
        assert all(r.calls == sum(x.bit_count() for x in r.meth + r.unmeth) for r in got.collect())


def test_no_reads(spark, reads):
    none = reads.limit(0)
    assert accumulate.call_maps(none, ["read_id"]).count() == 0
    assert accumulate.count_sites(none).count() == 0 and accumulate.count_mbias(none).count() == 0
    assert accumulate.count_sites(reads.filter("read_id = 900")).count() == 0


def test_places_are_those_of_the_cigar(spark):
    cigars = ["5M", "2S3M1I2M2D2M", "3H2S5M", "5M3N5M", "1X2=3P4M", "4I"]
    df = spark.createDataFrame([(c,) for c in cigars], "c string").select("c", cigar_positions(F.col("c"), F.lit(0)).alias("p"))
    for r in df.collect():
        assert [None if x < 0 else x for x in accumulate._walk(r.c).tolist()] == r.p
