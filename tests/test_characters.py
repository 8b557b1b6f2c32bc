"""Qualities as characters give what numbers give, by columns and by rows."""

import random

import pytest
from pyspark.sql import functions as F

from methylspark.functions.seq import encode_phred, total_phred
from methylspark.operators import accumulate, calling
from methylspark.plans import derive
from methylspark.sources import sinks

SHAPE = "read_id int, chrom string, pos int, cigar string, xg string, strand string, second_mate boolean, seq string, ref string, qual array<int>"


def reads(spark, cigars):
    r = random.Random(7)
    out = []
    for k in range(200):
        ref = "".join(r.choice("ACGTacgtN") for _ in range(14))
        seq = "".join({"C": "T", "G": "A"}.get(c, c) if r.random() < 0.4 else c for c in ref[2:-2].upper())
        xg = r.choice(["CT", "GA"])
        out.append((k, r.choice(["c", "d"]), r.randrange(40), r.choice(cigars), xg, "OT" if xg == "CT" else "OB", r.random() < 0.5, seq, ref, [r.randrange(42) for _ in range(10)]))
    return spark.createDataFrame(out, SHAPE)


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("cigars", [["10M"], ["10M", "2S8M", "4M1I5M"]])
def test_counts_of_characters(spark, cigars):
    numbers = reads(spark, cigars)
    text = numbers.withColumn("qual", encode_phred("qual"))
    bounds = {"OT": (1, 8, 2, 0), "OB": (0, 6, 0, 5)}
    made = [lambda d: accumulate.count_sites(d, 9, bounds=bounds), lambda d: accumulate.count_mbias(d, 9), lambda d: accumulate.call_maps(d, ["read_id"], 9, 1), lambda d: d.select("read_id", total_phred("qual"))]
    for also in (lambda d: d, lambda d: d.withColumn("xm", calling.call_xm())):
        assert all(rows(f(also(numbers))) == rows(f(also(text))) for f in made)
    # one read with a gap among the others sends all of them the general way
    other = numbers.limit(1).withColumn("cigar", F.lit("3M2N7M")).withColumn("read_id", F.lit(-1))
    with_it = numbers.unionByName(other).coalesce(1).withColumn("xm", calling.call_xm()).filter("read_id >= 0")
    assert rows(with_it.select("read_id", "xm")) == rows(numbers.withColumn("xm", calling.call_xm()).select("read_id", "xm"))


def test_derived_characters_and_lines(spark):
    sf = "/root/testdata/sf0.001"
    want, got = derive.windowed(spark, sf), derive.windowed(spark, sf, True)
    assert rows(want.withColumn("qual", encode_phred("qual"))) == rows(got)
    aln = want.limit(20).select(F.col("read_id").cast("string").alias("qname"), "flag", "chrom", "pos", "mapq", "cigar", F.lit("*").alias("mate_chrom"), F.lit(-1).alias("mate_pos"), F.lit(0).alias("tlen"), "seq", "qual")
    assert rows(sinks.sam_lines(aln)) == rows(sinks.sam_lines(aln.withColumn("qual", encode_phred("qual"))))
