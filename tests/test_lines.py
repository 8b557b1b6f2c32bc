"""Letters counted, turned and written as lines in arrays, against plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from methylspark.functions import seq
from methylspark.operators import accumulate, calling

def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_totals_are_counted_in_tasks(spark):
    r = random.Random(2)
    texts = ["".join(r.choice("zZxXhH..N") for _ in range(r.randrange(70))) for _ in range(300)] + [None, "", "ü.z"]
    df = spark.createDataFrame([(t,) for t in texts], "xm string").repartition(3)
    got = calling.context_totals(df)
    every = "".join(t or "" for t in texts)
    assert got.first().asDict() == {f"{k}_{n}": sum(every.count(x) for x in (c.upper(), *(c if k == "t" else ""))) for k in "mt" for n, c in (("cpg", "z"), ("chg", "x"), ("chh", "h"))}
    assert "translate" not in plan(got)
    assert set(calling.context_totals(df.filter("xm is null")).first()) == {None}


def turned(t):
    return None if t is None else re.sub("[^ACGT]", "N", t.upper())[::-1].translate(str.maketrans("ACGT", "TGCA"))


@pytest.mark.parametrize("odd", [[], [None, "", "AN-acgtnx"], ["AüC", None]])
def test_turned_sequences(spark, odd):
    r = random.Random(3)
    texts = ["".join(r.choice("ACGTN") for _ in range(12)) for _ in range(60)] + odd
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = df.select("k", seq.reverse_complement(F.col("t")).alias("t"))
    assert "translate" not in plan(got) and {x.k: x.t for x in got.collect()} == {k: turned(t) for k, t in enumerate(texts)}
    assert df.filter("t is null").select(seq.reverse_complement("t")).count() == sum(t is None for t in texts)


@pytest.mark.parametrize("sizes", [[0, 1, 5, 130], [40]])
def test_mismatch_lines_without_a_loop_over_reads(spark, sizes):
    r = random.Random(4)
    rows, want = [], []
    for k in range(400):
        n = r.choice(sizes)
        ref = "".join(r.choice("ACGT") for _ in range(n))
        bases = "".join(b if r.random() < 0.9 else r.choice("ACGTN") for b in ref)
        xm = "".join("h" if r.random() < 0.1 else "." for _ in range(n))
        marks = "".join("=" if a == b or c != "." else b for a, b, c in zip(bases, ref, xm))
        line = ("" if marks[:1] in ("", "=") else "0") + re.sub("=+", lambda m: str(len(m[0])), marks)
        rows.append((k, bases, f"{n}M", xm, f"NN{ref}NN", 3))
        want.append((line, n - marks.count("=")))
    if len(sizes) > 1:
        rows.append((400, "AC", "2M", None, "NNACNN", 3))
        want.append((None, None))
    df = spark.createDataFrame(rows, "k int, seq string, cigar string, xm string, ref string, pos int")
    got = {x.k: (x.x.xx, x.x.nm) for x in df.select("k", calling.call_xx().alias("x")).collect()}
    assert got == dict(enumerate(want))
    assert not hasattr(accumulate, "_RUN")
