"""Keys with many distinct maps are settled in arrays, whole keys together, without rounds over tables."""

import random

from pyspark.sql import functions as F
from test_duplicates import SHAPE, library, plain

from methylspark.operators import dedup


def table(spark):
    rng = random.Random(4)
    rows = library(rng, 500, "hot", 40, 0.1) + library(rng, 60, "b", 40, 0.4, 2) + library(rng, 90, None, 5, 0.5) + library(rng, 40, "null", 9, 0.5)
    rows = [(k, *r) for k, r in enumerate(rows)]
    return rows, spark.createDataFrame(rows, SHAPE)


def test_no_rounds(spark, monkeypatch):
    monkeypatch.setattr(dedup, "_first_independent", lambda maps: 1 / 0)
    rows, df = table(spark)
    assert {r.read_id: r.duplicate for r in dedup.mark_duplicates(df, ["key"]).collect()} == plain(rows)


def test_keys_over_several_batches(spark):
    rows, df = table(spark)
    order = [(-F.col(c)).alias(n) for c, n in (("calls", "c"), ("phred", "p"))]
    first = df.select(F.struct("key").alias("_key"), *order, F.col("read_id").alias("id"), "meth", "unmeth")
    size, tasks = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.shuffle.partitions"
    before = {c: spark.conf.get(c) for c in (size, tasks)}
    try:
        spark.conf.set(size, "7")
        spark.conf.set(tasks, "1")
        got = {r.id for r in dedup._settled(first, 20).collect()}
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    assert got == {k for k, d in plain(rows).items() if not d}
