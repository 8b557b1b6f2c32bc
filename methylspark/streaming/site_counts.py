"""Counts over a stream of alignments: a delta for each micro-batch, compacted into snapshots."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from methylspark.operators.accumulate import summed_sites

KEY, SUMS = ["context", "chrom", "start"], ["n_meth", "n_unmeth"]


def stream_site_counts(called: DataFrame) -> DataFrame:
    """Counts of a (streaming) DataFrame of calls."""
    return called.groupBy("context", "chrom", F.col("site").alias("start")).agg(F.count_if("methylated").alias("n_meth"), F.count_if(~F.col("methylated")).alias("n_unmeth"))


def file_metrics(aln: DataFrame, min_mapq: int = 10) -> DataFrame:
    """file, strand, reads, kept: how many reads of each input file came on each strand (null: unmapped), and how many
    have ``min_mapq``. Each file has its own row, so its numbers start at nothing and end with it."""
    on = F.col("flag").bitwiseAND(F.lit(4)) == 0
    return aln.groupBy("file", F.when(on, F.col("strand")).alias("strand")).agg(F.count("*").alias("reads"), F.count_if(on & (F.col("mapq") >= min_mapq)).alias("kept"))


class Sums:
    """Additive counts by key in a folder that all executors share.

    ``deltas/batch=<id>`` holds the sums of one micro-batch, ``snapshots/upto=<id>`` those of all batches up to one: the
    watermark. Both are written aside and moved into place by one rename, so a reader sees a whole one or none. A batch that
    is replayed replaces its delta, or is passed over where a snapshot has it. Compacting adds the deltas beyond the watermark to
    the last snapshot and removes what that replaces, so totals read one snapshot and at most ``every`` deltas,
    however long the stream has run.
    """

    def __init__(self, spark: SparkSession, path: str, key: list[str] = KEY, sums: list[str] = SUMS, every: int = 16):
        self.spark, self.path, self.key, self.sums, self.every = spark, path.rstrip("/"), key, sums, every
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for name in ("deltas", "snapshots", "aside"):
            self._fs.mkdirs(self._path(f"{self.path}/{name}"))

    def _ids(self, kind: str) -> list[int]:
        names = [x.getPath().getName() for x in self._fs.listStatus(self._path(f"{self.path}/{kind}"))]
        return sorted(int(n.split("=")[1]) for n in names if "=" in n)

    def watermark(self) -> int:
        """The last batch that a snapshot holds, -1 before the first."""
        return max(self._ids("snapshots"), default=-1)

    def pending(self) -> list[int]:
        """Batches beyond the watermark."""
        done = self.watermark()
        return [n for n in self._ids("deltas") if n > done]

    def _put(self, rows: DataFrame, name: str) -> None:
        aside, to = f"{self.path}/aside/{uuid.uuid4().hex}", self._path(f"{self.path}/{name}")
        rows.write.parquet(aside)
        self._fs.delete(to, True)
        if not self._fs.rename(self._path(aside), to):
            raise OSError(f"{name} could not be moved into place")

    def _summed(self, rows: DataFrame) -> DataFrame:
        if {"chrom", "start"} <= set(self.key):
            return summed_sites(rows, self.key, self.sums)
        return rows.groupBy(*self.key).agg(*[F.sum(c).alias(c) for c in self.sums])

    def _read(self) -> DataFrame | None:
        done = self.watermark()
        parts = [f"{self.path}/deltas/batch={n}" for n in self.pending()] + ([f"{self.path}/snapshots/upto={done}"] if done >= 0 else [])
        return self.spark.read.parquet(*parts).select(*self.key, *self.sums) if parts else None

    def add(self, counts: DataFrame, batch: int) -> None:
        """The counts of one micro-batch; compacts when ``every`` deltas have come together."""
        if batch <= self.watermark():
            return
        self._put(self._summed(counts), f"deltas/batch={batch}")
        if len(self.pending()) >= self.every:
            self.compact()

    def compact(self) -> None:
        """Put the last snapshot and the deltas beyond it together, and remove them."""
        waiting = self.pending()
        if waiting:
            self._put(self._summed(self._read()), f"snapshots/upto={waiting[-1]}")
        done = self.watermark()
        for n in self._ids("deltas"):
            if n <= done:
                self._fs.delete(self._path(f"{self.path}/deltas/batch={n}"), True)
        for n in self._ids("snapshots")[:-1]:
            self._fs.delete(self._path(f"{self.path}/snapshots/upto={n}"), True)

    def totals(self) -> DataFrame | None:
        """Sums over all batches; None before the first."""
        rows = self._read()
        # one snapshot or delta has a row a key already
        one = len(self.pending()) + (self.watermark() >= 0) == 1
        return rows if rows is None or one else self._summed(rows)


def stream_tables(spark: SparkSession, path: str, like: DataFrame, files: int = 8) -> DataFrame:
    """A stream of the Parquet files that arrive under ``path``, with the columns of ``like``, ``files`` for each batch at most."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files).parquet(path)


def run(stream: DataFrame, sinks: list[tuple[Sums, Callable[[DataFrame], DataFrame]]], checkpoint: str):
    """Start a query that adds each micro-batch's counts to each of ``sinks`` and ends when no files are left."""

    def add(batch: DataFrame, number: int) -> None:
        # read once for all sinks; nothing is kept beyond the batch
        held = batch.persist() if len(sinks) > 1 else batch
        try:
            for sums, count in sinks:
                sums.add(count(held), number)
        finally:
            held.unpersist()

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def write_deltas(called: DataFrame, path: str, checkpoint: str, every: int = 16):
    """Start a query that adds up a stream of calls under ``path``."""
    return run(called, [(Sums(called.sparkSession, path, every=every), stream_site_counts)], checkpoint)


def totals(spark: SparkSession, path: str) -> DataFrame:
    return Sums(spark, path).totals()
