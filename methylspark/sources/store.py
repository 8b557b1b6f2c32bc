"""Alignments and the genome stored by place: joined, counted and read by region without moving them."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from methylspark.operators.genome import OVERLAP, TILE, _is_mapped, _span, _window, tiles

ALIGNMENTS, GENOME, LAYOUT = "alignments", "genome", "layout"


@dataclass(frozen=True)
class Store:
    """An open store: tables of alignments and of genome tiles, both in buckets by ``bin`` (contig and tile)."""

    spark: SparkSession
    alignments: DataFrame
    genome: DataFrame
    tile: int
    longest: int


def _bin(chrom, tile) -> F.Column:
    return F.concat(chrom, F.lit(":"), tile.cast("string"))


def write_store(aln: DataFrame, contigs: DataFrame, path: str, buckets: int, tile: int = TILE, finish: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Write alignments and genome under ``path`` in ``buckets`` buckets each, sorted by place inside them.

    Each bucket is one file, made by one task, so choose a number that leaves some hundred MB for each. A read goes to
    the tile where it begins; unmapped reads have no tile and are dealt over the buckets. An alignment that covers more than
    the margin of a tile is an error. The columns ``bin`` and ``tile`` are added.

    ``finish`` adds columns that follow from a row and its ``ref``: it gets the rows when they are in the tasks that write them,
    with ``ref`` from the stored genome, so that what it adds is never shuffled. It must leave rows where they are and keep
    ``bin``, ``tile`` and ``pos``; ``ref`` is not stored.
    """
    spark = aln.sparkSession
    on = _is_mapped(aln)
    t = F.floor(F.col("pos") / tile).cast("int")
    spare = F.concat(F.lit("?"), (F.monotonically_increasing_id() % buckets).cast("string"))
    placed = aln.withColumn("_span", _span(on))
    long = F.raise_error(F.concat(F.lit(f"an alignment covers more than {OVERLAP - 4} bases: "), F.col("_span").cast("string"))).cast("string")
    bin_ = F.when(~on, spare).when(F.col("_span") > OVERLAP - 4, long).otherwise(_bin(F.col("chrom"), t))
    placed = placed.withColumns({"bin": bin_, "tile": F.when(on, t)}).drop("_span")
    pieces = tiles(contigs, tile).withColumn("bin", _bin(F.col("chrom"), F.col("tile")))
    # what a task holds is one bucket, by the rule that the writer follows
    genome = _save(pieces.repartition(buckets, "bin").sortWithinPartitions("bin"), f"{path}/{GENOME}", GENOME, buckets)
    rows = placed.repartition(buckets, "bin")
    if finish:
        rows = finish(_met(rows, spark.table(genome)).sortWithinPartitions("bin", "pos")).drop("ref")
    else:
        rows = rows.sortWithinPartitions("bin", "pos")
    _save(rows, f"{path}/{ALIGNMENTS}", ALIGNMENTS, buckets)
    shapes = [spark.createDataFrame([], df.schema)._jdf.schema().toDDL() for df in (rows, pieces)]
    layout = {"buckets": buckets, "tile": tile, "longest": OVERLAP - 4, "alignments": shapes[0], "genome": shapes[1]}
    spark.range(1).select(*[F.lit(v).alias(k) for k, v in layout.items()]).coalesce(1).write.parquet(f"{path}/{LAYOUT}")


def _save(df: DataFrame, path: str, name: str, buckets: int) -> str:
    """Write a table under ``path`` from sorted tasks that hold a bucket each; its name in this session."""
    table = f"{name}_{uuid.uuid4().hex}"
    conf, option = df.sparkSession.conf, "spark.sql.maxConcurrentOutputFileWriters"
    before = conf.get(option)
    # with files open side by side Spark takes rows as they come; its own sort hashes ``bin`` at each comparison
    conf.set(option, "2")
    try:
        df.write.bucketBy(buckets, "bin").option("compression", "zstd").option("path", path).saveAsTable(table)
    finally:
        conf.set(option, before)
    return table


def open_store(spark: SparkSession, path: str) -> Store:
    """The store under ``path``, in any session: Spark is told how its files are dealt and sorted."""
    layout = spark.read.parquet(f"{path}/{LAYOUT}").first()
    frames = []
    for name, order in ((ALIGNMENTS, "bin, pos"), (GENOME, "bin")):
        table = f"{name}_{uuid.uuid4().hex}"
        spark.sql(f"create table {table} ({layout[name]}) using parquet clustered by (bin) sorted by ({order}) into {layout.buckets} buckets location '{path}/{name}'")
        frames.append(spark.table(table))
    return Store(spark, *frames, layout.tile, layout.longest)


def referenced(store: Store, aln: DataFrame | None = None) -> DataFrame:
    """Alignments with ``ref``, as ``genome.with_reference`` adds it; a join of buckets, without a shuffle.

    ``aln`` are rows of the store's alignments, filtered as one likes.
    """
    return _met(store.alignments if aln is None else aln, store.genome)


def _met(rows: DataFrame, genome: DataFrame) -> DataFrame:
    """Rows in buckets with ``ref`` from the genome's tiles in theirs."""
    on = _is_mapped(rows)
    near = rows.withColumn("_span", _span(on)).join(genome.select("bin", F.col("start").alias("_start"), "tile_seq"), "bin", "left")
    return near.withColumn("ref", _window(F.col("tile_seq"), F.col("_start"), on)).drop("_span", "_start", "tile_seq")


def region(store: Store, chrom: str, start: int, end: int) -> DataFrame:
    """Alignments that cover any of the bases [start, end) of a contig; only buckets of its tiles are read."""
    first, last = max(start - store.longest, 0) // store.tile, max(end - 1, 0) // store.tile
    near = store.alignments.filter(F.col("bin").isin([f"{chrom}:{t}" for t in range(first, last + 1)]))
    on = _is_mapped(near)
    return near.filter(on & (F.col("pos") < end) & (F.col("pos") + _span(on) > start))
