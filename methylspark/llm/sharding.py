"""Sharding by rendezvous hashing of stable keys over weighted shards, in Spark SQL functions only (operator 13)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import crc_sql, materialize, partitions, table

#: Shards of the registered query, all of one weight, and how many there are once it has grown.
SHARDS = 16
#: Bits of a key's hash that make its draw for a shard: as many as a double holds.
BITS = 52


def draw(key: Column, shard: Column) -> Column:
    """A number above 0 and below 1 that only the key and the shard's number decide."""
    digits = F.substring(F.md5(F.encode(F.concat(shard.cast("string"), F.lit(":"), key), "utf-8")), 1, BITS // 4)
    return (F.conv(digits, 16, 10).cast("long") + 0.5) / float(1 << BITS)


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard (from 0) of a key: that with the greatest ln(draw) / weight, the smallest number of equals.

    A shard gets keys in proportion to its weight. Draws of other shards do not depend on how many there are, so a
    shard that is added, or whose weight grows, only takes keys, and one that goes only gives up its own. The key
    is taken as text, null as empty text. A shard of weight 0 gets nothing; there must be one above 0.
    """
    if not any(w > 0 for w in weights) or min(weights) < 0:
        raise ValueError("weights must be 0 or more, and one of them above 0")
    text = F.coalesce(key.cast("string"), F.lit(""))
    live = F.array(*[F.struct(F.lit(k).alias("shard"), F.lit(float(w)).alias("weight")) for k, w in enumerate(weights) if w > 0])
    bids = F.transform(live, lambda s: F.struct((F.ln(draw(text, s["shard"])) / s["weight"]).alias("bid"), (-s["shard"]).alias("neg")))
    return (-F.array_max(bids)["neg"]).cast("int")


def with_slots(placed: DataFrame, key: str) -> DataFrame:
    """Add ``slot``: numbers from 0 without gaps inside each shard, in the order of ``key`` and then of ``uid``.

    ``placed`` is a written table in which ``uid`` is unique. Rows are sorted over all tasks by (shard, key, uid), so a
    shard, or a key that many rows share, is spread over as many tasks as its rows need, and the sorted rows are written
    with their numbers. What is brought to them is one row for each stretch of a shard in a task: at most as many as
    tasks and shards together.
    """
    spark = placed.sparkSession
    by = [F.col("shard"), F.col(key), F.col("uid")]
    rows = placed.repartitionByRange(partitions(spark), *by).sortWithinPartitions(*by)
    rows = materialize(rows.withColumn("_at", F.monotonically_increasing_id()), "slots").withColumn("_task", F.shiftright("_at", 33))
    runs = rows.groupBy("_task", "shard").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    earlier = Window.partitionBy("shard").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    before = runs.select("_task", "shard", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    slot = F.col("_before") + F.col("_at") - F.col("_first")
    return rows.join(F.broadcast(before), ["_task", "shard"]).withColumn("slot", slot).drop("_task", "_first", "_before", "_at")


def assign(docs: DataFrame, weights: Sequence[float], grown: Sequence[float] | None = None, key: str = "doc_id") -> DataFrame:
    """doc (a struct of all columns), shard, slot and, where ``grown`` gives weights, grown_shard for each row.

    Equal keys share a shard, null keys have one too, repeated rows get slots of their own; an empty table gives an
    empty result. ``docs`` is written once in the shared folder with each row's number, so a task that runs again
    numbers its rows alike; slots of unique keys do not depend on how the table is stored.
    """
    k = F.col(f"doc.{key}")
    places = {"shard": rendezvous(k, weights)} | ({"grown_shard": rendezvous(k, grown)} if grown else {})
    held = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"))
    held = held.withColumn("uid", F.monotonically_increasing_id()).withColumns(places)
    return with_slots(materialize(held, "shards"), f"doc.{key}").drop("uid")


def moves(assigned: DataFrame) -> DataFrame:
    """shard, grown_shard, rows: how many rows stay and how many go where when the shards grow."""
    return assigned.groupBy("shard", "grown_shard").agg(F.count("*").alias("rows"))


def write_shards(assigned: DataFrame, path: str, rows_per_file: int = 100_000) -> None:
    """Parquet folders ``shard=<n>`` of the documents with their slots; a file holds a stretch of slots, in order.

    Rows meet by (shard, stretch), so a shard of any size is written by many tasks.
    """
    stretch = F.expr(f"slot div {rows_per_file}")
    out = assigned.withColumn("_stretch", stretch).repartition("shard", "_stretch").sortWithinPartitions("shard", "_stretch", "slot")
    out.select("shard", "slot", "doc").write.partitionBy("shard").option("maxRecordsPerFile", rows_per_file).parquet(path)


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every document.

    The law is ``key``: doc_id and the number of shards decide. Size is the UTF-8 bytes of the text plus 1, 1 for null
    and empty texts, whose crc32 is 0. A null doc_id counts as empty text. Equal texts are no unit here: copies go
    where their own doc_id goes. Repeated rows share their shard and have slots of their own.
    """
    raw = F.coalesce(F.encode(F.col("text").cast("string"), "utf-8"), F.lit(b""))
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    out = assign(docs, [1.0] * SHARDS, [1.0] * (SHARDS + 1))
    return out.select("doc.doc_id", "doc.size", "doc.text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def _bids(n: int) -> str:
    return "[" + ", ".join(f"('0x' || substr(md5('{k}:' || id), 1, {BITS // 4}))::bigint" for k in range(n)) + "]"


#: Of shards of one weight, that with the greatest draw.
OP13_SQL = f"""
select doc_id, size, text_crc32, 'key' as law, shard, row_number() over (partition by shard order by doc_id nulls first) - 1 as slot, grown_shard from (
select doc_id, octet_length(encode(t))::bigint + 1 as size, {crc_sql('t')}::bigint as text_crc32, (list_position(a, list_max(a)) - 1)::int as shard, (list_position(b, list_max(b)) - 1)::int as grown_shard
from (select doc_id, t, {_bids(SHARDS)} as a, {_bids(SHARDS + 1)} as b from (select doc_id, coalesce(text, '') as t, coalesce(doc_id::varchar, '') as id from documents)))
"""
