"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read with Spark so that any store Spark can open works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession, label: str) -> str:
    """A new folder below ``spark.checkpoint.dir``.

    Where that setting is absent, a local session gets a temporary folder; on a cluster this raises,
    because executors cannot see each other's local folders.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-llm-")
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared work folder and read it again (cuts lineage durably)."""
    spark = df.sparkSession
    path = work_dir(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder of the shared store that is not needed any more."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batch: pa.RecordBatch, column: str, budget: int = 2_000_000):
    """Split a batch into runs of rows whose ``column`` (binary) holds about ``budget`` bytes together.

    A single longer value forms a run of its own, so work arrays stay bounded by one document.
    """
    col = batch.column(batch.schema.get_field_index(column))
    sizes = [0 if v is None else v for v in pc.binary_length(col).to_pylist()]
    start = held = 0
    for i, n in enumerate(sizes):
        if i > start and held + n > budget:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if len(sizes) > start:
        yield batch.slice(start)


def text_bytes(docs: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """``keep`` columns and the text as UTF-8 bytes in ``_b`` (null stays null)."""
    return docs.select(*[docs[c] for c in keep], docs[text].cast("string").cast("binary").alias("_b"))


def named(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def crc_bucket(col) -> F.Column:
    """crc32 of a value's text."""
    return F.crc32(F.encode(col.cast("string"), "utf-8"))


def attach(rows: DataFrame, values: DataFrame, key: str, value: str, count: str, share: int = 1000) -> DataFrame:
    """``rows`` with ``value`` of their ``key`` (null without one); ``values`` has one row a key and its number of rows.

    Keys with more than a ``share``-th of all rows, of which there can only be fewer than ``share``, reach
    the rows by broadcast, and such rows are dealt evenly over the join that serves all other keys. So no
    task gathers the rows of a hot key.
    """
    total = values.agg(F.sum(count)).first()[0] or 0
    frequent = F.col(count) * share > total
    held = F.struct(F.col(value).alias("v"))
    hot = values.filter(frequent).select(F.col(key), held.alias("_hot"))
    cold = values.filter(~frequent).select(F.col(key).alias("_cold_key"), held.alias("_cold"))
    spread = F.xxhash64(F.monotonically_increasing_id()).cast(values.schema[key].dataType)
    dealt = F.when(F.col("_hot").isNotNull() | F.col(key).isNull(), spread).otherwise(F.col(key))
    out = rows.join(F.broadcast(hot), key, "left").withColumn("_dealt", dealt)
    # a row dealt evenly may meet another key's value: its own comes first, and null keys have none
    cold_value = F.when(F.col(key).isNotNull(), F.col("_cold"))
    out = out.join(cold, F.col("_dealt") == F.col("_cold_key"), "left").withColumn(value, F.coalesce("_hot", cold_value)["v"])
    return out.drop("_hot", "_cold", "_cold_key", "_dealt")


def salted_join(rows: DataFrame, values: DataFrame, key: str, share: int = 1000) -> DataFrame:
    """Inner join of ``rows`` with ``values`` on ``key``, with hot keys of ``rows`` dealt over several tasks.

    A key with more than a ``share``-th of all rows gets a salt for each such part. Its rows are dealt over the
    salts, its values are copied to each. Fewer than ``share`` keys are hot and all their salts together number
    fewer than twice ``share``, so only this list is broadcast, never a value. ``rows`` is read twice:
    give a written table. Null keys join with nothing.
    """
    counted = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
    total = rows.count()
    hot = counted.filter(F.col("_n") * share > total).select(key, F.ceil(F.col("_n") * share / F.lit(max(total, 1))).cast("int").alias("_salts"))
    dealt = F.when(F.col("_salts").isNull(), 0).otherwise(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("_salts")).cast("int"))
    left = rows.join(F.broadcast(hot), key, "left").withColumn("_salt", dealt).drop("_salts")
    salts = F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))
    right = values.join(F.broadcast(hot), key, "left").withColumn("_salt", salts).drop("_salts")
    return left.join(right, [key, "_salt"]).drop("_salt")


def numbered(docs: DataFrame, label: str) -> DataFrame:
    """uid and doc (a struct of all columns), written once, so that rows can be told apart by number."""
    return materialize(docs.select(F.monotonically_increasing_id().alias("uid"), F.struct(*[docs[c] for c in docs.columns]).alias("doc")), label)


def crc_sql(text: str) -> str:
    """DuckDB SQL of the unsigned crc32 of a text's UTF-8 bytes: half a byte a step, by a table of 16 made here."""
    steps = []
    for n in range(16):
        for _ in range(4):
            n = (n >> 1) ^ (0xEDB88320 if n & 1 else 0)
        steps.append(n)
    half = lambda c: f"xor({c} >> 4, ({steps})[({c} & 15) + 1]::bigint)"
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda b: ('0x' || b)::bigint)"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, {octets}), lambda c, x: {half(half('xor(c, x)'))}), 4294967295)"
