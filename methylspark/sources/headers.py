"""Headers of alignment files: read as tables, merged over inputs, ended by this run's program line."""

from __future__ import annotations

from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from methylspark.sources import bam
from methylspark.sources.text import numbered_lines

#: Sections of a header in their order.
SECTIONS = ["HD", "SQ", "RG", "PG", "CO"]


def tag(name: str, value="value") -> Column:
    """A field of a header line, null where it is absent."""
    return F.nullif(F.regexp_extract(value, rf"\t{name}:([^\t]*)", 1), F.lit(""))


def read_sam_headers(spark: SparkSession, path: str) -> DataFrame:
    """file, n, value: the header lines of SAM texts below ``path``, in order."""
    lines = numbered_lines(spark, path, mark="@").filter(F.col("value").rlike(r"^@[A-Z]{2}(\t|$)"))
    order = Window.partitionBy("file").orderBy("block", "line")
    return lines.select("file", F.row_number().over(order).alias("n"), "value")


def read_bam_headers(spark: SparkSession, path: str) -> DataFrame:
    """file, n, value: the header lines of BAM files below ``path``; contigs that only their dictionary has get a line too.

    Only the first split of a file is looked at, as far as its header goes.
    """
    t = spark.read.option("lineSep", bam.MARK.decode("latin-1")).option("encoding", "ISO-8859-1").option("pathGlobFilter", "*.bam").text(path)
    t = t.filter(F.col("_metadata.file_block_start") == 0).select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("part"))

    def lines(parts):
        buf = bytearray()
        next(parts, None)
        for data in bam.blocks(parts):
            buf += data
            found = bam.header(buf)
            if found:
                text, contigs = found
                out = [x for x in text.split("\n") if x]
                named = {f[3:] for x in out if x.startswith("@SQ") for f in x.split("\t") if f.startswith("SN:")}
                return out + [f"@SQ\tSN:{c}\tLN:{n}" for c, n in contigs if c not in named]
        raise ValueError("a BAM file or its first split ends inside the header")

    def run(batches):
        rows = ((f, p) for b in batches for f, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        for file, own in groupby(rows, lambda r: r[0]):
            found = lines(p for _, p in own)
            for _ in own:  # the rest of the split
                pass
            yield pa.RecordBatch.from_arrays([pa.array([file] * len(found), pa.string()), pa.array(range(1, len(found) + 1), pa.int32()), pa.array(found, pa.string())], ["file", "n", "value"])

    return t.mapInArrow(run, "file string, n int, value string")


def _refuse(message: str, what: Column, when: Column) -> Column:
    return F.when(when, F.raise_error(F.concat(F.lit(f"{message}: "), what)).cast("string"))


def merge_headers(headers: DataFrame, program: str, version: str, command: str, sorted_by: str = "unsorted") -> DataFrame:
    """n, value: one header for the alignments of several files, from their header lines (file, n, value).

    Contigs keep the order of the first file, those that later files add come after them; a contig with two lengths, or
    files that have the contigs they share in different orders, are errors. Read groups and comments are kept once; a
    read group with two descriptions is an error. Programs are kept with their links; where files use one name for
    different ones, later files' names get the file's number. Each chain of programs is ended by a line of this run.
    """
    h = headers.withColumn("kind", F.substring("value", 2, 2))
    files = h.select("file").distinct().withColumn("f", F.row_number().over(Window.orderBy("file")))  # one row a file
    h = h.join(F.broadcast(files), "file")
    first = F.min(F.struct("f", "n", "value"))

    sq = h.filter("kind = 'SQ'").select("f", "n", "value", tag("SN").alias("name"), tag("LN").alias("length"))
    contig = sq.groupBy("name").agg(first.alias("at"), F.min("length").alias("a"), F.max("length").alias("b"))
    clash = _refuse("a contig has two lengths", F.col("name"), F.col("a") != F.col("b"))
    contig = contig.select("name", "at", F.coalesce(clash, F.col("at.value")).alias("line"))
    # contigs that a file shares with earlier ones have to come in the order of these
    shared = sq.join(contig.select("name", "at"), "name").filter(F.col("at.f") < F.col("f"))
    own = Window.partitionBy("f").orderBy("n")
    turned = shared.withColumn("before", F.lag("at").over(own)).filter(F.struct("before.f", "before.n") > F.struct("at.f", "at.n"))
    turned = turned.agg(F.min("name").alias("turned"))
    contig = contig.crossJoin(F.broadcast(turned))  # one row
    clash = _refuse("files have their contigs in different orders", F.col("turned"), F.col("turned").isNotNull())
    out = [contig.select(F.lit(1).alias("s"), F.col("at.f").alias("f"), F.col("at.n").alias("n"), F.coalesce(clash, F.col("line")).alias("value"))]

    rg = h.filter("kind = 'RG'").groupBy(tag("ID").alias("id")).agg(first.alias("at"), F.count_distinct("value").alias("kinds"))
    clash = _refuse("a read group has two descriptions", F.col("id"), F.col("kinds") > 1)
    out.append(rg.select(F.lit(2).alias("s"), "at.f", "at.n", F.coalesce(clash, F.col("at.value")).alias("value")))

    pg = h.filter("kind = 'PG'").select("f", "n", "value", tag("ID").alias("id"), tag("PP").alias("pp"))
    names = pg.groupBy("id").agg(F.count_distinct("value").alias("kinds"), F.min("f").alias("first"))
    several = names.filter("kinds > 1").select("id", "first")
    for c in ("id", "pp"):
        pg = pg.join(several.select(F.col("id").alias(c), F.col("first").alias(f"_{c}")), c, "left")
        pg = pg.withColumn(c, F.when(F.col(f"_{c}") < F.col("f"), F.concat(c, F.lit("."), F.col("f").cast("string"))).otherwise(F.col(c)))
    # fields as they were, names as they are now
    fields = F.transform(F.split("value", "\t"), lambda x: F.when(x.startswith("ID:"), F.concat(F.lit("ID:"), "id")).when(x.startswith("PP:"), F.concat(F.lit("PP:"), "pp")).otherwise(x))
    pg = pg.withColumn("value", F.array_join(fields, "\t")).groupBy("id", "pp", "value").agg(F.min(F.struct("f", "n")).alias("at"))
    out.append(pg.select(F.lit(3).alias("s"), "at.f", "at.n", "value"))
    # a few rows: one for each program that was ever run
    links = pg.select("id", "pp").collect()
    used, ends = {r.id for r in links}, sorted({r.id for r in links} - {r.pp for r in links}) or [None]
    mine = []
    for end in ends:
        name = next(x for k in range(len(links) + len(ends) + 1) if (x := program + (f".{k}" if k else "")) not in used)
        used.add(name)
        mine.append(f"@PG\tID:{name}\tPN:{program}" + (f"\tPP:{end}" if end else "") + f"\tVN:{version}\tCL:{command}")
    co = h.filter("kind = 'CO'").groupBy("value").agg(F.min(F.struct("f", "n")).alias("at"))
    out.append(co.select(F.lit(4).alias("s"), "at.f", "at.n", "value"))
    spark = headers.sparkSession
    more = [(0, 0, 0, f"@HD\tVN:1.6\tSO:{sorted_by}")] + [(3, 2**31 - 1, k, x) for k, x in enumerate(mine)]
    out.append(spark.createDataFrame(more, "s int, f int, n int, value string"))
    every = out[0]
    for x in out[1:]:
        every = every.unionByName(x)
    return every.select((F.row_number().over(Window.orderBy("s", "f", "n")) - 1).alias("n"), "value")  # lines of one header
