"""Readers of FASTA, SAM, bedGraph and M-bias text, all splittable or one record a file."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def numbered_lines(spark: SparkSession, path: str, mark: str = ">", **options) -> DataFrame:
    """file, block, line, head, value of every line: its number in its split, and that of the last line there that
    begins with ``mark`` (-1 before the first).

    A split is a stretch of a file that one task reads; ``block`` is its place in the file, so (block, line) is the
    order of lines. Lines are numbered batch by batch, with no Python for each of them.
    """
    t = spark.read.text(path, **options)
    t = t.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")

    def run(batches):
        split, line, head = None, 0, -1
        for b in batches:
            if not b.num_rows:
                continue
            files, blocks = b.column(0).dictionary_encode(), b.column(1).to_numpy()
            codes = files.indices.to_numpy()
            fresh = np.r_[True, (codes[1:] != codes[:-1]) | (blocks[1:] != blocks[:-1])]
            starts = np.flatnonzero(fresh)
            at, lines, heads = np.arange(b.num_rows), [], []
            begins = pc.starts_with(b.column(2), mark).to_numpy(zero_copy_only=False)
            for lo, hi in zip(starts, np.r_[starts[1:], b.num_rows]):  # one step for each split in the batch
                now = (files.dictionary[codes[lo]].as_py(), blocks[lo])
                if now != split:
                    split, line, head = now, 0, -1
                own = at[lo:hi] - lo + line
                lines.append(own)
                heads.append(np.maximum.accumulate(np.r_[head, np.where(begins[lo:hi], own, -1)])[1:])
                line, head = own[-1] + 1, heads[-1][-1]
            numbers = [pa.array(np.concatenate(x), pa.int64()) for x in (lines, heads)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *numbers, b.column(2)], ["file", "block", "line", "head", "value"])

    return t.mapInArrow(run, "file string, block long, line long, head long, value string")


def read_fasta(spark: SparkSession, folder: str) -> DataFrame:
    """chrom, ord, length, seq of every .fa and .fasta file below ``folder``, in the order of file names.

    Files are read in splits, so a genome may be one file of any size; a contig is one row and may have up to 2 GB.
    Lines before the first header of a file belong to no contig.
    """
    lines = numbered_lines(spark, folder, pathGlobFilter="*.{fa,fasta}")
    own = F.col("line") == F.col("head")
    text = F.sort_array(F.collect_list(F.when(~own, F.struct("line", "value"))))
    pieces = lines.groupBy("file", "block", "head").agg(F.max(F.when(own, F.col("value"))).alias("title"), F.array_join(F.transform(text, lambda x: x["value"]), "").alias("text"))
    # one narrow row for each contig of each split: a piece without a header goes on with the contig before
    places = lines.select("file", "block", "head").distinct()
    before = Window.partitionBy("file").orderBy("block", "head")
    places = places.withColumn("k", F.sum(F.when(F.col("head") >= 0, 1).otherwise(0)).over(before)).filter("k > 0")
    part = F.struct("block", "head", "text")
    c = pieces.join(places, ["file", "block", "head"]).groupBy("file", "k").agg(F.max("title").alias("title"), F.sort_array(F.collect_list(part)).alias("parts"))
    seq = F.upper(F.regexp_replace(F.array_join(F.transform("parts", lambda x: x["text"]), ""), r"\s", ""))
    c = c.select("file", "k", F.regexp_extract("title", r"^>(\S*)", 1).alias("chrom"), seq.alias("seq"))
    order = places.filter("head >= 0").select("file", "k", (F.row_number().over(Window.orderBy("file", "k")) - 1).alias("ord"))
    return c.join(order, ["file", "k"]).select("chrom", "ord", F.length("seq").alias("length"), "seq")


SAM = ["qname", "flag", "chrom", "pos", "mapq", "cigar", "mate_chrom", "mate_pos", "tlen", "seq", "qual"]


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """Alignments of SAM text: positions from 0, qual as numbers, tags as columns."""
    t = spark.read.text(path).filter(~F.col("value").startswith("@")).select(F.split("value", "\t").alias("f"))
    cols = [F.get("f", F.lit(i)).alias(n) for i, n in enumerate(SAM)]
    tag = lambda n: F.regexp_extract(F.array_join("f", "\t"), rf"\t{n}:[A-Za-z]:([^\t]*)", 1)
    tags = {"as_score": "AS", "xs_score": "XS", "nm": "NM"}
    out = t.select(*cols, *[F.when(tag(v) != "", tag(v).cast("int")).alias(k) for k, v in tags.items()], *[F.nullif(tag(v), F.lit("")).alias(v.lower()) for v in ("XM", "XX", "XR", "XG")])
    ints = {c: F.col(c).cast("int") for c in ("flag", "mapq", "tlen")} | {c: F.col(c).cast("int") - 1 for c in ("pos", "mate_pos")}
    from methylspark.functions.seq import decode_phred

    return out.withColumns(ints | {"qual": decode_phred(F.col("qual"))})


def read_bedgraph(spark: SparkSession, path: str) -> DataFrame:
    """chrom, start, end, permille, n_meth, n_unmeth; track lines are left out."""
    f = spark.read.text(path).filter(~F.col("value").startswith("track")).select(F.split("value", "\t").alias("f"))
    kinds = [("chrom", "string"), ("start", "int"), ("end", "int"), ("permille", "int"), ("n_meth", "bigint"), ("n_unmeth", "bigint")]
    return f.select(*[F.get("f", F.lit(i)).cast(k).alias(n) for i, (n, k) in enumerate(kinds)])


def read_mbias(spark: SparkSession, path: str) -> DataFrame:
    t = spark.read.schema("strand string, read int, position int, n_meth bigint, n_unmeth bigint")
    return t.option("header", "true").option("sep", "\t").option("enforceSchema", "true").csv(path)
