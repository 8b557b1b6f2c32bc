"""Methylation calls, mismatch strings, context totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from methylspark.functions.seq import cigar_positions, conversions, has_flag, stored_sequence
from methylspark.operators.accumulate import call_strings, count_letters, mismatch_lines
from methylspark.operators.genome import with_reference


def call_xm() -> Column:
    """Call string of a row with seq, cigar, pos, xg and ref: Z/z CpG, X/x CHG, H/h CHH, upper if methylated.

    Made in arrays over the reads of a batch. Null without seq, cigar or ref.
    """
    return F.arrow_udf(call_strings, StringType())("seq", "cigar", "xg", "ref")


def call_xx() -> Column:
    """struct<xx, nm>: runs of matches and mismatching genome bases; conversions count as matches.

    Inserted and clipped bases are mismatches written as N.
    """
    line = F.arrow_udf(mismatch_lines, StringType())("seq", "cigar", "xm", "ref")
    # the runs of matches are written as numbers in the same task that laid the letters out
    parts = F.split(line, "\t")
    return F.struct(parts[0].alias("xx"), parts[1].cast("int").alias("nm"))


def call_winners(winners: DataFrame, originals: DataFrame, contigs: DataFrame, max_span: int | None = None) -> DataFrame:
    """Chosen alignments with their unconverted reads and calls: adds seq, qual, xr, xg, ref, xm, xx and nm.

    ``winners`` has read_id, mate, src_strand (null: unmapped), chrom, pos, flag and cigar; ``originals`` has
    read_id, mate, seq and qual (array) as sequenced. Reads on the reverse strand are turned and their qualities
    reversed. One join on (read_id, mate). Unmapped reads keep their sequence and have no calls or labels;
    a winner without its read is an error, reads without a winner row are left out.
    """
    key = ["read_id", "mate"]
    # winners are narrow, so they are brought to the genome before their reads are brought to them
    placed = with_reference(winners, contigs, max_span=max_span)
    j = placed.join(originals.select(*key, F.col("seq").alias("_seq"), F.col("qual").alias("_qual")), key, "left")
    lost = F.raise_error(F.concat(F.lit("no original read for "), F.col("read_id").cast("string"))).cast("string")
    xr, xg = conversions(F.col("src_strand"))
    turned = F.when(has_flag(F.col("flag"), 16), F.reverse("_qual")).otherwise(F.col("_qual"))
    seq = F.when(F.col("_seq").isNull(), lost).otherwise(stored_sequence(F.col("_seq"), F.col("flag")))
    r = j.withColumns({"seq": seq, "qual": turned, "xr": xr, "xg": xg}).drop("_seq", "_qual")
    on = F.col("ref").isNotNull() & F.col("xg").isNotNull()
    r = r.withColumn("xm", F.when(on, call_xm())).withColumn("_x", F.when(on, call_xx()))
    return r.withColumns({"xx": F.col("_x.xx"), "nm": F.col("_x.nm")}).drop("_x")


def context_totals(aln: DataFrame) -> DataFrame:
    """One row: methylated calls and all calls of each context over the call strings. Tasks count bytes and pass on a row a letter."""
    n = lambda chars: F.sum(F.when(F.col("letter").isin(*map(ord, chars)), F.col("n")).otherwise(0))
    return count_letters(aln).agg(*[n(c.upper()).alias(f"m_{k}") for k, c in (("cpg", "z"), ("chg", "x"), ("chh", "h"))], *[n(c + c.upper()).alias(f"t_{k}") for k, c in (("cpg", "z"), ("chg", "x"), ("chh", "h"))])
