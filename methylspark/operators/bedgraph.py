"""Operators on per-site tables (chrom, start, n_meth, n_unmeth)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from methylspark.functions.seq import permille, permille_rounded, two_decimals
from methylspark.operators.genome import TILE, cpg_positions, tiles


def with_base(sites: DataFrame, contigs: DataFrame) -> DataFrame:
    """Add ``base``, the genome's base at start: from the strand that ``sign`` tells, else by an equi-join on (chrom, tile)."""
    if "sign" in sites.columns:
        return sites.withColumn("base", F.when(F.col("sign") == "+", "C").otherwise("G"))
    t = tiles(contigs, overlap=0)
    s = sites.withColumn("tile", F.floor(F.col("start") / TILE).cast("int"))
    j = s.join(t.withColumnRenamed("start", "_from"), ["chrom", "tile"])
    return j.withColumn("base", F.upper(F.substring("tile_seq", F.col("start") - F.col("_from") + 1, F.lit(1)))).drop("tile", "tile_seq", "_from")


def _cpg_start():
    return F.when(F.col("base") == "C", F.col("start")).otherwise(F.col("start") - 1)


def merge_cpgs(sites: DataFrame, contigs: DataFrame) -> DataFrame:
    """Both strands of each CpG summed: chrom, start, end, permille, n_meth, n_unmeth."""
    g = with_base(sites, contigs).groupBy("chrom", _cpg_start().alias("start")).agg(F.sum("n_meth").alias("n_meth"), F.sum("n_unmeth").alias("n_unmeth"))
    return g.select("chrom", "start", (F.col("start") + 2).alias("end"), permille(F.col("n_meth"), F.col("n_unmeth")).alias("permille"), "n_meth", "n_unmeth")


def merge_replicates(samples: DataFrame) -> DataFrame:
    """Sites of all samples summed by (chrom, start)."""
    g = samples.groupBy("chrom", "start").agg(F.sum("n_meth").cast("long").alias("n_meth"), F.sum("n_unmeth").cast("long").alias("n_unmeth"))
    return g.withColumn("permille", permille_rounded(F.col("n_meth"), F.col("n_unmeth")))


def matrix(samples: DataFrame, names: list[str], value) -> DataFrame:
    """chrom, start and one column for each sample, 0 where it has no row."""
    return samples.groupBy("chrom", "start").pivot("sample", names).agg(F.sum(value).cast("long")).na.fill(0)


def coverage_histogram(sites: DataFrame, contigs: DataFrame, cap: int = 250) -> DataFrame:
    """bin, n for bins 0 to cap + 1 (more than cap) over every CpG of the genome."""
    merged = with_base(sites, contigs).groupBy("chrom", _cpg_start().alias("start")).agg(F.sum(F.col("n_meth") + F.col("n_unmeth")).alias("cov"))
    cov = cpg_positions(contigs).join(merged, ["chrom", "start"], "left").select(F.least(F.coalesce("cov", F.lit(0)), F.lit(cap + 1)).cast("int").alias("bin"))
    bins = contigs.sparkSession.range(cap + 2).select(F.col("id").cast("int").alias("bin"))
    return bins.join(cov.groupBy("bin").agg(F.count("*").alias("n")), "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def methylkit(sites: DataFrame, contigs: DataFrame) -> DataFrame:
    """chrBase, chr, base (from 1), strand, coverage, freqC, freqT."""
    s = with_base(sites, contigs)
    cov = F.col("n_meth") + F.col("n_unmeth")
    share = lambda c: two_decimals((F.lit(100.0).cast("float") * F.col(c).cast("float") / cov.cast("float")).cast("float").cast("double"), 5)
    one = F.col("start") + 1
    return s.select(F.concat_ws(".", "chrom", one.cast("string")).alias("chrBase"), F.col("chrom").alias("chr"), one.alias("base"), F.when(F.col("base") == "C", "F").otherwise("R").alias("strand"), cov.alias("coverage"), share("n_meth").alias("freqC"), share("n_unmeth").alias("freqT"))


def moabs(sites: DataFrame, contigs: DataFrame) -> DataFrame:
    """One row for each CpG: totals, and those of its plus and minus strand; strand B, + or -."""
    s = with_base(sites, contigs)
    cov, plus = F.col("n_meth") + F.col("n_unmeth"), F.col("base") == "C"
    total = lambda v, c=None: F.coalesce(F.sum(F.when(c, v) if c is not None else v), F.lit(0)).cast("long")
    g = s.groupBy("chrom", _cpg_start().alias("start")).agg(
        total(cov).alias("totalC"), total(F.col("n_meth")).alias("methC"), total(cov, plus).alias("plusTotal"), total(F.col("n_meth"), plus).alias("plusMeth"),
        total(cov, ~plus).alias("minusTotal"), total(F.col("n_meth"), ~plus).alias("minusMeth"), F.count_if(plus).alias("_p"), F.count_if(~plus).alias("_m"),
    )
    strand = F.when((F.col("_p") > 0) & (F.col("_m") > 0), "B").when(F.col("_p") > 0, "+").otherwise("-")
    return g.select("chrom", "start", (F.col("start") + 2).alias("end"), two_decimals(F.try_divide("methC", "totalC"), 4).alias("ratio"), "totalC", "methC", strand.alias("strand"), "plusTotal", "plusMeth", "minusTotal", "minusMeth")


def methylseekr(merged: DataFrame) -> DataFrame:
    """chrom, position (from 1), coverage, n_meth of merged CpGs; raises for rows that are not two wide."""
    ok = F.assert_true(F.col("end") - F.col("start") == 2, "a row is not two bases wide")
    return merged.select("chrom", (F.col("start") + 1).alias("position"), (F.col("n_meth") + F.col("n_unmeth")).alias("coverage"), "n_meth", ok.alias("_ok")).filter("_ok is null").drop("_ok")


def beat(sites: DataFrame) -> DataFrame:
    return sites.select(F.col("chrom").alias("chr"), (F.col("start") + 1).alias("pos"), F.col("n_meth").alias("meth"), F.col("n_unmeth").alias("unmeth"))
