"""Genome tables: tiles, context windows, CpG positions, restriction digest."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType
from pyspark.sql.window import Window

from methylspark.functions.seq import cigar_positions, has_flag, reference_span

TILE, OVERLAP = 8192, 1024
#: A tile with more than one of so many reads is hot.
HOT_TILES = 1000
_UPPER = np.arange(256, dtype=np.uint8)
_UPPER[97:123] -= 32


def tiles(contigs: DataFrame, tile: int = TILE, overlap: int = OVERLAP) -> DataFrame:
    """chrom, tile, start, tile_seq: pieces of contigs with ``overlap`` more bases on both sides.

    Bases are ASCII, so tiles are cut from the contig's bytes: each costs its own length, wherever it lies.
    """
    raw = contigs.select("chrom", F.col("seq").cast("binary").alias("_b"))
    n = F.greatest(F.ceil(F.octet_length("_b") / tile).cast("int"), F.lit(1))
    t = raw.select("chrom", "_b", F.explode(F.sequence(F.lit(0), n - 1)).alias("tile"))
    start = F.greatest(F.col("tile") * tile - overlap, F.lit(0))
    end = F.col("tile") * tile + tile + overlap
    return t.select("chrom", "tile", start.alias("start"), F.substring(F.col("_b"), start + 1, end - start).cast("string").alias("tile_seq"))


def _is_mapped(aln: DataFrame) -> Column:
    placed = F.col("chrom").isNotNull() & F.col("pos").isNotNull()
    return placed & ~F.coalesce(has_flag(F.col("flag"), 4), F.lit(False)) if "flag" in aln.columns else placed


def _span(on) -> Column:
    """Reference bases that an alignment covers, 0 for unmapped reads."""
    simple = F.regexp_extract("cigar", r"^(\d+)M$", 1)
    return F.when(on, F.when(simple != "", F.expr("try_cast(regexp_extract(cigar, '^([0-9]+)M$', 1) as int)")).otherwise(reference_span(F.col("cigar")))).otherwise(0)


def _window(s, offset, on) -> Column:
    """From a stretch ``s`` of the genome that begins at ``offset``: two bases before ``pos`` to two after ``_span`` bases."""
    lost = F.raise_error(F.concat(F.lit("an alignment lies outside the genome: "), F.col("chrom"), F.lit(":"), F.col("pos").cast("string"))).cast("string")
    at = F.col("pos") - offset  # index of pos in s
    # bytes are cut at their own cost, wherever they lie; a window that begins before s is filled up with N
    raw = s.cast("binary")
    whole = F.substring(raw, at - 1, F.col("_span") + 4).cast("string")
    cut = F.substring(raw, F.greatest(at - 1, F.lit(1)), F.col("_span") + 4 - F.greatest(2 - at, F.lit(0))).cast("string")
    cut = F.when(at >= 2, cut).otherwise(F.concat(F.repeat(F.lit("N"), F.least(2 - at, F.lit(2))), cut))
    # filling up looks at each base, so only windows that reach over an end are
    inside = (at >= 2) & (at + F.col("_span") + 2 <= F.octet_length(s))
    return F.when(on, F.when(s.isNull(), lost).when(inside, whole).otherwise(F.rpad(cut, F.col("_span") + 4, "N")))


def with_reference(aln: DataFrame, contigs: DataFrame, tile: int = TILE, overlap: int = OVERLAP, max_span: int | None = None, spread: bool = False, deal: int | None = None) -> DataFrame:
    """Add ``ref``: reference bases from two before ``pos`` to two after the alignment, N beyond the contig.

    An equi-join on (chrom, tile); alignments that reach over a tile's margin are joined to whole contigs.
    ``max_span`` says that no alignment covers more reference bases: the alignments are then read once and
    not joined to whole contigs, and a longer one raises an error. It may be ``overlap - 4`` at most.
    Unmapped reads (flag 4, or no contig or position) stay, with ``ref`` null; a mapped read whose place is
    not in the genome raises an error. ``spread`` is for libraries that pile up on few tiles, such as amplicons: reads are
    counted first, tiles with more than one of HOT_TILES of all reads (fewer than that, 10 KB each) reach theirs by
    broadcast, and these reads are dealt evenly over the join that serves all others. ``deal`` brings the reads of each tile into
    one of so many tasks, also where the genome is broadcast, so that counts by site made in these tasks hardly overlap; choose it
    where alignments are narrow and not piled up.
    """
    if max_span is not None and max_span > overlap - 4:
        raise ValueError("max_span must be at most overlap - 4")
    on = F.col("_on")
    a = aln.withColumn("_on", _is_mapped(aln)).withColumns({"_span": _span(on), "tile": F.when(on, F.floor(F.col("pos") / tile).cast("int"))})
    window = lambda s, offset: _window(s, offset, on)
    t = tiles(contigs, tile, overlap)
    if max_span is None:
        short = a.filter(F.col("_span") <= overlap - 4)
    else:
        too_long = F.raise_error(F.concat(F.lit(f"an alignment covers more than {max_span} bases: "), F.col("_span").cast("string")))
        short = a.withColumn("_span", F.when(F.col("_span") > max_span, too_long.cast("int")).otherwise(F.col("_span")))
    if deal:
        short = short.repartition(deal, "chrom", "tile")
    if spread:
        sizes = a.filter(on).groupBy("chrom", "tile").agg(F.count("*").alias("_n"))
        total = sizes.agg(F.sum("_n")).first()[0] or 0
        piled = F.broadcast(sizes.filter(F.col("_n") * HOT_TILES > total).select("chrom", "tile"))
        hot = F.broadcast(t.join(piled, ["chrom", "tile"]).select("chrom", "tile", F.struct("start", "tile_seq").alias("_hot")))
        cold = t.select(F.col("chrom").alias("_chrom"), F.col("tile").alias("_tile"), F.struct("start", "tile_seq").alias("_cold"))
        own = F.when(on & F.col("_hot").isNull(), F.col("tile")).otherwise(-1 - F.abs(F.xxhash64(F.monotonically_increasing_id()) % (1 << 20)).cast("int"))
        met = short.join(hot, ["chrom", "tile"], "left").withColumn("_own", own)
        met = met.join(cold, (F.col("chrom") == F.col("_chrom")) & (F.col("_own") == F.col("_tile")), "left")
        found = met.withColumn("_at", F.coalesce("_hot", "_cold")).drop("_hot", "_cold", "_own", "_chrom", "_tile")
        near = found.withColumn("ref", window(F.col("_at.tile_seq"), F.col("_at.start"))).drop("_at")
    else:
        near = short.join(t, ["chrom", "tile"], "left").withColumn("ref", window(F.col("tile_seq"), F.col("start"))).drop("tile_seq", "start")
    if max_span is not None:
        return near.drop("tile", "_span", "_on")
    whole = contigs.select("chrom", F.col("seq").alias("_contig"))
    far = a.filter(F.col("_span") > overlap - 4).join(whole, "chrom", "left").withColumn("ref", window(F.col("_contig"), F.lit(0))).drop("_contig")
    return near.unionByName(far).drop("tile", "_span", "_on")


def read_positions() -> Column:
    return cigar_positions(F.col("cigar"), F.col("pos"))


def motif_positions(contigs: DataFrame, motifs: list[str], tile: int = TILE) -> DataFrame:
    """chrom, start of every place of ``motifs`` (all of one length), found inside tiles that share its letters with the next."""
    width = len(motifs[0])
    t = tiles(contigs, tile, width - 1)
    own = F.col("tile") * tile

    def places(pieces: pa.Array) -> pa.Array:
        out = []
        for raw in pieces:
            b = raw.as_buffer()
            letters = _UPPER[np.frombuffer(b, np.uint8)] if b is not None else _UPPER[:0]
            n = min(len(letters) - (width - 1), tile)
            on = np.zeros(max(n, 0), bool)
            for m in motifs if n > 0 else ():
                on |= np.logical_and.reduce([letters[k : k + n] == ord(c) for k, c in enumerate(m)])
            out.append(np.flatnonzero(on).astype(np.int32))
        return pa.array(out, pa.list_(pa.int32()))

    # a place on the border belongs to the tile of its first base
    bytes_ = t.select("chrom", own.alias("own"), F.substring(F.col("tile_seq").cast("binary"), own - F.col("start") + 1, F.lit(tile + width - 1)).alias("_b")).filter(F.octet_length("_b") >= width)
    found = F.arrow_udf(places, ArrayType(IntegerType()))
    return bytes_.select("chrom", "own", F.explode(found("_b")).alias("k")).select("chrom", (F.col("own") + F.col("k")).cast("int").alias("start"))


def cpg_positions(contigs: DataFrame) -> DataFrame:
    """chrom, start of every CG of the genome."""
    return motif_positions(contigs, ["CG"])


#: What each enzyme recognises.
CUTS = {"MspI": "CCGG", "TaqI": "TCGA"}


def restriction_sites(contigs: DataFrame, enzymes: tuple[str, ...] = ("MspI", "TaqI")) -> DataFrame:
    """chrom, start of every place where one of the enzymes cuts."""
    return motif_positions(contigs, [CUTS[e] for e in enzymes])


SITES = {"MspI": "(?<=C)(?=CGG)", "TaqI": "(?<=T)(?=CGA)"}


def digest(contigs: DataFrame, enzymes: tuple[str, ...] = ("MspI", "TaqI")) -> DataFrame:
    """chrom, k, fragment: contigs cut before CGG of CCGG (MspI) and before CGA of TCGA (TaqI)."""
    cut = F.split(F.upper("seq"), "|".join(SITES[e] for e in enzymes))
    return contigs.select("chrom", F.posexplode(cut).alias("k", "fragment"))


def mask_fragment(fragment, read_length: int = 36) -> Column:
    """A fragment with N where no read of ``read_length`` from either end reaches (a tenth longer)."""
    r = int(read_length * 1.1)
    n = F.length(fragment)
    masked = F.concat(F.substring(fragment, 1, r), F.repeat(F.lit("N"), n - 2 * r), F.substring(fragment, n - r + 1, F.lit(r)))
    return F.when(n - 1 - r > r, masked).otherwise(fragment)


def reduced_genome(contigs: DataFrame, read_length: int = 36, enzymes: tuple[str, ...] = ("MspI", "TaqI")) -> DataFrame:
    """chrom, seq: contigs with fragment interiors masked."""
    cut = F.split(F.upper("seq"), "|".join(SITES[e] for e in enzymes))
    return contigs.select("chrom", F.array_join(F.transform(cut, lambda f: mask_fragment(f, read_length)), "").alias("seq"))


def position_numbers(rows: DataFrame, order: list[str], chrom: str = "chrom", pos: str = "pos", width: int = 1024) -> DataFrame:
    """Add ``n``: each row's number from 1 in the order of contig, position and then ``order``.

    Rows are numbered within stretches of ``width`` positions and moved up by the rows of the stretches
    before, which are counted: no task sorts a whole contig. Null positions come first in their contig.
    """
    bin_ = F.floor(F.col(pos) / width)
    binned = rows.withColumn("_bin", F.coalesce(bin_, F.lit(-(1 << 40))))
    sizes = binned.groupBy(chrom, "_bin").agg(F.count("*").alias("_c"))
    within = Window.partitionBy(chrom).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.withColumn("_b", F.coalesce(F.sum("_c").over(within), F.lit(0)))
    contig = sizes.groupBy(chrom).agg(F.sum("_c").alias("_c"))
    earlier = Window.orderBy(chrom).rowsBetween(Window.unboundedPreceding, -1)  # one row a contig
    contig = contig.select(F.col(chrom).alias("_chrom"), F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_a"))
    before = before.join(contig, F.col(chrom).eqNullSafe(F.col("_chrom"))).select(F.col(chrom).alias("_chrom"), F.col("_bin").alias("_at"), (F.col("_a") + F.col("_b")).alias("_b"))
    own = F.row_number().over(Window.partitionBy(chrom, "_bin").orderBy(pos, *order))
    numbered = binned.withColumn("_own", own)
    same = F.col(chrom).eqNullSafe(F.col("_chrom")) & (F.col("_bin") == F.col("_at"))
    return numbered.join(before, same).withColumn("n", F.col("_own") + F.col("_b")).drop("_bin", "_own", "_chrom", "_at", "_b")
