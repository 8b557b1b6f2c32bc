"""SimHash near-duplicates: fingerprints, segment-popcount embedding, grid join, components (operator 9)."""

from __future__ import annotations

import math
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attach, materialize, named, numbered, table, text_bytes
from .components import connected_components


def fingerprint(text: bytes | None, width: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of a UTF-8 text: A-Z lower-cased, words split at ASCII white space, word shingles."""
    words = text.lower().split() if text else []  # bytes.lower/split touch ASCII only
    if not words:
        return 0
    buf = b" ".join(words)
    if len(words) <= width:
        hashes = [xxhash.xxh64_intdigest(buf, seed)]
    else:
        ends = list(accumulate(len(w) + 1 for w in words))
        starts = [0, *ends[:-width]]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(buf[s : e - 1], seed) for s, e in zip(starts, ends[width - 1 :])]
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 65536):
        part = np.array(hashes[k : k + 65536], "<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(counts * 2 > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """(id, fp): one signed 64-bit fingerprint a row; null and empty texts give 0."""

    def run(batches):
        for b in batches:
            fps = pa.array([fingerprint(t, width) for t in named(b, "_b").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([named(b, id_col), fps], names=[id_col, "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return text_bytes(docs, id_col, text=text).mapInArrow(run, f"`{id_col}` {kind}, fp bigint")


#: Every even bit.
EVEN = 0x5555555555555555


def embed(fp) -> F.Column:
    """Counts of set bits in the 32 two-bit segments, each in unary (0, 01, 11).

    The Manhattan distance of two count vectors is then the number of differing bits of two codes, and it
    never exceeds the Hamming distance of the fingerprints.
    """
    low, high = fp.bitwiseAND(F.lit(EVEN)), F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(EVEN))
    return low.bitwiseOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def grid_masks(max_distance: int, spare: int) -> list[int]:
    """Masks of grid cells: segments in ``max_distance + spare`` groups, any ``spare`` of them kept.

    Count vectors within Manhattan distance d differ in d groups at most, so they share at least one cell.
    """
    groups = max_distance + spare
    edges = [round(32 * g / groups) for g in range(groups + 1)]
    group = [sum(3 << (2 * s) for s in range(a, b)) for a, b in zip(edges, edges[1:])]
    return [_signed(sum(c)) for c in combinations(group, spare)]


#: Bits that the 32 segment counts of a random fingerprint tell: 0, 1, 2 with odds 1:2:1 are 1.5 bits each.
CODE_BITS = 48


def spare_groups(rows: int, max_distance: int) -> int:
    """Groups a cell keeps, so that about four random fingerprints of so many share it; 3 at least.

    A cell keeps ``spare`` of ``max_distance + spare`` groups, that is this share of CODE_BITS. More groups
    mean more cells a fingerprint and fewer candidates a cell; the links found are the same with any number.
    """
    spare, wanted = 3, min(math.log2(max(rows, 1)) - 2, CODE_BITS * 0.9)
    while CODE_BITS * spare / (spare + max_distance) < wanted and spare + max_distance < 32:
        spare += 1
    return spare


def link_fingerprints(fps: DataFrame, max_distance: int = 2, spare: int | None = None) -> DataFrame:
    """(a, b): every pair of distinct fingerprints a < b in ``fps`` at ``max_distance`` bits or fewer.

    ``spare`` sets the cell's size; by default it follows from the number of rows (``spare_groups``). Pairs may repeat.
    """
    if spare is None:
        spare = spare_groups(fps.count(), max_distance)
    fp = fps.select("fp").distinct().withColumn("code", embed(F.col("fp")))
    masks = F.array(*[F.lit(m) for m in grid_masks(max_distance, spare)])
    cells = fp.select("fp", "code", F.posexplode(masks).alias("grid", "mask")).select(
        "fp", "code", "grid", F.col("code").bitwiseAND(F.col("mask")).alias("cell")
    )
    a, b = cells.alias("a"), cells.alias("b")
    near = (
        (F.col("a.grid") == F.col("b.grid"))
        & (F.col("a.cell") == F.col("b.cell"))
        & (F.col("a.fp") < F.col("b.fp"))
        & (F.bit_count(F.col("a.code").bitwiseXOR(F.col("b.code"))) <= max_distance)
        & (F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= max_distance)
    )
    return a.join(b, near).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", max_distance: int = 2, spare: int | None = None) -> DataFrame:
    """id, fp, fingerprint (16 hex digits) and component_id (smallest id reachable over links) for each row.

    Rows with one fingerprint are one class, so copies never meet pairwise. Null or empty texts share
    fingerprint 0. Rows whose id is null keep component null unless linked to rows with ids. Repeated rows
    stay; an empty table gives an empty result.
    """
    fps = materialize(fingerprints(docs, id_col, text), "simhash")
    classes = materialize(fps.groupBy("fp").agg(F.min(id_col).alias("rep"), F.count("*").alias("rows")), "simhash")
    links = link_fingerprints(classes, max_distance, spare)
    comp = connected_components(links, "a", "b")
    # components are over fingerprints; their name is the smallest id among the classes joined
    linked = comp.join(classes, comp.node == classes.fp, "left").select("node", "component", "rep")
    least = linked.groupBy("component").agg(F.min("rep").alias("low"))
    of = materialize(linked.join(least, "component").select(F.col("node").alias("fp"), "low"), "simhash")
    named_classes = materialize(classes.join(of, "fp", "left").select("fp", "rows", F.coalesce("low", "rep").alias("component_id")), "simhash")
    return attach(fps, named_classes, "fp", "component_id", "rows").select(
        id_col, "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id of every document; nulls, repeats and empty tables as in ``near_duplicates``."""
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of near-duplicates: that of the smallest doc_id, null ids last.

    Rows are told apart by number, so of repeated rows one stays, and a null doc_id saves no copy.
    """
    held = numbered(docs, "simhash")
    groups = near_duplicates(held.select("uid", "doc.text"), "uid").select("uid", "component_id")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid")
    groups = materialize(groups.join(held.select("uid", "doc.doc_id"), "uid"), "simhash")
    first = groups.groupBy("component_id").agg(F.min(order)["uid"].alias("first"), F.count("*").alias("n")).filter("n > 1")
    marked = attach(groups, materialize(first, "simhash"), "component_id", "first", "n")
    # written down, so that Spark knows its size when it chooses how to leave these rows out
    gone = materialize(marked.filter("uid <> first").select("uid"), "simhash")
    return held.join(gone, "uid", "left_anti").select("doc.*")
