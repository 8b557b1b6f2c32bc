"""Embedding near-duplicates: random-hyperplane tables, exact cosine, connected components (operator 4)."""

from __future__ import annotations

import hashlib
import math
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attach, materialize, named, partitions, table
from .components import connected_components

#: Least bits of a table, rows that a bucket should hold at most on average, seed.
BITS, BUCKET, SEED = 16, 16, 7
#: Members of a block: at least, at most, and blocks that a bucket has before its blocks grow beyond the least.
BLOCK, BLOCK_MOST, BLOCKS = 256, 1024, 4
#: Probability that all tables miss a pair whose cosine is the threshold.
MISS = 1e-5
#: Runs of up to so many members are evaluated together.
SMALL = 16


def plan(rows: int, cosine: float) -> tuple[int, int]:
    """Bits and tables for so many rows: buckets stay small as the input grows, and the recall stays.

    Vectors at the threshold agree on a sign bit with probability 1 - angle / pi; the number of tables
    follows from MISS (27 tables of 16 bits at cosine 0.98).
    """
    bits = min(60, max(BITS, math.ceil(math.log2(max(rows, 1) / BUCKET))))
    agree = (1 - math.acos(min(1.0, max(-1.0, cosine))) / math.pi) ** bits
    return bits, 1 if agree >= 1 - MISS else math.ceil(math.log(MISS) / math.log1p(-agree))


def hyperplanes(dim: int, bits: int, tables: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, bits * tables))


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two, exactly, so that neither squares nor products leave the range of doubles."""
    _, e = np.frexp(np.abs(x).max(1))
    return np.ldexp(x, -e[:, None])


def _signatures(vec: str, bits: int, tables: int, seed: int):
    """(id, label, digest, embedding, dim, sigs); digest null where a vector cannot be compared."""

    def run(batches):
        planes: dict[int, np.ndarray] = {}
        weights = 1 << np.arange(bits, dtype=np.int64)
        for b in batches:
            col = named(b, vec)
            n = len(col)
            size = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False)
            flat = col.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls become nan
            first = np.cumsum(size) - size
            digests, sigs = [None] * n, np.zeros((n, tables), np.int64)
            sound = np.zeros(n, bool)
            for dim in np.unique(size[size > 0]).tolist():
                if dim not in planes:
                    planes[dim] = hyperplanes(dim, bits, tables, seed)
                rows = np.flatnonzero(size == dim)
                for k in range(0, len(rows), 1024):
                    at = rows[k : k + 1024]
                    x = flat[first[at][:, None] + np.arange(dim)]
                    ok = np.isfinite(x).all(1) & x.any(1)
                    at, x = at[ok], x[ok]
                    if not len(at):
                        continue
                    sound[at] = True
                    sigs[at] = (scaled(x) @ planes[dim] > 0).reshape(len(at), tables, bits) @ weights
                    for i, v in zip(at.tolist(), x + 0.0):
                        digests[i] = hashlib.blake2b(v.tobytes(), digest_size=16).digest()
            none = pa.array(~sound)
            offsets = pa.array(np.append(0, np.cumsum(np.where(sound, tables, 0))).astype(np.int32))
            lists = pa.ListArray.from_arrays(offsets, pa.array(sigs[sound].ravel()), mask=none) if n else pa.array([], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [named(b, "id"), named(b, "label"), pa.array(digests, pa.binary()), col, pa.array(size.astype(np.int32)), lists],
                names=["id", "label", "digest", "embedding", "dim", "sigs"],
            )

    return run


def _settle(low: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> None:
    """Lower each row's number to the smallest that its links reach."""
    while len(rows):
        before = low.copy()
        np.minimum.at(low, rows, low[cols])
        np.minimum.at(low, cols, low[rows])
        if (before == low).all():
            return


def _block(num, mult, x, sigs, side, t, cosine):
    """Links of one block pair: per row, the copies it links with; and a star for each local component."""
    norm = np.sqrt((x * x).sum(1))
    same = side.max() == 0
    a = np.arange(len(x)) if same else np.flatnonzero(side == 0)
    c = a if same else np.flatnonzero(side == 1)
    link = (x[a] @ x[c].T) / (norm[a][:, None] * norm[c][None, :]) >= cosine
    for k in range(t):  # an earlier table has this pair
        link &= sigs[a, k][:, None] != sigs[c, k][None, :]
    if same:
        np.fill_diagonal(link, False)
    counts = np.zeros(len(x), np.int64)
    counts[a] += link @ mult[c]
    if not same:
        counts[c] += link.T @ mult[a]
    low = num.copy()
    rows, cols = np.nonzero(link)
    _settle(low, a[rows], c[cols])
    return counts, low


def _small(first, size, num, mult, x, sigs, t, cosine, counts, low):
    """The same for many runs of ``size`` members of one block each, beginning at ``first``."""
    i, j = np.triu_indices(size, 1)
    a, b = (first[:, None] + i).ravel(), (first[:, None] + j).ravel()
    norm = np.sqrt((x * x).sum(1))
    for k in range(0, len(a), 8192):
        p, q = a[k : k + 8192], b[k : k + 8192]
        on = np.einsum("ij,ij->i", x[p], x[q]) / (norm[p] * norm[q]) >= cosine
        p, q = p[on], q[on]
        earlier = ((sigs[p] == sigs[q]) & (np.arange(sigs.shape[1]) < t[p][:, None])).any(1)
        p, q = p[~earlier], q[~earlier]
        np.add.at(counts, p, mult[q])
        np.add.at(counts, q, mult[p])
        a[k : k + 8192] = -1
        a[k : k + len(p)], b[k : k + len(p)] = p, q
    on = a >= 0
    _settle(low, a[on], b[on])


OUT = "num bigint, links bigint, low bigint"


def _matrix(col: pa.Array, a: int, b: int) -> np.ndarray:
    """Rows a to b of a list column whose lists are equally long there."""
    at = col.offsets.to_numpy()
    return col.values.slice(at[a], at[b] - at[a]).to_numpy(zero_copy_only=False).reshape(b - a, -1)


def _runs(cosine: float):
    """Over rows sorted by block pair, evaluate each run; a run may span batches, others are held no longer."""

    def evaluate(t: pa.RecordBatch, edges: np.ndarray) -> pa.RecordBatch:
        num, mult, side, table_no, dim = (named(t, c).to_numpy() for c in ("num", "mult", "side", "t", "dim"))
        counts, low = np.zeros(len(num), np.int64), num.copy()
        begin, size = edges[:-1], np.diff(edges)
        two_sided = np.maximum.reduceat(side, begin) > 0 if len(begin) else np.zeros(0, bool)
        embedding, sigs = named(t, "embedding"), named(t, "sigs")
        little = (size > 1) & (size <= SMALL) & ~two_sided
        # stretches of equal dimension, so that their rows form one matrix
        turns = np.append(np.append(0, np.flatnonzero(np.diff(dim)) + 1), len(dim))
        for lo, hi in zip(turns[:-1].tolist(), turns[1:].tolist()):
            inside = (begin >= lo) & (begin < hi)
            for n in np.unique(size[inside & little]).tolist():
                first = begin[inside & little & (size == n)]
                for k in range(0, len(first), 2048):
                    f = first[k : k + 2048]
                    rows = (f[:, None] + np.arange(n)).ravel()
                    x = scaled(_matrix(embedding, lo, hi)[rows - lo].astype(np.float64))
                    c, m = counts[rows], low[rows]
                    _small(np.arange(0, len(rows), n), n, num[rows], mult[rows], x, _matrix(sigs, lo, hi)[rows - lo], table_no[rows], cosine, c, m)
                    counts[rows], low[rows] = c, m
            for a, n in zip(begin[inside & (size > 1) & ~little].tolist(), size[inside & (size > 1) & ~little].tolist()):
                b = a + n
                x = scaled(_matrix(embedding, a, b).astype(np.float64))
                counts[a:b], low[a:b] = _block(num[a:b], mult[a:b], x, _matrix(sigs, a, b), side[a:b], int(table_no[a]), cosine)
        on = (counts > 0) | (low < num)
        return pa.RecordBatch.from_arrays([pa.array(x[on]) for x in (num, counts, low)], names=["num", "links", "low"])

    def run(batches):
        held = None
        for b in chain(batches, [None]):
            if b is None:
                t = held
            else:
                t = b if held is None else pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
            if t is None or not len(t):
                continue
            pair = named(t, "pair").to_numpy()
            edges = np.append(np.append(0, np.flatnonzero(np.diff(pair)) + 1), len(pair))
            if b is not None:
                held = t.slice(edges[-2])
                edges = edges[:-1]
            if len(edges) > 1:
                part = pa.Table.from_batches([t.slice(0, edges[-1])]).combine_chunks().to_batches()[0]
                yield evaluate(part, edges)

    return run


def near_duplicates(vectors: DataFrame, cosine: float = 0.98, id_col: str = "vec_id", vec: str = "embedding", label: str = "label", bits: int | None = None, tables: int | None = None, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """id, n_links, component_id, kept for each row.

    Rows compare only with equal non-null labels and equal dimension. Vectors that are null, empty, zero
    or hold null or non-finite components link with nothing, and neither do rows with null labels.
    Identical vectors of a label form one class that is compared once; its rows link with each other.
    Buckets that several tables share with the same members are evaluated once. A large bucket is cut into
    blocks of about ``block`` members (up to BLOCK_MOST in very large buckets) and each pair of blocks is one matrix product, which returns counts
    and stars: no pair of vectors is ever a row. Repeated rows count as vectors of their own. Rows with null
    ids count as vectors too; component_id is the smallest id that is not null (null if there is none), and
    such rows are never kept. ``bits`` and ``tables`` follow from the number of rows (``plan``) if not given.
    """
    spark = vectors.sparkSession
    if bits is None or tables is None:
        bits, tables = plan(vectors.count(), cosine)
    src = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label).alias("label"), F.col(vec).alias(vec))
    kind = vectors.schema[vec].dataType.simpleString()
    shape = f"id bigint, label {vectors.schema[label].dataType.simpleString()}, digest binary, embedding {kind}, dim int, sigs array<bigint>"
    rows = src.mapInArrow(_signatures(vec, bits, tables, seed), shape)
    name = F.when(F.col("label").isNotNull(), F.concat_ws(":", F.col("label").cast("string"), F.hex("digest")))
    rows = materialize(rows.withColumn("key", F.when(F.col("digest").isNotNull(), name)).drop("digest"), "vectors")

    usable = rows.filter("key is not null")
    narrow = usable.groupBy("key").agg(F.min("id").alias("rep"), F.count("*").alias("mult"))
    first = usable.dropDuplicates(["key"]).drop("id")
    # classes get numbers of their own, as ids may be null or repeat
    classes = materialize(first.join(narrow, "key").withColumn("num", F.monotonically_increasing_id()), "vectors")

    # a member is copied once for each block of its bucket: blocks of large buckets grow before their number does
    members_of_block = F.greatest(F.lit(block), F.least(F.lit(max(block, BLOCK_MOST)), F.ceil(F.col("m") / BLOCKS)))
    h = F.xxhash64("key")
    members = classes.select("label", "dim", "num", h.alias("h"), F.posexplode("sigs").alias("t", "sig"))
    buckets = (
        members.groupBy("label", "dim", "t", "sig")
        .agg(F.count("*").alias("m"), F.bit_xor("h").alias("x1"), F.bit_xor(F.xxhash64("h", F.lit(1))).alias("x2"))
        .filter("m > 1")
        .groupBy("label", "dim", "m", "x1", "x2")
        .agg(F.min_by(F.struct("t", "sig"), "t").alias("b"))
        .select("label", "dim", "b.t", "b.sig", F.ceil(F.col("m") / members_of_block).cast("int").alias("blocks"))
    )
    placed = members.join(buckets, ["label", "dim", "t", "sig"]).withColumn("k", F.pmod("h", "blocks").cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    paired = placed.withColumn("o", other).select(
        "num", "t",
        F.when(F.col("o") < F.col("k"), 1).otherwise(0).alias("side"),
        F.xxhash64("label", "dim", "t", "sig", F.least("k", "o"), F.greatest("k", "o")).alias("pair"),
    )
    full = paired.join(classes.select("num", "mult", "dim", "embedding", "sigs"), "num")
    dealt = full.repartition(partitions(spark), "pair").sortWithinPartitions("dim", "pair", "side")
    found = materialize(dealt.mapInArrow(_runs(cosine), OUT), "vectors")

    links = found.groupBy("num").agg(F.sum("links").alias("links"))
    comp = connected_components(found.filter("low < num"), "num", "low")
    linked = comp.join(classes.select("num", "rep"), comp.node == F.col("num"))
    least = linked.groupBy("component").agg(F.min("rep").alias("low"))
    of = linked.join(least, "component").select("num", "low")
    per_class = classes.select("num", "key", "rep", "mult").join(links, "num", "left").join(of, "num", "left")
    told = F.struct((F.col("mult") - 1 + F.coalesce("links", F.lit(0))).alias("n"), F.coalesce("low", "rep").alias("c"))
    out = attach(rows.select("id", "key"), materialize(per_class.select("key", "mult", told.alias("told")), "vectors"), "key", "told", "mult")
    comp_id = F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("told.c"))
    return out.select(
        F.col("id").alias(id_col), F.coalesce("told.n", F.lit(0)).cast("long").alias("n_links"),
        comp_id.alias("component_id"), F.coalesce(F.col("id") == comp_id, F.lit(False)).alias("kept"),
    )


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector; nulls, repeats and empty tables as in ``near_duplicates``."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))


OP4_SQL = """
with recursive e as (select vec_id, label, embedding::double[] as v from embeddings
  where label is not null and len(embedding) > 0 and list_min(embedding::double[]) > '-infinity'::double
    and list_max(embedding::double[]) < 'infinity'::double and list_sum(list_transform(embedding::double[], lambda c: c * c)) > 0),
l as (select a.vec_id as a, b.vec_id as b from e a join e b on a.label = b.label and a.vec_id <> b.vec_id and len(a.v) = len(b.v)
  where list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) >= 0.98),
r as (select vec_id as n, vec_id as m from embeddings union select r.n, l.b from r join l on r.m = l.a)
select x.vec_id, (select count(*) from l where l.a = x.vec_id)::bigint as n_links, min(r.m) as component_id, x.vec_id = min(r.m) as kept
from embeddings x join r on r.n = x.vec_id group by x.vec_id
"""
