"""Benchmark decontamination by greedy string tiling (operator 5)."""

from __future__ import annotations

import heapq
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, named, numbered, salted_join, table, text_bytes

SEED_WORDS, COVERAGE = 5, 0.8
#: Bits of the filter of seed hashes that every task holds, whatever the benchmark's size (2 MB).
FILTER_BITS = 1 << 24

_ASCII = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: bytes | None) -> list[bytes]:
    """Lower-cased words; every other ASCII sign divides them."""
    return text.decode("utf-8", "replace").lower().encode().translate(_ASCII).split() if text else []


def shingles(ws: list[bytes], k: int) -> list[int]:
    """Hash of each run of ``k`` words, one for each position."""
    if len(ws) < k:
        return []
    buf, hashed = b" ".join(ws), xxhash.xxh3_64_intdigest
    ends = list(accumulate(len(w) + 1 for w in ws))
    return [hashed(buf[s : e - 1]) for s, e in zip([0, *ends], ends[k - 1 :])]


_BASE, _MOD = 1_000_003, (1 << 61) - 1


def _rolling(tokens: list[int], lo: int, hi: int, s: int):
    """(hash, position) of each run of ``s`` tokens between ``lo`` and ``hi``, by Karp and Rabin's rolling hash."""
    top, h = pow(_BASE, s, _MOD), 0
    for i in range(lo, hi):
        h = (h * _BASE + tokens[i]) % _MOD
        if i - lo >= s:
            h = (h - tokens[i - s] * top) % _MOD
        if i - lo >= s - 1:
            yield h, i - s + 1


def _free(taken: list[bool]) -> list[tuple[int, int]]:
    """Stretches of tokens that no tile has."""
    out, start = [], None
    for i, t in enumerate([*taken, True]):
        if not t and start is None:
            start = i
        elif t and start is not None:
            out.append((start, i))
            start = None
    return out


def tiles(doc: list[int], item: list[int], least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (doc position, item position, length) of non-overlapping common runs.

    The longest common run of free tokens is marked first (ties: first in the item, then in the document),
    again and again, down to ``least`` tokens. The search length starts at the item's and halves. Runs
    found by Karp and Rabin's hashes at a length wait in a queue by their full length; one that a tile has
    cut into since goes back with what is left of it, so the order is that of searching anew each time.
    """
    taken_d, taken_i, out = [False] * len(doc), [False] * len(item), []
    s = max(least, len(item))
    while True:
        at: dict[int, list[int]] = {}
        for lo, hi in _free(taken_i):
            for h, p in _rolling(item, lo, hi, s):
                at.setdefault(h, []).append(p)
        queue, ends = [], {}
        if not at and s == least:
            return out
        for lo, hi in _free(taken_d) if at else ():
            for h, d in _rolling(doc, lo, hi, s):
                for p in at.get(h, ()):
                    if ends.get(d - p, -1) > d:
                        continue  # inside a run that began earlier on this diagonal
                    e = d
                    while e < hi and p + e - d < len(item) and not taken_i[p + e - d] and doc[e] == item[p + e - d]:
                        e += 1
                    if e - d >= s:
                        ends[d - p] = e
                        heapq.heappush(queue, (d - e, p, d))
        while queue:
            n, p, d = heapq.heappop(queue)
            n = -n
            cut = [x or y for x, y in zip(taken_d[d : d + n], taken_i[p : p + n])]
            if any(cut):
                for a, e in _free(cut):
                    if e - a >= s:
                        heapq.heappush(queue, (a - e, p + a, d + a))
                continue
            taken_d[d : d + n] = [True] * n
            taken_i[p : p + n] = [True] * n
            out.append((d, p, n))
        if s == least:
            return out
        s = max(least, s // 2)


def _score(seeds: list[tuple[int, int]], item: list[int], hashes: list[int], least: int) -> tuple[float, int, int]:
    """Coverage of an item, number of tiles, longest tile, from a document's sorted seeds (position, hash) that the item has.

    A seed tells the document's words at its place, so only these are laid out; gaps become signs of their
    own that match nothing.
    """
    first: dict[int, int] = {}
    for p, h in enumerate(hashes):
        first.setdefault(h, p)
    doc, end = [], None
    for d, h in seeds:
        p = first[h]
        if end is not None and d > end:
            doc.append(-1)
        doc += item[p + (max(end - d, 0) if end is not None else 0) : p + least]
        end = d + least
    got = tiles(doc, item, least)
    return sum(n for *_, n in got) / len(item), len(got), max((n for *_, n in got), default=0)


def _ids(ws: list[bytes]) -> list[int]:
    return [xxhash.xxh3_64_intdigest(w) >> 3 for w in ws]


def _signed(hashes: list[int]) -> pa.Array:
    return pa.array(np.array(hashes, np.uint64).view(np.int64))


def matches(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, seed_words: int = SEED_WORDS, id_col: str = "doc_id", text: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, item, coverage, n_tiles, longest_tile) for documents whose tiles cover ``coverage`` of an item.

    Tiles have ``seed_words`` words or more and may stand in any order. Null and empty texts, and items of
    fewer than ``seed_words`` words, match nothing. Repeated rows of documents give repeated results;
    items are taken once for each distinct (item, text).

    Seeds of documents and items meet in a join on their hashes. A filter of FILTER_BITS bits over the
    benchmark's seeds goes to every task first, so that hardly any seed travels that no item has; the
    filter's size is fixed, and a benchmark that fills it costs shuffle, not results. The join gives one row
    for each (document, item, seed hash), with all places of that seed in the document in one list, so a
    seed that repeats on both sides multiplies nothing. Seeds that very many documents have, and items that
    very many documents hold, are dealt over several tasks (``common.salted_join``).
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text).cast("string").cast("binary").alias("_b")).distinct()

    def item_rows(batches):
        for b in batches:
            rows = []
            for item, t in zip(named(b, "item").to_pylist(), named(b, "_b").to_pylist()):
                ws = words(t)
                if len(ws) >= seed_words:
                    rows.append((item, _signed(_ids(ws)).to_pylist(), _signed(shingles(ws, seed_words)).to_pylist()))
            cols = list(zip(*rows)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.list_(pa.int64())), pa.array(cols[2], pa.list_(pa.int64()))], names=["item", "ids", "hashes"])

    held = materialize(items.mapInArrow(item_rows, "item bigint, ids array<bigint>, hashes array<bigint>").withColumn("item_row", F.monotonically_increasing_id()), "benchmark")
    seeds = held.select("item_row", F.explode(F.array_distinct("hashes")).alias("seed"))
    # one word of 64 bits for each place of the filter that is used: a fixed number of rows at most
    place = F.col("seed").bitwiseAND(F.lit(FILTER_BITS - 1))
    bits = seeds.select(place.alias("place")).groupBy(F.shiftright("place", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(place & 63 as int))")).alias("bits"))
    got = bits.toPandas()
    grid = np.zeros(FILTER_BITS // 64, np.int64)
    grid[got["word"].to_numpy(np.int64)] = got["bits"].to_numpy(np.int64)
    sent = spark.sparkContext.broadcast(grid.view(np.uint64))

    def doc_rows(batches):
        grid = sent.value
        for b in batches:
            of, rows = [], []
            for k, t in enumerate(named(b, "_b").to_pylist()):
                h = np.array(shingles(words(t), seed_words), np.uint64)
                if not len(h):
                    continue
                at = h & np.uint64(FILTER_BITS - 1)
                on = np.flatnonzero(grid[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1))
                if len(on):
                    places: dict[int, list[int]] = {}
                    for p, x in zip(on.tolist(), h[on].view(np.int64).tolist()):
                        places.setdefault(x, []).append(p)
                    of += [k] * len(places)
                    rows += places.items()
            if rows:
                seed, at = zip(*rows)
                of = pa.array(of, pa.int64())
                yield pa.RecordBatch.from_arrays([named(b, "id").take(of), named(b, "uid").take(of), pa.array(seed, pa.int64()), pa.array(at, pa.list_(pa.int32()))], names=["id", "uid", "seed", "places"])

    kind = docs.schema[id_col].dataType.simpleString()
    src = text_bytes(docs.select(F.col(id_col).alias("id"), F.col(text).alias("t")), "id", text="t")
    src = src.select("id", F.monotonically_increasing_id().alias("uid"), "_b")
    found = materialize(src.mapInArrow(doc_rows, f"id {kind}, uid bigint, seed bigint, places array<int>"), "decontamination")
    hits = salted_join(found, seeds, "seed").groupBy("uid", "id", "item_row").agg(F.collect_list(F.struct("seed", "places")).alias("hits"))
    wide = salted_join(materialize(hits, "decontamination"), held, "item_row").select("id", "item", "ids", "hashes", "hits")
    names = [id_col, item_col, "coverage", "n_tiles", "longest_tile"]
    kinds = [pa.int64(), pa.float64(), pa.int32(), pa.int32()]

    def score(batches):
        for b in batches:
            at, out = [], []
            for k, (item, ids, hashes, hits) in enumerate(zip(*(named(b, c).to_pylist() for c in ("item", "ids", "hashes", "hits")))):
                got = _score(sorted((p, h["seed"]) for h in hits for p in h["places"]), ids, hashes, seed_words)
                if got[0] >= coverage:
                    at.append(k)
                    out.append((item, *got))
            cols = [pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * 4, kinds)]
            yield pa.RecordBatch.from_arrays([named(b, "id").take(pa.array(at, pa.int64())), *cols], names=names)

    return wide.mapInArrow(score, f"`{id_col}` {kind}, `{item_col}` bigint, coverage double, n_tiles int, longest_tile int")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, coverage, n_tiles, longest_tile of every match; nulls, repeats and empty tables as in ``matches``."""
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark item, decided by row number, so that null ids and repeats are judged too."""
    held = numbered(docs, "decontamination")
    found = matches(held.select("uid", "doc.text"), table(spark, sf_dir, "benchmark"), id_col="uid").select("uid").distinct()
    # written down, so that Spark knows its size when it chooses how to leave these rows out
    found = materialize(found, "decontamination")
    return held.join(found, "uid", "left_anti").select("doc.*")
