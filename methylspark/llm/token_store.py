"""Content-addressed store of token ids (operator 1).

Layout of a store folder (Parquet, so commits are atomic per job and any Hadoop file system works):

* ``parts/kind=chunk``: hash, data, n. Each distinct run of ids once; ``data`` holds unsigned 32-bit
  little-endian ids, hash is BLAKE2b-128 of it.
* ``recipes``: one row per document in ascending id order (null ids first): its chunk hashes in order,
  n (its ids), the Merkle root over the hashes, its file range (part), place in the range (pos) and the
  ids of all documents before it in the range.
* ``manifest``: one row per file range with its documents, tokens, start and the Merkle root over its documents.
* ``root``: one row with the number of ranges, documents and tokens and the Merkle root over the ranges.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import struct
import zlib
from bisect import bisect_left
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import delete, materialize, named, partitions, slices, table, text_bytes, work_dir

#: Words, and runs of letters or signs, whose ids one worker keeps before it starts anew.
CACHE_WORDS = 1_000_000
#: Digests of chunks one task remembers, so that its repeats do not travel; the shuffle drops all others.
CACHE_CHUNKS = 200_000
#: Bytes of text encoded together.
SLICE = 5_000_000
WINDOW, MASK, LEAST, MOST = 16, (1 << 8) - 1, 64, 2048


def digest(data) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


class Merkle:
    """Root of a binary hash tree over leaves given one by one; holds one node a level.

    A lone last node moves up unchanged; no leaves: the digest of nothing.
    """

    def __init__(self):
        self.nodes: list[tuple[int, bytes]] = []

    def add(self, leaf: bytes) -> None:
        level = 0
        while self.nodes and self.nodes[-1][0] == level:
            leaf = digest(b"\x01" + self.nodes.pop()[1] + leaf)
            level += 1
        self.nodes.append((level, leaf))

    def root(self) -> bytes:
        if not self.nodes:
            return digest(b"")
        out = self.nodes[-1][1]
        for _, left in reversed(self.nodes[:-1]):
            out = digest(b"\x01" + left + out)
        return out


def merkle(leaves: list[bytes]) -> bytes:
    if len(leaves) == 1:
        return leaves[0]
    tree = Merkle()
    for x in leaves:
        tree.add(x)
    return tree.root()


_MIX, _BASE = np.uint64(0x9E3779B97F4A7C15), 0x100000001B3


def cuts(ids: np.ndarray, bounds: np.ndarray | None = None, window: int = WINDOW, mask: int = MASK, least: int = LEAST, most: int = MOST) -> tuple[list[int], list[int]]:
    """Ends of content-defined chunks of id streams laid end to end, and the number of chunks of each stream.

    ``bounds`` (0, end of the first stream, ...) tells the streams; None: one stream. A polynomial rolling
    hash over the last ``window`` ids marks a boundary where its bits under ``mask`` are zero; chunks have
    ``least`` to ``most`` ids (a stream's last one may be shorter). As ``window`` does not exceed
    ``least``, no boundary depends on a neighbouring stream.
    """
    if window > least:
        raise ValueError("the window must fit into the shortest chunk")
    edges = [0, len(ids)] if bounds is None else bounds.tolist()
    h = (ids.astype(np.uint64) + np.uint64(1)) * _MIX
    base, have = _BASE, 1
    while have < window:  # h covers `have` ids; doubling by h(2k) = h(k) shifted * base^k + h(k)
        h[have:] = h[have:] + h[:-have] * np.uint64(base)
        base = base * base % (1 << 64)
        have *= 2
    marks = (np.flatnonzero((h >> np.uint64(40)) & np.uint64(mask) == 0) + 1).tolist()
    ends, counts = [], []
    for start, stop in zip(edges, edges[1:]):
        first = len(ends)
        inner = marks[bisect_left(marks, start + least) : bisect_left(marks, stop)] if stop - start > least else ()
        for m in (*inner, stop):
            while m - start > most:
                start += most
                ends.append(start)
            if m - start >= least or m == stop > start:
                ends.append(m)
                start = m
        counts.append(len(ends) - first)
    return ends, counts


def gather(pool: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs pool[start : start + size], one after another."""
    ends = np.cumsum(size, dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    at = np.repeat(start - (ends - size), size)
    at += np.arange(total)
    return pool[at]


#: Words of these signs (ASCII but the apostrophe, Latin-1 letters) fall into runs of letters, single digits and runs of other signs.
_PLAIN = r"^[a-zA-Z0-9!-&(-/:-@\[-`{-~\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{ff}]+$"
_PIECE = r"([a-z\x{df}-\x{f6}\x{f8}-\x{ff}]+|[0-9]|[^a-z0-9\x{df}-\x{f6}\x{f8}-\x{ff}]+)"
#: The normaliser and the splitting pattern for which the short cut is exact.
_NORMALIZERS = [("NFC", None, None), ("Replace", r"\s+", " "), ("Lowercase", None, None)]
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def splits_at_white_space(path: str) -> bool:
    """Whether a tokenizer's settings are those under which words can be encoded one by one.

    Its pre-tokens hold no white space, its normaliser does not look across white space, it has a plain
    BPE model without dropout, and added tokens neither strip white space nor need word borders. Then the
    ids of a text are those of its words, and those of a plain word are the model's for its runs.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    norm, pre, model = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}, spec.get("model") or {}
    steps = [(s.get("type"), (s.get("pattern") or {}).get("Regex"), s.get("content")) for s in norm.get("normalizers", ())]
    splits = pre.get("pretokenizers") or [{}]
    byte_level = {k: splits[-1].get(k) for k in ("type", "add_prefix_space", "use_regex")}
    return (
        steps == _NORMALIZERS
        and len(splits) == 2
        and (splits[0].get("type"), splits[0].get("pattern"), splits[0].get("behavior"), splits[0].get("invert")) == ("Split", {"Regex": _SPLIT}, "Removed", True)
        and byte_level == {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}
        and (model.get("type"), model.get("dropout"), model.get("ignore_merges")) == ("BPE", None, False)
        and spec.get("truncation") is None and spec.get("padding") is None
        and all(t["content"].startswith("<|") and not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) for t in spec.get("added_tokens", ()))
    )


def _byte_signs() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies: itself if it can be printed."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(kept)]
    return {b: chr(b) for b in kept} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Runs:
    """A growing table from strings to runs of ids; no Python object is held for an entry."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.names, self.pool = pa.array([], pa.string()), np.empty(0, np.uint32)
        self.start, self.size = np.empty(0, np.int32), np.empty(0, np.int32)

    def find(self, names: pa.Array, learn, limit: int) -> np.ndarray:
        """Place of each of ``names`` (distinct) in the table; ``learn`` gives ids and sizes of new ones.

        A table of more than ``limit`` entries starts anew.
        """
        if len(self.names) > limit:
            self.clear()
        at = pc.index_in(names, value_set=self.names)
        if not at.null_count:
            return at.to_numpy()
        lacks = pc.is_null(at)
        fresh = names.filter(lacks)
        ids, size = learn(fresh)
        out = pc.fill_null(at, 0).to_numpy().copy()
        out[lacks.to_numpy(zero_copy_only=False)] = len(self.names) + np.arange(len(fresh))
        self.start = np.concatenate([self.start, (len(self.pool) + np.cumsum(size) - size).astype(np.int32)])
        self.size = np.concatenate([self.size, size.astype(np.int32)])
        self.pool = np.concatenate([self.pool, ids])
        self.names = pa.concat_arrays([self.names, fresh])
        return out


def _laid(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    size = np.fromiter(map(len, ids), np.int64, len(ids))
    return np.fromiter(chain.from_iterable(ids), np.uint32, int(size.sum())), size


class WordEncoder:
    """Ids of texts by the tokenizers library, asked once for each word not seen lately.

    The words of a slice of texts are told apart and looked up by Arrow; the ids of all words are then
    gathered from one pool. For plain words the library's model is asked for each new run of letters,
    digit or run of signs, which skips its normaliser and splitter; other words go through all of it.
    Tokenizers for which this would not be exact encode whole texts.
    """

    def __init__(self, path: str, limit: int = CACHE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok, self.limit, self.by_word = Tokenizer.from_file(path), limit, splits_at_white_space(path)
        self.words, self.pieces, self.signs = Runs(), Runs(), _byte_signs()

    def _model(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-tokens, by the library's model alone."""
        ask, signs = self.tok.model.tokenize, self.signs
        names = pieces.to_numpy(zero_copy_only=False).tolist()
        return _laid([[t.id for t in ask(p if p.isascii() else p.encode().decode("latin-1").translate(signs))] for p in names])

    def _plain(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of plain words end to end, and their numbers."""
        marked = pc.replace_substring_regex(pc.utf8_lower(words), _PIECE, r"\1 ")
        runs = pc.ascii_split_whitespace(pc.ascii_rtrim(marked, " "))
        own = runs.values.dictionary_encode()
        which = self.pieces.find(own.dictionary, self._model, self.limit)[own.indices.to_numpy()]
        size = self.pieces.size[which]
        ends = np.append(0, np.cumsum(size))[runs.offsets.to_numpy()]
        return gather(self.pieces.pool, self.pieces.start[which], size), np.diff(ends)

    def _learn(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        plain = pc.and_(pc.match_substring_regex(words, _PLAIN), pc.invert(pc.match_substring(words, "<|")))
        flat, size = self._plain(words.filter(plain))
        if len(size) == len(words):
            return flat, size
        rest, got = words.filter(pc.invert(plain)).to_pylist(), []
        for k in range(0, len(rest), 8192):
            got += [e.ids for e in self.tok.encode_batch_fast(rest[k : k + 8192], add_special_tokens=False)]
        more, lengths = _laid(got)
        # both kinds in the order in which the words came
        on = plain.to_numpy(zero_copy_only=False)
        sizes, starts = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        sizes[on], sizes[~on] = size, lengths
        starts[on], starts[~on] = np.cumsum(size) - size, len(flat) + np.cumsum(lengths) - lengths
        return gather(np.concatenate([flat, more]), starts, sizes), sizes

    def encode(self, texts: list[bytes], tail: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, each followed by ``tail``; and bounds (0, end of the first text, ...)."""
        if not self.by_word:
            got = [[*e.ids, tail] for e in self.tok.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]
            ids, size = _laid(got)
            return ids, np.append(0, np.cumsum(size))
        words = pc.ascii_split_whitespace(pa.array(texts, pa.string()))
        seen = words.values.dictionary_encode()
        of = self.words.find(seen.dictionary, self._learn, self.limit)[seen.indices.to_numpy()]
        # one more run a text, of the tail alone
        offsets = words.offsets.to_numpy()
        del words, seen
        start = np.insert(self.words.start[of], offsets[1:], len(self.words.pool))
        size = np.insert(self.words.size[of], offsets[1:], 1)
        bounds = np.append(0, np.cumsum(size))[offsets.astype(np.int64) + np.arange(len(offsets))]
        return gather(np.append(self.words.pool, np.uint32(tail)), start, size), bounds


@functools.lru_cache(maxsize=1)
def encoder(path: str) -> WordEncoder:
    """The encoder of this Python worker, kept for its next tasks."""
    return WordEncoder(path)


def _binary(data, ends: np.ndarray) -> pa.Array:
    """Byte strings that lie end to end in ``data``."""
    offsets = np.append(0, ends).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _rows(tokenizer: str, end_id: int, id_col: str):
    """Map batches of (id, uid, _b) to chunk rows and recipe rows, which differ in ``kind``."""

    def run(batches):
        enc, seen = encoder(tokenizer), set()
        for batch in batches:
            for b in slices(batch, "_b", SLICE):
                ids, bounds = enc.encode([t or b"" for t in named(b, "_b").to_pylist()], end_id)
                ends, counts = cuts(ids, bounds)
                raw = memoryview(ids.astype("<u4", copy=False).tobytes())
                hashes = [digest(raw[4 * s : 4 * e]) for s, e in zip([0, *ends], ends)]
                if len(seen) > CACHE_CHUNKS:
                    seen = set()
                new = []
                for h in hashes:
                    new.append(h not in seen)
                    seen.add(h)
                keep, stops = pa.array(new, pa.bool_()), np.array(ends, np.int64)
                joined = b"".join(hashes)
                addresses = _binary(joined, 16 * np.arange(1, len(hashes) + 1)).filter(keep)
                data = _binary(raw, 4 * stops).filter(keep)
                recipes = _binary(joined, 16 * np.cumsum(counts))
                n, m = len(counts), len(addresses)
                lengths = pa.array(np.diff(stops, prepend=0)).filter(keep)
                none = lambda kind, k: pa.nulls(k, kind)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(["recipe"] * n + ["chunk"] * m),
                        pa.concat_arrays([none(pa.binary(), n), addresses]),
                        pa.concat_arrays([recipes, data]),
                        pa.concat_arrays([pa.array(np.diff(bounds)), lengths]),
                        pa.concat_arrays([named(b, id_col), none(pa.int64(), m)]),
                        pa.concat_arrays([named(b, "uid"), none(pa.int64(), m)]),
                    ],
                    names=["kind", "hash", "data", "n", "id", "uid"],
                )

    return run


def _first_of_runs(batches):
    """Of sorted rows, drop chunk rows whose hash equals the row before."""
    last = None
    for b in batches:
        hashes = named(b, "hash").to_pylist()
        keep = []
        for h in hashes:
            keep.append(h is None or h != last)
            last = h
        yield b.filter(pa.array(keep, pa.bool_()))


RECIPES = "part int, pos bigint, id bigint, uid bigint, n bigint, before bigint, hashes binary, root binary"
RANGES = "part int, documents bigint, tokens bigint, root binary"


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text: str = "text") -> None:
    """Encode every text, append ``end_id`` and write the store under ``path``.

    Null and empty texts hold ``end_id`` alone. Repeated rows are stored as documents of their own that
    share chunks; null ids come first. One shuffle moves each task's distinct chunks to the partition of
    their hash; recipes spread by document, so neither a hot chunk nor a hot document gathers more than
    a row a task (or, in tasks with more chunks than CACHE_CHUNKS, a row for each so many).
    """
    spark = docs.sparkSession
    n = partitions(spark)
    src = text_bytes(docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text).alias(text)), id_col, text=text)
    src = src.withColumn("uid", F.monotonically_increasing_id()).select(id_col, "uid", "_b")
    shape = "kind string, hash binary, data binary, n bigint, id bigint, uid bigint"
    rows = src.mapInArrow(_rows(tokenizer, end_id, id_col), shape)
    key = F.when(F.col("kind") == "chunk", F.xxhash64("hash")).otherwise(F.xxhash64("uid"))
    dealt = rows.repartition(n, key).sortWithinPartitions("kind", "hash")
    dealt.mapInArrow(_first_of_runs, shape).write.partitionBy("kind").option("compression", "zstd").option("parquet.enable.dictionary", "false").parquet(f"{path}/parts")

    loose = _parts(spark, path).filter("kind = 'recipe'").select("id", "uid", "n", F.col("data").alias("hashes"))
    ranged = loose.repartitionByRange(n, "id", "uid").sortWithinPartitions("id", "uid")
    ranged.mapInArrow(_running, RECIPES).write.option("compression", "zstd").parquet(f"{path}/recipes")
    delete(spark, f"{path}/parts/kind=recipe")
    # one row per file range: the number of ranges, not of documents, bounds this window and the root's task
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    held = range_roots(spark.read.schema(RECIPES).parquet(f"{path}/recipes"))
    held.withColumn("start", F.coalesce(F.sum("tokens").over(order), F.lit(0))).write.parquet(f"{path}/manifest")
    _top(spark.read.schema(RANGES).parquet(f"{path}/manifest")).write.parquet(f"{path}/root")


def _parts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("hash binary, data binary, n bigint, id bigint, uid bigint, kind string").parquet(f"{path}/parts")


def _running(batches):
    """Add the range's number, the place and the ids before each document in its range, and its Merkle root."""
    from pyspark import TaskContext

    part, before, pos = TaskContext.get().partitionId(), 0, 0
    for b in batches:
        sizes = named(b, "n").to_numpy(zero_copy_only=False).astype(np.int64)
        ends = before + np.cumsum(sizes)
        hashes = named(b, "hashes").to_pylist()
        roots = [merkle([h[k : k + 16] for k in range(0, len(h), 16)]) for h in hashes]
        k = len(sizes)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(k, part, np.int32)), pa.array(np.arange(pos, pos + k)), named(b, "id"), named(b, "uid"), named(b, "n"), pa.array(ends - sizes), named(b, "hashes"), pa.array(roots, pa.binary())],
            names=["part", "pos", "id", "uid", "n", "before", "hashes", "root"],
        )
        before, pos = int(ends[-1]) if k else before, pos + k


def range_roots(recipes: DataFrame) -> DataFrame:
    """part, documents, tokens and the Merkle root over the documents of each file range, in their order.

    A leaf is the digest of a document's id, number of ids, place in the id stream and own root. Only
    these travel, and a task holds one node a level of the tree.
    """

    def run(batches):
        part, tree, documents, tokens, done = None, Merkle(), 0, 0, []
        for b in batches:
            for p, i, n, before, root in zip(*(named(b, c).to_pylist() for c in ("part", "id", "n", "before", "root"))):
                if p != part:
                    if part is not None:
                        done.append((part, documents, tokens, tree.root()))
                    part, tree, documents, tokens = p, Merkle(), 0, 0
                tree.add(digest(struct.pack("<?qqq", i is None, i or 0, n, before) + root))
                documents, tokens = documents + 1, tokens + n
        if part is not None:
            done.append((part, documents, tokens, tree.root()))
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names=["part", "documents", "tokens", "root"])

    narrow = recipes.select("part", "pos", "id", "n", "before", "root")
    return narrow.repartition(partitions(recipes.sparkSession), "part").sortWithinPartitions("part", "pos").mapInArrow(run, RANGES)


def _top(ranges: DataFrame) -> DataFrame:
    """ranges, documents, tokens and the Merkle root over the ranges: one row, from one small row a range."""

    def run(batches):
        tree, ranges, documents, tokens = Merkle(), 0, 0, 0
        for b in batches:
            for p, d, t, root in zip(*(named(b, c).to_pylist() for c in ("part", "documents", "tokens", "root"))):
                tree.add(digest(struct.pack("<qqq", p, d, t) + root))
                ranges, documents, tokens = ranges + 1, documents + d, tokens + t
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (ranges, documents, tokens, tree.root())], names=["ranges", "documents", "tokens", "root"])

    return ranges.select("part", "documents", "tokens", "root").repartition(1).sortWithinPartitions("part").mapInArrow(run, "ranges bigint, documents bigint, tokens bigint, root binary")


def verify(spark: SparkSession, path: str) -> None:
    """Recompute the hash tree from the recipes on disk up to the root; ValueError where anything differs.

    So a lost or changed recipe file, manifest row or root row is an error, not a shorter result.
    """
    stated = spark.read.schema(RANGES).parquet(f"{path}/manifest")
    seen = range_roots(spark.read.schema(RECIPES).parquet(f"{path}/recipes"))
    names = ["documents", "tokens", "root"]
    both = stated.join(seen.select("part", *[F.col(c).alias(f"_{c}") for c in names]), "part", "full")
    same = F.lit(True)
    for c in names:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    if both.filter(~same).count():
        raise ValueError("the recipes do not match the manifest")
    top = _top(stated).exceptAll(spark.read.schema("ranges bigint, documents bigint, tokens bigint, root binary").parquet(f"{path}/root"))
    if top.count():
        raise ValueError("the manifest does not match its root")


# CRC-32 of a concatenation from the parts' checksums: appending n zero bytes is linear over GF(2).
def _square(rows: list[int]) -> list[int]:
    return [_apply(rows, r) for r in rows]


def _apply(rows: list[int], x: int) -> int:
    out = k = 0
    while x:
        if x & 1:
            out ^= rows[k]
        x >>= 1
        k += 1
    return out


def _powers(count: int = 48) -> list[list[int]]:
    """Matrix of 2^k zero bytes for each k."""
    bit = [0xEDB88320] + [1 << k for k in range(31)]
    byte = _square(_square(_square(bit)))
    out = [byte]
    for _ in range(count - 1):
        out.append(_square(out[-1]))
    return out


def shift_crc(crc: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """What each checksum adds to that of a text in which ``zeros`` more bytes follow."""
    crc, zeros = crc.astype(np.uint32), zeros.astype(np.int64)
    for k, rows in enumerate(_powers()):
        on = np.flatnonzero(zeros >> k & 1)
        if len(on):
            x, out = crc[on], np.zeros(len(on), np.uint32)
            for j in range(32):
                out ^= np.where(x >> np.uint32(j) & np.uint32(1), np.uint32(rows[j]), np.uint32(0))
            crc[on] = out
        if not (zeros >> (k + 1)).any():
            break
    return crc


def _check_chunks(batches):
    """(hash, n, crc) of chunks as they are on disk; raises where data and address differ."""
    for b in batches:
        data, hashes = named(b, "data").to_pylist(), named(b, "hash").to_pylist()
        if any(digest(d) != h for d, h in zip(data, hashes)):
            raise ValueError("a stored chunk does not match its address")
        yield pa.RecordBatch.from_arrays(
            [named(b, "hash"), pa.array([len(d) // 4 for d in data], pa.int64()), pa.array([zlib.crc32(d) for d in data], pa.int64())],
            names=["hash", "n", "crc"],
        )


def _open_recipes(batches):
    """One row per chunk of a recipe; raises where the root differs from that of the hashes."""
    for b in batches:
        uid, seq, out = [], [], []
        for u, h, root in zip(*(named(b, c).to_pylist() for c in ("uid", "hashes", "root"))):
            leaves = [h[k : k + 16] for k in range(0, len(h), 16)]
            if merkle(leaves) != root:
                raise ValueError("a recipe does not match its Merkle root")
            uid += [u] * len(leaves)
            seq += range(len(leaves))
            out += leaves
        yield pa.RecordBatch.from_arrays(
            [pa.array(uid, pa.int64()), pa.array(seq, pa.int64()), pa.array(out, pa.binary())], names=["uid", "seq", "hash"]
        )


#: A chunk with more than one of so many of all recipes' steps is brought to them by broadcast; fewer than that can be so.
FREQUENT = 2000


def _often(batches):
    """(hash, n) of chunks with at least one of FREQUENT of a batch's steps: what is so frequent overall is so in some batch."""
    for b in batches:
        steps = np.frombuffer(b"".join(named(b, "hashes").to_pylist()), "V16")
        names, n = np.unique(steps, return_counts=True)
        often = n * FREQUENT >= len(steps)
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in names[often]], pa.binary()), pa.array(n[often], pa.int64())], names=["hash", "n"])


def _with_chunks(recipes: DataFrame, chunks: DataFrame) -> DataFrame:
    """uid, seq and the columns of ``chunks`` (one row a hash) for each step of the recipes; null for a hash that is missing.

    Steps of frequent chunks, such as those of empty texts and of many copies, get them by broadcast and are dealt
    evenly over the join that serves all others. A chunk frequent overall has at least half of its steps in batches
    where it is at half that rate, so none is overlooked.
    """
    steps = recipes.select("part", "uid", "hashes", "root").mapInArrow(_open_recipes, "uid bigint, seq bigint, hash binary")
    total = recipes.agg(F.sum(F.octet_length("hashes")).alias("n")).first()[0] or 0
    often = recipes.select("hashes").mapInArrow(_often, "hash binary, n bigint").groupBy("hash").agg(F.sum("n").alias("k"))
    often = F.broadcast(often.filter(F.col("k") * FREQUENT * 16 > total).select("hash"))
    values = [c for c in chunks.columns if c != "hash"]
    held = F.struct(*values)
    hot = F.broadcast(chunks.join(often, "hash", "left_semi").select("hash", held.alias("_hot")))
    cold = chunks.select(F.col("hash").alias("_hash"), F.xxhash64("hash").alias("_at"), held.alias("_cold"))
    dealt = F.when(F.col("_hot").isNotNull(), F.xxhash64("uid", "seq")).otherwise(F.xxhash64("hash"))
    out = steps.join(hot, "hash", "left").withColumn("_k", dealt).join(cold, (F.col("_k") == F.col("_at")) & (F.col("hash") == F.col("_hash")), "left")
    return out.select("uid", "seq", *[F.coalesce("_hot", "_cold")[c].alias(c) for c in values])


def _contribution(batches):
    for b in batches:
        crc, after = (np.array(named(b, c).to_pylist(), np.int64) for c in ("crc", "after"))
        yield pa.RecordBatch.from_arrays([named(b, "uid"), named(b, "n"), pa.array(shift_crc(crc, after * 4), pa.int64())], names=["uid", "n", "crc"])


def read_store(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """Per document: id, start, n_tokens, ids_crc32, all taken from the stored files.

    The hash tree is checked first (``verify``). Every chunk is read and checked against its address, every
    recipe against its root, and the ids read against the number stated; a missing chunk is an error. A
    document's checksum is combined from those of its chunks, so that ids need not be brought together.
    """
    verify(spark, path)
    chunks = _parts(spark, path).filter("kind = 'chunk'").select("hash", "data").mapInArrow(_check_chunks, "hash binary, n bigint, crc bigint")
    recipes = spark.read.schema(RECIPES).parquet(f"{path}/recipes")
    # written, as it is read twice: a few bytes a chunk. A hash missing from the store keeps its step with null checksum, and fails below
    got = _with_chunks(recipes, materialize(chunks, "chunks"))
    order = Window.partitionBy("uid").orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, -1)
    got = got.select("uid", "n", "crc", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("after"))
    got = got.withColumn("crc", F.coalesce("crc", F.raise_error(F.lit("a chunk of a recipe is not in the store")).cast("bigint")))
    docs = got.mapInArrow(_contribution, "uid bigint, n bigint, crc bigint").groupBy("uid").agg(F.sum("n").alias("n_read"), F.bit_xor("crc").alias("ids_crc32"))
    ranges = F.broadcast(spark.read.schema("part int, start bigint").parquet(f"{path}/manifest").withColumnRenamed("start", "range_start"))
    out = recipes.select("part", "id", "uid", "n", "before").join(ranges, "part").join(docs, "uid", "left")
    n = F.when(F.col("n").eqNullSafe(F.col("n_read")), F.col("n")).otherwise(F.raise_error(F.lit("a document does not have the ids its recipe states")).cast("bigint"))
    return out.select(F.col("id").alias(id_col), (F.col("range_start") + F.col("before")).alias("start"), n.alias("n_tokens"), "ids_crc32")


def read_documents(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """(id, ids): the id streams rebuilt from recipes and chunks, after the checks of ``verify``."""
    verify(spark, path)
    chunks = _parts(spark, path).filter("kind = 'chunk'").select("hash", "data")
    recipes = spark.read.schema(RECIPES).parquet(f"{path}/recipes")
    data = F.coalesce("data", F.raise_error(F.lit("a chunk of a recipe is not in the store")).cast("binary"))
    joined = _with_chunks(recipes, chunks).select("uid", "seq", data.alias("data"))
    joined = joined.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("seq", "data"))).alias("c"))
    # binary chunks joined as one array of parts: linear in the document
    whole = joined.mapInArrow(_whole, "uid bigint, ids binary")
    return recipes.select("uid", F.col("id").alias(id_col)).join(whole, "uid").select(id_col, "ids")


def _whole(batches):
    for b in batches:
        ids = [b"".join(x["data"] for x in c) for c in named(b, "c").to_pylist()]
        yield pa.RecordBatch.from_arrays([named(b, "uid"), pa.array(ids, pa.binary())], names=["uid", "ids"])


def op1_token_store(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read back from a store written for them.

    Null texts count as empty ones, null ids come first; repeated rows keep one row each; an empty table gives none.
    """
    import public_tokenizers

    path = work_dir(spark, "token-store")
    write_store(table(spark, sf_dir, "documents"), path, tokenizer or public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return read_store(spark, path)
