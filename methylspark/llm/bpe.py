"""Byte-level BPE without regular expressions: scans for pre-tokens, cached merges, decoding (operator 6)."""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import named, slices, table, text_bytes

# classes of code points
LETTER, NUMBER, OTHER, QUOTE1, QUOTE2, SPACE, LAST_OTHER_SPACE, LAST_BLANK, EDGE = range(9)
# what the scan knows after a code point
END, IN_LETTERS, IN_NUMBERS, IN_OTHER, IN_SPACE, BLANK_BEFORE, ONE_MORE, TWO_MORE = range(8)
#: White space of the Unicode standard.
WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def class_table() -> np.ndarray:
    """LETTER, NUMBER, SPACE or OTHER of every code point, by the Unicode version of this Python.

    Code points that a library of another Unicode version classes otherwise may be split differently there.
    """
    out = np.full(0x110000, OTHER, np.uint8)
    category = unicodedata.category
    for cp in range(0x110000):
        c = category(chr(cp))[0]
        if c == "L":
            out[cp] = LETTER
        elif c == "N":
            out[cp] = NUMBER
    out[WHITE] = SPACE
    return out


def transitions() -> tuple[np.ndarray, np.ndarray]:
    """next[class, state] and starts[class, state]: the state after a code point; does it begin a piece?"""
    nxt, starts = np.zeros((9, 8), np.uint8), np.ones((9, 8), bool)
    run = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, OTHER: IN_OTHER, QUOTE1: ONE_MORE, QUOTE2: TWO_MORE, SPACE: IN_SPACE, LAST_OTHER_SPACE: END, LAST_BLANK: BLANK_BEFORE, EDGE: END}
    for c, to in run.items():
        nxt[c] = to
        if c in (LETTER, NUMBER, OTHER):
            starts[c, [to, BLANK_BEFORE]] = False
    for c in (QUOTE1, QUOTE2):  # an apostrophe that goes on a run of other signs is one of them
        nxt[c, [IN_OTHER, BLANK_BEFORE]] = IN_OTHER
        starts[c, [IN_OTHER, BLANK_BEFORE]] = False
    starts[SPACE, IN_SPACE] = False
    for c in range(EDGE):
        nxt[c, TWO_MORE], nxt[c, ONE_MORE] = ONE_MORE, END
        starts[c, [ONE_MORE, TWO_MORE]] = False
    return nxt, starts


NEXT, STARTS = transitions()
WIDTH = 128


def classify(cp: np.ndarray, edge: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Class of each code point, looking one and two ahead; ``edge`` marks the gaps between texts."""
    c = classes[cp]
    c[edge] = EDGE
    n = len(cp)
    one, two = np.zeros(n, cp.dtype), np.zeros(n, cp.dtype)
    one[:-1], two[:-2] = cp[1:], cp[2:]
    q = np.flatnonzero(cp == 39)
    q = q[c[q] != EDGE]
    a, b = one[q], two[q]
    c[q[np.isin(a, [ord(x) for x in "stmd"])]] = QUOTE1
    pair = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
    c[q[pair]] = QUOTE2
    s = np.flatnonzero(c == SPACE)
    after = np.full(n + 1, EDGE, np.uint8)
    after[:-1] = c
    last = s[(after[s + 1] != SPACE) & (after[s + 1] != EDGE)]
    c[last] = np.where(cp[last] == 32, LAST_BLANK, LAST_OTHER_SPACE)
    return c


def scan(c: np.ndarray) -> np.ndarray:
    """Where pieces begin, by composing transition functions.

    Composition is associative: each block of the text gets its function from all states at once, a short
    scan over blocks gives the state each begins in, and a second pass finds the starts.
    """
    n = len(c)
    rows = -(-n // WIDTH)
    grid = np.full(rows * WIDTH, EDGE, np.uint8)
    grid[:n] = c
    grid = np.ascontiguousarray(grid.reshape(rows, WIDTH).T)
    flat = NEXT.ravel()
    f = np.tile(np.arange(8, dtype=np.uint8), (rows, 1))
    for col in grid:
        f = flat[(col * 8)[:, None] + f]
    state = np.zeros(rows, np.uint8)
    at = END
    functions = f.tolist()
    for k in range(rows):
        state[k] = at
        at = functions[k][at]
    begin = np.zeros((WIDTH, rows), bool)
    flags = STARTS.ravel()
    for k, col in enumerate(grid):
        index = col * 8 + state
        begin[k] = flags[index]
        state = flat[index]
    return begin.T.ravel()[:n]


def pieces(texts: list[bytes], classes: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """One buffer of all texts; starts and ends of pieces in it; the number of pieces before each text."""
    buf = b"\x00".join(texts) + b"\x00"
    raw = np.frombuffer(buf, np.uint8)
    lead = np.flatnonzero((raw & 0xC0) != 0x80)  # byte offset of each code point
    cp = np.frombuffer(buf.decode("utf-8").encode("utf-32-le"), "<u4")
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    edge = np.zeros(len(cp), bool)
    edge[np.searchsorted(lead, ends)] = True
    begin = np.flatnonzero(scan(classify(cp, edge, classes)))
    inner = ~edge[begin]
    starts = lead[begin]
    stops = np.append(starts[1:], len(buf))
    before = np.append(0, np.cumsum(inner))[np.searchsorted(starts, np.append(0, ends[:-1] + 1))]
    return buf, starts[inner], stops[inner], np.append(before, inner.sum())


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Merger:
    """Ids of pieces by merge ranks, with a bounded cache of pieces seen."""

    def __init__(self, path: str, limit: int = 600_000):
        self.ranks, self.limit = load_ranks(path), limit
        self.token = [b""] * (max(self.ranks.values()) + 1)
        for t, i in self.ranks.items():
            self.token[i] = t
        self.size = np.array([len(t) for t in self.token], np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.pool = np.frombuffer(b"".join(self.token), np.uint8)
        self.cache: dict[bytes, bytes] = {}
        self.classes = class_table()
        ranks = self.ranks
        made = [(ranks[t[:k]] << 32 | ranks[t[k:]], i) for t, i in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        made.sort()
        self.keys, self.values = np.array([m[0] for m in made], np.int64), np.array([m[1] for m in made], np.int64)
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], 1 << 40)

    def _merge_equal(self, group: list[bytes], n: int) -> None:
        """Pieces of ``n`` bytes as a matrix: each round merges every row's leftmost lowest pair."""
        ids = self.single[np.frombuffer(b"".join(group), np.uint8).reshape(-1, n)]
        live, size = np.arange(len(group)), np.full(len(group), n)
        rank = np.full((len(group), n), 1 << 40, np.int64)
        rank[:, :-1] = self._rank(ids[:, :-1], ids[:, 1:])
        while len(live):
            at = rank[live].argmin(1)
            low = rank[live, at]
            go = low < 1 << 40
            live, at, low = live[go], at[go], low[go]
            if not len(live):
                break
            cols = np.arange(n)[None, :]
            shift = np.minimum(cols + (cols > at[:, None]), n - 1)
            ids[live] = np.take_along_axis(ids[live], shift, 1)
            rank[live] = np.take_along_axis(rank[live], shift, 1)
            ids[live, at] = low
            size[live] -= 1
            s = size[live]
            rank[live, s - 1] = 1 << 40
            rank[live, np.minimum(s, n - 1)] = 1 << 40
            has = at + 1 < s
            rows, cols = live[has], at[has]
            rank[rows, cols] = self._rank(ids[rows, cols], ids[rows, cols + 1])
            has = at > 0
            rows, cols = live[has], at[has]
            rank[rows, cols - 1] = self._rank(ids[rows, cols - 1], ids[rows, cols])
        small = ids.astype("<u4")
        self.cache.update((p, small[k, :m].tobytes()) for k, (p, m) in enumerate(zip(group, size.tolist())))

    def _merge_long(self, piece: bytes) -> bytes:
        """A long piece, by a heap of adjacent pairs over a linked list."""
        n, ids = len(piece), self.single[np.frombuffer(piece, np.uint8)].tolist()
        nxt, prv, tok = list(range(1, n + 1)), list(range(-1, n - 1)), self.token
        rank = lambda i: self.ranks.get(tok[ids[i]] + tok[ids[nxt[i]]]) if nxt[i] < n else None
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank(i)) is not None]
        heapq.heapify(heap)
        dead = bytearray(n)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = nxt[i] if not dead[i] else n
            if j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], dead[j] = r, 1
            nxt[i] = nxt[j]
            if nxt[j] < n:
                prv[nxt[j]] = i
            for k in (prv[i], i):
                if k >= 0 and (x := rank(k)) is not None:
                    heapq.heappush(heap, (x, k, ids[k], ids[nxt[k]]))
        return np.array([x for x, d in zip(ids, dead) if not d], "<u4").tobytes()

    def learn(self, new: list[bytes]) -> None:
        by: dict[int, list[bytes]] = {}
        for p in new:
            if p in self.ranks:
                self.cache[p] = np.array([self.ranks[p]], "<u4").tobytes()
            elif len(p) > 64:
                self.cache[p] = self._merge_long(p)
            else:
                by.setdefault(len(p), []).append(p)
        for n, group in by.items():
            for k in range(0, len(group), 16384):
                self._merge_equal(group[k : k + 16384], n)

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        if not texts:
            return []
        buf, starts, stops, before = pieces(texts, self.classes)
        if len(self.cache) > self.limit:
            self.cache.clear()
        cut = [buf[s:e] for s, e in zip(starts.tolist(), stops.tolist())]
        ids = list(map(self.cache.get, cut))
        missing = [k for k, x in enumerate(ids) if x is None]
        self.learn(list({cut[k] for k in missing}))
        for k in missing:
            ids[k] = self.cache[cut[k]]
        at = before.tolist()
        return [b"".join(ids[a:b]) for a, b in zip(at, at[1:])]

    def decode(self, streams: list[bytes]) -> list[bytes]:
        """The bytes that each stream of ids stands for, gathered from one pool of all tokens."""
        ids = np.frombuffer(b"".join(streams), "<u4").astype(np.int64)
        size = self.size[ids]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        at = np.repeat(self.first[ids] - (ends - size), size) + np.arange(total)
        out = self.pool[at].tobytes()
        stop = np.append(0, ends)[np.cumsum([len(x) // 4 for x in streams])].tolist() if streams else []
        return [out[a:b] for a, b in zip([0, *stop], stop)]

    def spans(self, ids: bytes) -> np.ndarray:
        """Byte offset of each id's start in the decoded text."""
        return np.cumsum(np.append(0, self.size[np.frombuffer(ids, "<u4")]))[:-1]


@functools.lru_cache(maxsize=1)
def merger(path: str) -> Merger:
    """The merger of this Python worker, kept with its cache for the next tasks."""
    return Merger(path)


def encode(docs: DataFrame, ranks: str, id_col: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, ids and offsets (both unsigned 32-bit little-endian: token ids, and the byte where each begins).

    A null or empty text has no ids. Rows map one to one, whatever repeats; batches are cut to a few MB of
    text, and a longer text is processed alone. ``ranks`` is a path that every executor can read.
    """
    kinds = {c: docs.schema[c].dataType.simpleString() for c in (id_col, *keep)}

    def run(batches):
        m = merger(ranks)
        for batch in batches:
            for b in slices(batch, "_b"):
                ids = m.encode([t or b"" for t in named(b, "_b").to_pylist()])
                offsets = [m.spans(x).astype("<u4").tobytes() for x in ids]
                yield pa.RecordBatch.from_arrays([*(named(b, c) for c in kinds), pa.array(ids, pa.binary()), pa.array(offsets, pa.binary())], names=[*kinds, "ids", "offsets"])

    shape = ", ".join(f"`{c}` {k}" for c, k in kinds.items())
    return text_bytes(docs, *kinds, text=text).mapInArrow(run, f"{shape}, ids binary, offsets binary")


def decode(encoded: DataFrame, ranks: str) -> DataFrame:
    """All columns of ``encoded`` and ``decoded``, the bytes its ids stand for (null ids: null)."""

    def run(batches):
        m = merger(ranks)
        for b in batches:
            ids = named(b, "ids").to_pylist()
            out = [None if x is None else d for x, d in zip(ids, m.decode([x or b"" for x in ids]))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], names=[*b.schema.names, "decoded"])

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(run, shape + ", decoded binary")


def digests(docs: DataFrame, ranks: str, id_col: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), streams: bool = False) -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256, offsets_sha256 (and ids, offsets with ``streams``) for each row.

    Ids, and the bytes where they begin, as unsigned 32-bit little-endian streams. A document is decoded
    from its ids, and the offsets must say where each one's bytes begin there. Null texts count as empty
    ones; repeated rows stay.
    """
    kinds = {c: docs.schema[c].dataType.simpleString() for c in (id_col, *keep)}
    told = ["n_tokens", "ids_sha256", "decoded_sha256", "offsets_sha256", *(["ids", "offsets"] if streams else [])]

    def run(batches):
        m = merger(ranks)
        for batch in batches:
            for b in slices(batch, "_b"):
                ids = m.encode([t or b"" for t in named(b, "_b").to_pylist()])
                offsets = [m.spans(x).astype("<u4").tobytes() for x in ids]
                sha = [[hashlib.sha256(x).hexdigest() for x in some] for some in (ids, m.decode(ids), offsets)]
                n = pa.array([len(x) // 4 for x in ids], pa.int64())
                cols = [n, *map(pa.array, sha), *([pa.array(ids, pa.binary()), pa.array(offsets, pa.binary())] if streams else [])]
                yield pa.RecordBatch.from_arrays([*(named(b, c) for c in kinds), *cols], names=[*kinds, *told])

    shape = ", ".join([*(f"`{c}` {k}" for c, k in kinds.items()), "n_tokens bigint", *(f"{c} string" for c in told[1:4]), *(f"{c} binary" for c in told[4:])])
    return text_bytes(docs, *kinds, text=text).mapInArrow(run, shape)


def _ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op6_byte_bpe(spark: SparkSession, sf_dir: str, ranks: str | None = None) -> DataFrame:
    """doc_id, n_tokens and digests of ids, decoded bytes and offsets of every document, as ``digests`` defines them."""
    return digests(table(spark, sf_dir, "documents"), ranks or _ranks())


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, the id stream with its offsets, and the digests: the corpus as training data."""
    return digests(docs, _ranks(), keep=("lang", "source"), streams=True)
