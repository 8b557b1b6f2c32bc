"""Reader of BAM files, in splits."""

from __future__ import annotations

import struct
import zlib
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from methylspark.operators.staging import written

SHAPE = (
    "qname string, flag int, chrom string, pos int, mapq int, cigar string, mate_chrom string, mate_pos int, tlen int, seq string, "
    "qual array<int>, as_score int, xs_score int, nm int, xm string, xx string, xr string, xg string"
)
#: Tags that are read: the first WHOLE are whole numbers, the others texts.
TAGS, WHOLE = ["AS", "XS", "NM", "XM", "XX", "XR", "XG"], 3
#: Names of contigs that together take more bytes are joined without broadcast.
NAMES_BROADCAST = 32 << 20
#: Records in a row that have to look right where a task begins in the middle of a file.
CHAIN = 4
#: Fixed values of the format: mark of a block, base codes, CIGAR codes, sizes of tag values.
MARK = b"\x1f\x8b\x08\x04"
BASES, OPS = "=ACMGRSVTWYHKDBN", "MIDNSHP=X"
NUMBERS = {"A": "c", "c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}
_PAIRS = np.array([(ord(a) + 256 * ord(b)) for a in BASES for b in BASES], "<u2")
_FIXED = np.dtype([("ref", "<i4"), ("pos", "<i4"), ("name", "u1"), ("mapq", "u1"), ("bin", "<u2"), ("cigar", "<u2"), ("flag", "<u2"), ("bases", "<i4"), ("mate_ref", "<i4"), ("mate_pos", "<i4"), ("tlen", "<i4")])
_HEAD = struct.Struct("<iiBBHHHiiii")
#: Bytes of a value of each type of number, 0 for other types.
WIDTH = np.array([struct.calcsize("<" + NUMBERS[chr(k)]) if chr(k) in NUMBERS else 0 for k in range(256)], np.int64)
_TAG_OF = {ord(t[0]) * 256 + ord(t[1]): t for t in TAGS}
#: Bytes of records that are decoded together.
TOGETHER = 4 << 20


def blocks(parts):
    """Contents of the gzip blocks whose bytes, each without its mark, are ``parts``; a block tells its own size.

    A mark that stands inside a block by chance has cut it into several parts, which are put together again.
    """
    held = b""
    for part in parts:
        held += MARK + part
        if len(held) < 18:
            continue
        (extra,) = struct.unpack_from("<H", held, 10)
        k, size = 12, None
        while k + 6 <= min(12 + extra, len(held)):
            (n,) = struct.unpack_from("<H", held, k + 2)
            if held[k : k + 2] == b"BC":
                size = struct.unpack_from("<H", held, k + 4)[0] + 1
            k += 4 + n
        if size is None or len(held) > size:
            raise ValueError("a gzip block does not tell its size")
        if len(held) == size:
            yield zlib.decompress(held[12 + extra : size - 8], -15)
            held = b""
    if held:
        raise ValueError("a file, or one of its splits, ends inside a gzip block")


def chain(buf, at: int = 0) -> tuple[list[int], int]:
    """Where the whole records of ``buf`` begin, and where the rest begins that is no whole record."""
    out, n = [], len(buf)
    while at + 4 <= n:
        size = int.from_bytes(buf[at : at + 4], "little", signed=True)
        if size < _HEAD.size:
            raise ValueError("a record is shorter than its fixed part")
        if at + 4 + size > n:
            break
        out.append(at)
        at += 4 + size
    return out, at


def pieces(data, start: np.ndarray, size: np.ndarray, kind=pa.string()) -> pa.Array:
    """The stretches of ``data`` as an array: all of it is laid out as stretches and gaps in turn, and the stretches are taken."""
    n = len(start)
    if not n:
        return pa.array([], kind)
    bounds = np.empty(2 * n, np.int32)
    bounds[::2], bounds[1::2] = start, start + size
    every = pa.Array.from_buffers(kind, 2 * n - 1, [None, pa.py_buffer(bounds), pa.py_buffer(data)])
    return every.take(pa.array(np.arange(0, 2 * n - 1, 2)))


def _values(pieces_: pa.Array, kind) -> np.ndarray:
    """The bytes of an array of pieces, end to end, as numbers."""
    bounds = np.frombuffer(pieces_.buffers()[1], np.int32)[pieces_.offset : pieces_.offset + len(pieces_) + 1]
    raw = pieces_.buffers()[2]
    return np.frombuffer(memoryview(raw)[bounds[0] : bounds[-1]] if raw else b"", kind)


def _ends(sizes: np.ndarray) -> np.ndarray:
    return np.append(0, np.cumsum(sizes))


def _where(on: np.ndarray, values: pa.Array, other) -> pa.Array:
    """``values``, or ``other`` (null or a text) where not ``on``."""
    if on.all():
        return values
    return pc.if_else(pa.array(on), values, pa.scalar(other, values.type))


def cigars(steps: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Texts of packed CIGAR steps, ``counts`` of them for each record; * for none."""
    n, op = steps >> 4, steps & 15
    digits = 1 + sum((n >= 10**k).astype(np.int64) for k in range(1, 9))
    ends = np.cumsum(digits + 1)
    out = np.empty(ends[-1] if len(ends) else 0, np.uint8)
    out[ends - 1] = np.frombuffer(OPS.encode(), np.uint8)[op]
    for k in range(digits.max(initial=0)):
        on = digits > k
        out[ends[on] - 2 - k] = 48 + n[on] // 10**k % 10
    bounds = np.append(0, ends)[_ends(counts)].astype(np.int32)
    text = pa.Array.from_buffers(pa.string(), len(counts), [None, pa.py_buffer(bounds), pa.py_buffer(out)])
    return _where(counts > 0, text, "*")


def tags(buf: np.ndarray, data, at: np.ndarray, end: np.ndarray) -> list[pa.Array]:
    """Values of TAGS: the k-th tags of all records are read together, then the next ones of those that have more."""
    n = len(at)
    zeros = np.flatnonzero(buf == 0)
    number = {t: np.zeros(n, np.int64) for t in TAGS[:WHOLE]}
    begin, size = {t: end.copy() for t in TAGS[WHOLE:]}, {t: np.zeros(n, np.int64) for t in TAGS[WHOLE:]}
    has = {t: np.zeros(n, bool) for t in TAGS}
    at, todo = at.copy(), np.flatnonzero(at < end)

    def whole(where, kind):
        width = np.dtype(kind).itemsize
        return buf[where[:, None] + np.arange(width)].view(kind)[:, 0]

    while len(todo):
        a = at[todo]
        name, kind, value = buf[a] * np.int64(256) + buf[a + 1], buf[a + 2], a + 3
        width = WIDTH[kind].copy()
        text = (kind == ord("Z")) | (kind == ord("H"))
        width[text] = zeros[np.searchsorted(zeros, value[text])] - value[text] + 1
        many = kind == ord("B")
        width[many] = 5 + whole(value[many] + 1, "<i4") * WIDTH[buf[value[many]]]
        if (width <= 0).any():
            raise ValueError("a tag of unknown type")
        for t in {_TAG_OF.get(x) for x in np.unique(name).tolist()} - {None}:
            mine = np.flatnonzero(name == ord(t[0]) * 256 + ord(t[1]))
            has[t][todo[mine]] = True
            if t in number:
                for code in np.unique(kind[mine]):
                    if chr(code) not in "cCsSiI":
                        raise ValueError(f"tag {t} is no whole number")
                    of = mine[kind[mine] == code]
                    number[t][todo[of]] = whole(value[of], "<" + NUMBERS[chr(code)])
            else:
                begin[t][todo[mine]], size[t][todo[mine]] = value[mine], width[mine] - text[mine]
        at[todo] = value + width
        todo = todo[at[todo] < end[todo]]
    if (at != end).any():
        raise ValueError("tags reach over the end of their record")
    out = []
    for t in TAGS:
        values = pa.array(number[t].astype(np.int32)) if t in number else pieces(data, begin[t], size[t])
        out.append(_where(has[t], values, None))
    return out


def decode(data, starts: list[int]) -> list[pa.Array]:
    """Columns of the records that begin at ``starts``: places of contig and mate's contig in the header (-1: none), then
    SHAPE without their names. All records are decoded together, a column at a time."""
    buf = np.frombuffer(data, np.uint8)
    body = np.array(starts, np.int64) + 4
    f = buf[body[:, None] + np.arange(_FIXED.itemsize)].view(_FIXED)[:, 0]
    size = buf[body[:, None] + np.arange(-4, 0)].view("<i4")[:, 0].astype(np.int64)
    names, counts, n = f["name"].astype(np.int64), f["cigar"].astype(np.int64), f["bases"].astype(np.int64)
    at_steps = body + _FIXED.itemsize + names
    at_bases = at_steps + 4 * counts
    at_quals = at_bases + (n + 1) // 2
    at_tags, end = at_quals + n, body + size
    if (n < 0).any() or (names < 1).any() or (at_tags > end).any():
        raise ValueError("a record is shorter than its parts")
    qname = pieces(data, body + _FIXED.itemsize, names - 1)
    cigar = cigars(_values(pieces(data, at_steps, 4 * counts, pa.binary()), "<u4").astype(np.int64), counts)
    # two letters a byte; of an odd number the last is left out
    letters = _PAIRS[_values(pieces(data, at_bases, (n + 1) // 2, pa.binary()), np.uint8)]
    seq = pieces(letters, 2 * _ends((n + 1) // 2)[:-1], n)
    seq = _where(n > 0, seq, "*")
    quals = _values(pieces(data, at_quals, n, pa.binary()), np.uint8)
    none = n == 0
    none[~none] = buf[at_quals[~none]] == 255
    qual = pa.ListArray.from_arrays(pa.array(_ends(n).astype(np.int32)), pa.array(quals.astype(np.int32)), mask=pa.array(none))
    own = lambda c: pa.array(f[c].astype(np.int32))
    return [own("ref"), own("mate_ref"), qname, own("flag"), own("pos"), own("mapq"), cigar, own("mate_pos"), own("tlen"), seq, qual, *tags(buf, data, at_tags, end)]


def header(buf: bytearray) -> tuple[str, list[tuple[str, int]]] | None:
    """Takes the header from the front of ``buf``: its text, and names and lengths of contigs; None if some of it is still to come."""
    at = 0

    def number() -> int:
        nonlocal at
        (n,) = struct.unpack_from("<i", buf, at)
        at += 4
        return n

    if len(buf) >= 4 and buf[:4] != b"BAM\1":
        raise ValueError("not a BAM file")
    try:
        at = 4
        size = number()
        text = bytes(buf[at : at + size])
        at += size
        contigs = []
        for _ in range(number()):
            n = number()
            if at + n > len(buf):
                return None
            name = buf[at : at + n - 1].decode()
            at += n
            contigs.append((name, number()))
    except struct.error:
        return None
    del buf[:at]
    return text.rstrip(b"\0").decode(), contigs


def first_record(buf: bytearray) -> int | None:
    """Where records begin in the middle of a file: the first place from which all of several records look right.

    None where fewer are held. Too late a place, or none, costs only that more bytes are passed on.
    """

    def right(at: int) -> bool:
        """Does one record, and all after it as far as they are held, fit the format?"""
        seen = 0
        while at + 4 + _HEAD.size <= len(buf):
            (size,) = struct.unpack_from("<i", buf, at)
            ref, pos, n_name, _, _, n_cigar, _, n_seq, mate_ref, mate_pos, _ = _HEAD.unpack_from(buf, at + 4)
            least = _HEAD.size + n_name + 4 * n_cigar + (n_seq + 1) // 2 + n_seq
            if min(ref, pos, mate_ref, mate_pos) < -1 or n_name < 2 or n_seq < 0 or size < least:
                return False
            name = buf[at + 4 + _HEAD.size : at + 4 + _HEAD.size + n_name]
            if len(name) == n_name and (name[-1] or min(name[:-1]) < 33 or max(name[:-1]) > 126):
                return False
            at, seen = at + 4 + size, seen + 1
        return seen >= CHAIN

    return next((k for k in range(len(buf)) if right(k)), None)


def _split(file: str, block: int, parts, records: bool, window: int):
    """Of one split, its whole records (lists of columns), or else rows of what is not one: names of contigs (n) and the
    bytes before (h) and after (t) the whole records."""
    buf, begun, enough = bytearray(), False, window

    def whole(at_least: int):
        nonlocal buf
        if len(buf) >= at_least:
            starts, rest = chain(buf)
            if records and starts:
                yield decode(bytes(memoryview(buf)[:rest]), starts)
            del buf[:rest]

    def begin(at: int | None):
        nonlocal begun
        begun = at is not None
        if not records:
            yield file, block, "h", bytes(buf[:at]), None
        del buf[:at]

    if block == 0:
        next(parts, None)  # what stands before the first mark: nothing
    for data in blocks(parts):
        buf += data
        if not begun and block == 0:
            found = header(buf)
            begun = found is not None
            if begun and not records:
                yield from ((file, block, "n", n.encode(), k) for k, (n, _) in enumerate(found[1]))
        elif not begun and len(buf) >= enough:
            enough, at = 2 * len(buf), first_record(buf)
            if at is not None:
                yield from begin(at)
        if begun:
            yield from whole(TOGETHER)
    if not begun:
        if block == 0:
            raise ValueError("a BAM file or its first split ends inside the header")
        yield from begin(first_record(buf))
    if begun:
        yield from whole(0)
        if not records:
            yield file, block, "t", bytes(buf), None


def read_bam(spark: SparkSession, path: str, window: int = 1 << 18) -> DataFrame:
    """Alignments of every BAM file below ``path``, with the columns of the SAM text reader.

    Files of any size are read in splits: Spark's text reader deals out their bytes, with the mark of a gzip block
    as the end of a line. Inside a file a task looks for the first place from which records fit the format (within
    ``window`` bytes, or more if there is none). A first pass over the files writes down names of contigs and, for
    each split, the bytes before and after its whole records; such bytes of neighbouring splits are put together and
    have to make up whole records, so a wrong place or a file that ends too early is an error and never a wrong row.
    The alignments themselves are decoded by columns when they are read, and not written. A header has to fit
    into one split. Unset reference and mate positions are -1, absent qualities and tags null.
    """
    t = spark.read.option("lineSep", MARK.decode("latin-1")).option("encoding", "ISO-8859-1").option("pathGlobFilter", "*.bam").text(path)
    t = t.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("part"))
    kinds = {"string": pa.string(), "int": pa.int32(), "array<int>": pa.list_(pa.int32())}
    fields = ["file string", "ref int", "mate_ref int", *(f for f in SHAPE.split(", ") if f.split(" ")[0] not in ("chrom", "mate_chrom"))]
    schema = pa.schema([(n, kinds[k]) for n, k in (f.split(" ") for f in fields)])
    shape = ", ".join(fields)

    def rows(file, columns):
        return pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(file, pa.string()), len(columns[0])), *columns], schema=schema)

    def splits(batches):
        lines = ((f, b, p) for batch in batches for f, b, p in zip(*(batch.column(k).to_pylist() for k in range(3))))
        yield from ((f, b, (p for _, _, p in own)) for (f, b), own in groupby(lines, lambda x: x[:2]))

    def edges(batches):
        kinds = [pa.string(), pa.int64(), pa.string(), pa.binary(), pa.int32()]
        for f, b, parts in splits(batches):
            found = list(zip(*_split(f, b, parts, False, window)))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(found, kinds)], ["file", "block", "kind", "piece", "k"])

    def whole(batches):
        for f, b, parts in splits(batches):
            yield from (rows(f, c) for c in _split(f, b, parts, True, window))

    def mend(batches):
        for batch in batches:
            for file, joined in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                starts, rest = chain(joined)
                if rest != len(joined):
                    raise ValueError("a BAM file ends inside a record, or records were not found in one of its splits")
                if starts:
                    yield rows(file, decode(joined, starts))

    # two short pieces a split: a tail goes on with the heads after it
    found = written(t.mapInArrow(edges, "file string, block long, kind string, piece binary, k int"), "bam")
    loose = found.filter("kind in ('h', 't')")
    g = F.count_if(F.col("kind") == "t").over(Window.partitionBy("file").orderBy("block", "kind"))
    parts = F.array_sort(F.collect_list(F.struct("block", "kind", "piece")))
    joined = loose.withColumn("g", g).groupBy("file", "g").agg(F.aggregate(parts, F.lit(b""), lambda a, x: F.concat(a, x["piece"])).alias("joined"))
    records = t.mapInArrow(whole, shape).unionByName(joined.select("file", "joined").mapInArrow(mend, shape))
    names = found.filter("kind = 'n'").select("file", F.col("k").alias("_k"), F.col("piece").cast("string").alias("_name"))
    size = names.agg(F.sum(F.length("_name") + F.length("file") + 16)).first()[0] or 0
    hint = F.broadcast if size <= NAMES_BROADCAST else lambda x: x
    for k, c in (("ref", "chrom"), ("mate_ref", "mate_chrom")):
        own = names.select("file", F.col("_k").alias(k), F.col("_name").alias(c))
        records = records.join(hint(own), ["file", k], "left")
    mate = F.when(F.col("mate_ref") < 0, "*").when(F.col("mate_ref") == F.col("ref"), "=").otherwise(F.col("mate_chrom"))
    out = records.withColumns({"chrom": F.coalesce("chrom", F.lit("*")), "mate_chrom": mate})
    return out.select(*[f.split(" ")[0] for f in SHAPE.split(", ")])
