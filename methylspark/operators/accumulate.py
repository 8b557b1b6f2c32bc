"""Counts per site and per read position, added up in arrays inside the tasks that hold the reads.

The same counts as those of ``extract.calls`` with ``site_counts`` or ``mbias``, without a row for each base: only
what a task has counted at a site leaves it.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from methylspark.functions.seq import phred_items

CONTEXTS = ("CpG", "CHG", "CHH")
STRANDS = ("OT", "OB", "CTOT", "CTOB")
#: Bases that are looked at together, and sites that a task holds before it passes them on.
BASES, SITES = 1 << 20, 1 << 21
#: Sites are dealt to tasks by stretches of two to so many positions.
STRETCH = 13
#: Longest position that fits a key.
_SPAN = 1 << 31
_PLAIN = re.compile(r"\d+M$")
_UPPER = np.arange(256, dtype=np.uint8)
_UPPER[97:123] -= 32
_LETTERS = pa.array([chr(k) for k in range(128)])
#: Context of each letter of a call string, -1 for others; upper case is methylated.
_KIND = np.full(256, -1, np.int8)
for _k, _letter in enumerate("zxh"):
    _KIND[[ord(_letter), ord(_letter.upper())]] = _k


@lru_cache(maxsize=1 << 16)
def _walk(cigar: str) -> np.ndarray:
    """Places of read bases from the alignment's start, -1 for those without one."""
    out, at = [], 0
    for n, op in re.findall(r"(\d+)([MIDNSHP=X])", cigar):
        if op in "M=X":
            out.append(np.arange(at, at + int(n)))
        elif op in "IS":
            out.append(np.full(int(n), -1))
        at += int(n) if op in "MDN=X" else 0
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _text(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a column of texts and where each begins, one more for the end; nulls are empty."""
    column = pc.fill_null(column, "")
    bounds = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    return np.frombuffer(raw, np.uint8) if raw else np.zeros(0, np.uint8), bounds


def _slices(batch: pa.RecordBatch, sizes: np.ndarray, together: int):
    """Runs of rows with about ``together`` bases; a longer read is a run of its own."""
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        to = max(int(np.searchsorted(ends, (ends[at - 1] if at else 0) + together, "right")), at + 1)
        yield batch.slice(at, to - at)
        at = to


def base_calls(batch: pa.RecordBatch, min_phred: int, contexts: tuple[str, ...], bounds: dict | None):
    """(row, index, site, context, methylated) arrays of the calls of good quality of a batch's reads.

    Calls come from ``xm`` where there is such a column, else from ``seq`` and ``ref``.
    """
    col = lambda c: batch.column(batch.schema.get_field_index(c))
    made = "xm" in batch.schema.names
    letters, at_letter = _text(col("xm" if made else "seq"))
    qual = col("qual")
    at_qual, quals = phred_items(qual)
    quals = quals.to_numpy(zero_copy_only=False)
    pos = pc.fill_null(col("pos"), 0).to_numpy().astype(np.int64)
    if (found := _dense(batch, letters, at_letter, at_qual, quals, min_phred)) is not None:
        row, index, place, kind, methylated = found
        keep = _wanted(batch, row, index, kind, contexts, bounds)
        return row[keep], index[keep], (pos[row] + place)[keep], kind[keep], methylated[keep]
    usable = pc.and_(pc.is_valid(col("pos")), pc.is_valid(qual)).to_numpy(zero_copy_only=False)
    if not made:
        window, at_window = _text(col("ref"))
        usable &= pc.is_valid(col("ref")).to_numpy(zero_copy_only=False)
    sizes = np.where(usable, np.minimum(np.diff(at_letter), np.diff(at_qual)), 0)
    # places from the start: the index itself, but for alignments with more than matches
    row, place = _laid(col("cigar"), sizes)
    index = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    good = (place >= 0) & (quals[at_qual[row] + index] >= min_phred)
    top = pc.fill_null(pc.equal(col("xg"), "CT"), False).to_numpy(zero_copy_only=False)
    if made:
        letter = letters[at_letter[row] + index]
        kind = _KIND[letter]
        on = np.flatnonzero(good & (kind >= 0))
        kind, methylated = kind[on], letter[on] < 97
    else:
        at = at_window[row] + 2 + place
        at[~good] = 0
        own = np.where(top, ord("C"), ord("G")).astype(np.uint8)[row]
        window = _UPPER[window] if len(window) else np.zeros(1, np.uint8)
        on = np.flatnonzero(good & (window[at] == own))
        base, own, way = letters[at_letter[row[on]] + index[on]], own[on], np.where(top[row[on]], 1, -1)
        methylated = base == own
        told = methylated | (base == np.where(way > 0, ord("T"), ord("A")))
        on, own, way, methylated = on[told], own[told], way[told], methylated[told]
        other = np.where(way > 0, ord("G"), ord("C"))
        kind = np.where(window[at[on] + way] == other, 0, np.where(window[at[on] + 2 * way] == other, 1, 2))
    row, index, place = row[on], index[on], place[on]
    keep = _wanted(batch, row, index, kind, contexts, bounds)
    return row[keep], index[keep], (pos[row] + place)[keep], kind[keep], methylated[keep]


def _wanted(batch: pa.RecordBatch, row: np.ndarray, index: np.ndarray, kind: np.ndarray, contexts: tuple[str, ...], bounds: dict | None) -> np.ndarray:
    """Which calls are of ``contexts`` and inside ``bounds``."""
    keep = np.array([c in contexts for c in CONTEXTS])[kind]
    if bounds:
        strand, second = (batch.column(batch.schema.get_field_index(c)) for c in ("strand", "second_mate"))
        second = pc.fill_null(second, False).to_numpy(zero_copy_only=False)
        limits = np.array([(bounds.get(s, (0, 0, 0, 0))[2 * m : 2 * m + 2]) for s, m in zip(strand.to_pylist(), second.astype(int))], np.int64).reshape(-1, 2)
        low, high = limits[row, 0], limits[row, 1]
        keep &= (index >= low) & ((high == 0) | (index < high))
    return keep


def _dense(batch: pa.RecordBatch, letters: np.ndarray, at_letter: np.ndarray, at_qual: np.ndarray, quals: np.ndarray, min_phred: int):
    """(row, index, place, kind, methylated) of the calls of whole reads with a quality for each base, None where other reads are among them.

    Letters and qualities then lie side by side, and places are worked out for bases with a call alone.
    """
    col = lambda c: batch.column(batch.schema.get_field_index(c))
    sizes = np.diff(at_letter)
    if any(col(c).null_count for c in ("pos", "qual", "cigar")) or not np.array_equal(sizes, np.diff(at_qual)) or not len(sizes):
        return None
    if "xm" in batch.schema.names:
        call = letters[at_letter[0] : at_letter[-1]]
    elif (call := _call_rows(col("seq"), col("cigar"), col("xg"), col("ref"))) is None:
        return None
    call = call.ravel()
    on = np.flatnonzero((_KIND >= 0)[call] & (quals[at_qual[0] : at_qual[-1]] >= min_phred))
    row = np.repeat(np.arange(len(sizes)), sizes)[on]
    index = on - (at_letter[:-1] - at_letter[0])[row]
    place = _places(col("cigar"), row, index)
    if place is not index:
        laid = place >= 0
        row, index, place, on = row[laid], index[laid], place[laid], on[laid]
    letter = call[on]
    return row, index, place, _KIND[letter].astype(np.int64), letter < 97


def _call_rows(seq: pa.Array, cigar: pa.Array, xg: pa.Array, ref: pa.Array) -> np.ndarray | None:
    """Call strings as rows of bytes, of reads of one length that are all matches; None where others are among them."""
    n = len(seq)
    if not n or seq.null_count or cigar.null_count or xg.null_count or ref.null_count:
        return None
    (base, at), (window, at_window) = _text(seq), _text(ref)
    width = int(at[1] - at[0])
    if not width or (np.diff(at) != width).any() or (np.diff(at_window) != width + 4).any() or not all(_PLAIN.match(c) for c in cigar.unique().to_pylist()):
        return None
    base = base[at[0] : at[-1]].reshape(n, width)
    window = _UPPER[window[at_window[0] : at_window[-1]]].reshape(n, width + 4)
    out = np.full((n, width), ord("."), np.uint8)
    top = pc.equal(xg, "CT").to_numpy(zero_copy_only=False)
    for rows, own, changed, other, way in ((top, "C", "T", "G", 1), (~top, "G", "A", "C", -1)):
        b, w = (base[rows], window[rows]) if not rows.all() else (base, window)
        far = w == ord(other)
        near, next_ = far[:, 2 + way : 2 + way + width], far[:, 2 + 2 * way : 2 + 2 * way + width]
        letter = np.where(near, np.uint8(ord("z")), np.where(next_, np.uint8(ord("x")), np.uint8(ord("h"))))
        same = b == ord(own)
        letter -= same.view(np.uint8) << 5
        out[rows] = np.where((w[:, 2:-2] == ord(own)) & (same | (b == ord(changed))), letter, np.uint8(ord(".")))
    return out


def _laid(cigar: pa.Array, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of each base of reads of ``sizes`` bases: places from the alignment's start, -1 without one."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    first = np.cumsum(sizes) - sizes
    return row, _places(cigar, row, np.arange(len(row)) - first[row] if len(row) else np.zeros(0, np.int64))


def _places(cigar: pa.Array, row: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Places, from their alignments' starts, of bases number ``index`` of reads ``row``; -1 without one. Each distinct cigar is walked once."""
    cigar = pc.fill_null(cigar, "").dictionary_encode()
    texts = cigar.dictionary.to_pylist()
    plain = np.array([bool(_PLAIN.match(c)) for c in texts], bool)
    if plain.all():
        return index
    walks = [_walk("" if p else c) for p, c in zip(plain, texts)]
    size = np.array([len(w) for w in walks])
    of = cigar.indices.to_numpy()[row]
    place = np.where(plain[of], index, -1)
    there = np.flatnonzero(~plain[of] & (index < size[of]))
    place[there] = np.concatenate(walks)[(np.cumsum(size) - size)[of[there]] + index[there]]
    return place


def _strings(sizes: np.ndarray, raw: np.ndarray, valid: pa.Array) -> pa.Array:
    """Texts of ``sizes`` bytes from the bytes of all, null where not ``valid``."""
    bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pc.if_else(valid, pa.StringArray.from_buffers(len(sizes), pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(raw))), pa.scalar(None, pa.string()))


def call_strings(seq: pa.Array, cigar: pa.Array, xg: pa.Array, ref: pa.Array) -> pa.Array:
    """Call string of each read, a dot at bases without a call; null without seq, cigar or ref."""
    if (rows := _call_rows(seq, cigar, xg, ref)) is not None:
        return pa.StringArray.from_buffers(len(rows), pa.py_buffer(np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32)), pa.py_buffer(rows))
    valid = pc.and_(pc.and_(pc.is_valid(seq), pc.is_valid(cigar)), pc.is_valid(ref))
    letters, at = _text(seq)
    sizes = np.diff(at)
    qual = pa.ListArray.from_arrays(pa.array((at - at[0]).astype(np.int32)), pa.array(np.zeros(int(sizes.sum()), np.int32)))
    batch = pa.RecordBatch.from_arrays([seq, cigar, xg, ref, qual, pa.array(np.zeros(len(seq), np.int64))], ["seq", "cigar", "xg", "ref", "qual", "pos"])
    row, index, _, kind, methylated = base_calls(batch, 0, CONTEXTS, None)
    out = np.full(int(sizes.sum()), ord("."), np.uint8)
    out[at[row] - at[0] + index] = np.frombuffer(b"zxh", np.uint8)[kind] - np.where(methylated, 32, 0).astype(np.uint8)
    return _strings(sizes, out, valid)


def mismatch_lines(seq: pa.Array, cigar: pa.Array, xm: pa.Array, ref: pa.Array) -> pa.Array:
    """For each read the runs of matches and mismatching genome bases, a tab, and the number of mismatches."""
    valid = pc.and_(pc.and_(pc.is_valid(seq), pc.is_valid(cigar)), pc.and_(pc.is_valid(ref), pc.is_valid(xm)))
    (base, at), (call, at_call), (window, at_window) = (_text(pc.if_else(valid, c, pa.scalar(None, pa.string()))) for c in (seq, xm, ref))
    sizes = np.minimum(np.diff(at), np.diff(at_call))
    width = int(sizes[0]) if len(sizes) else 0
    if width and all((np.diff(a) == w).all() for a, w in ((at, width), (at_call, width), (at_window, width + 4))) and all(_PLAIN.match(c or "") for c in cigar.unique().to_pylist()):
        # reads of one length that are all matches: letters by rows, and numbers for mismatches alone
        own, made, there = (a[b[0] : b[-1]].reshape(len(sizes), -1) for a, b in ((base, at), (call, at_call), (window, at_window)))
        there = there[:, 2:-2]
        odd = np.flatnonzero((own != there) & (made == ord(".")))
        of, at_odd = odd // width, odd % width
        return _lines(sizes, of, at_odd, there[of, at_odd], valid)
    row, place = _laid(cigar, sizes)
    index = np.arange(len(row)) - (np.cumsum(sizes) - sizes)[row] if len(row) else row
    on = (place >= 0) & (at_window[row] + 2 + place < at_window[row + 1])
    genome = np.full(len(row), ord("N"), np.uint8)
    genome[on] = window[at_window[row[on]] + 2 + place[on]]
    same = (call[at_call[row] + index] != ord(".")) | on & (base[at[row] + index] == genome)
    odd = np.flatnonzero(~same)
    return _lines(sizes, row[odd], index[odd], genome[odd], valid)


def _lines(sizes: np.ndarray, of: np.ndarray, at_odd: np.ndarray, letter: np.ndarray, valid: pa.Array) -> pa.Array:
    """Lines of reads of ``sizes`` bases with mismatches at ``at_odd`` of reads ``of``, in order."""
    # a piece for each mismatch: the matches before it, if there are any or it is the read's first base, and its letter
    first = np.diff(of, prepend=-1) != 0
    before = np.where(first, at_odd, at_odd - np.concatenate([[0], at_odd[:-1]]) - 1)
    runs = pc.if_else(pa.array((before > 0) | (at_odd == 0)), pa.array(before).cast(pa.string()), "")
    pieces = pc.binary_join_element_wise(runs, _LETTERS.take(pa.array(letter)), "")
    n = np.bincount(of, minlength=len(sizes))
    last = np.full(len(sizes), -1, np.int64)
    last[of] = at_odd
    tail = sizes - 1 - last
    lines = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pieces), "")
    ends = pc.if_else(pa.array(tail > 0), pa.array(tail).cast(pa.string()), "")
    out = pc.binary_join_element_wise(lines, ends, "\t", pa.array(n).cast(pa.string()), "")
    return pc.if_else(valid, out, pa.scalar(None, pa.string()))


def count_letters(aln: DataFrame) -> DataFrame:
    """letter (its byte) and n of the letters of call strings: 256 rows a task, none where no read has calls."""

    def run(batches):
        n, seen = np.zeros(256, np.int64), False
        for b in batches:
            column = b.column(0)
            if column.null_count < len(column):
                letters, at = _text(column)
                n += np.bincount(letters[at[0] : at[-1]], minlength=256)
                seen = True
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(256, dtype=np.int32)), pa.array(n)], ["letter", "n"])

    return aln.select("xm").mapInArrow(run, "letter int, n long")


def _needed(aln: DataFrame, *more: str) -> list[str]:
    calls = ["xm"] if "xm" in aln.columns else ["seq", "ref"]
    return [*dict.fromkeys(["pos", "cigar", "qual", "xg", *calls, *more])]


def _parts(batches, together: int = BASES):
    for b in batches:
        name = "xm" if "xm" in b.schema.names else "seq"
        yield from _slices(b, pc.fill_null(pc.binary_length(b.column(b.schema.get_field_index(name))), 0).to_numpy().astype(np.int64), together)


def _mate_bases(mate: pa.StructArray, used: np.ndarray, bounds: dict | None):
    """(row, site, letter, quality) of the bases of mates that are ``used``, inside ``bounds``."""
    col = lambda c: pc.struct_field(mate, c)
    letters, at = _text(col("xm"))
    qual = col("qual")
    ok = used & pc.and_(pc.is_valid(col("pos")), pc.is_valid(qual)).to_numpy(zero_copy_only=False)
    at_qual, quals = phred_items(qual)
    quals = quals.to_numpy(zero_copy_only=False)
    sizes = np.where(ok, np.minimum(np.diff(at), np.diff(at_qual)), 0)
    row, place = _laid(col("cigar"), sizes)
    index = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    on = place >= 0
    if bounds:
        second = pc.fill_null(col("second_mate"), False).to_numpy(zero_copy_only=False)
        limits = np.array([(bounds.get(s, (0, 0, 0, 0))[2 * m : 2 * m + 2]) for s, m in zip(col("strand").to_pylist(), second.astype(int))], np.int64).reshape(-1, 2)
        low, high = limits[row, 0], limits[row, 1]
        on &= (index >= low) & ((high == 0) | (index < high))
    row, index, place = row[on], index[on], place[on]
    pos = pc.fill_null(col("pos"), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return row, pos[row] + place, letters[at[row] + index], quals[at_qual[row] + index].astype(np.int64)


def _span_end(mate: pa.StructArray) -> np.ndarray:
    """Where each mate ends, one beyond its last reference base."""
    cigar = pc.fill_null(pc.struct_field(mate, "cigar"), "").dictionary_encode()
    spans = np.array([sum(int(n) for n, op in re.findall(r"(\d+)([MIDNSHP=X])", c) if op in "MDN=X") for c in cigar.dictionary.to_pylist()] or [0], np.int64)
    return pc.fill_null(pc.struct_field(mate, "pos"), 0).to_numpy(zero_copy_only=False).astype(np.int64) + spans[cigar.indices.to_numpy()]


def template_calls(cls: pa.Array, one: pa.StructArray, two: pa.StructArray, min_phred: int, bounds: dict | None = None):
    """(row, mate, site, letter) of the calls of templates, a place under both mates once; by the rules of ``extract.resolve_overlaps``."""
    named = lambda *names: pc.fill_null(pc.is_in(cls, pa.array(names)), False).to_numpy(zero_copy_only=False)
    both = named("overlap")
    start = np.maximum(*(pc.fill_null(pc.struct_field(m, "pos"), 0).to_numpy(zero_copy_only=False).astype(np.int64) for m in (one, two)))
    end = np.minimum(_span_end(one), _span_end(two))
    out, met = [], []
    for k, (mate, name) in enumerate(((one, "first"), (two, "second"))):
        row, site, letter, q = _mate_bases(mate, named("overlap", "apart", name), bounds)
        shared = both[row] & (site >= start[row]) & (site < end[row])
        met.append((row[shared], site[shared], letter[shared], q[shared]))
        alone = ~shared & (letter != ord(".")) & (q >= min_phred)
        out.append((row[alone], np.full(int(alone.sum()), k), site[alone], letter[alone]))
    # a cell for each place under both mates; where these lie far apart (long gaps), for those with a base alone
    widths = np.where(both, np.maximum(end - start, 0), 0)
    first, cells = np.cumsum(widths) - widths, int(widths.sum())
    at = [first[row] + site - start[row] for row, site, *_ in met]
    if cells > 16 * (len(at[0]) + len(at[1])) + BASES:
        used = np.union1d(*at)
        at, cells = [np.searchsorted(used, a) for a in at], len(used)
    letter, q = np.zeros((2, cells), np.uint8), np.full((2, cells), -1, np.int64)
    held, where = np.zeros((2, cells), bool), np.zeros((2, cells), np.int64)
    for k, (row, site, letters, quals) in enumerate(met):
        letter[k, at[k]], q[k, at[k]], held[k, at[k]] = letters, quals, True
        where[0, at[k]], where[1, at[k]] = row, site
    lone = held[0] != held[1]
    best = np.where(held[0] & (~held[1] | (q[0] >= q[1])), 0, 1)
    own, high = np.where(best == 0, letter[0], letter[1]), np.where(best == 0, q[0], q[1])
    same = letter[0] == letter[1]
    good = np.where(lone, high >= min_phred, np.where(same, high * 1.2 >= min_phred, (np.abs(q[0] - q[1]) >= min_phred) & (q[0] != q[1]))) & (own != ord("."))
    good &= held[0] | held[1]
    out.append((where[0, good], np.where(held[0], 0, 1)[good], where[1, good], own[good]))
    return tuple(np.concatenate(c) for c in zip(*out))


def resolved_calls(templates: DataFrame, keep: list[str], min_phred: int = 5, bounds: dict | None = None) -> DataFrame:
    """``keep`` columns, mate (0 or 1), site and call of each call of templates, a place under both mates once.

    Templates have pair_class and the structs ``one`` and ``two`` with pos, cigar, xm and qual (array; with ``bounds`` also
    strand and second_mate) of their mates, null where there is none. Both mates are in one row, so nothing is shuffled.
    """
    source = templates.select(*keep, "pair_class", "one", "two")

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                b = whole.slice(at, 4096)
                row, mate, site, letter = template_calls(*(b.column(len(keep) + k) for k in range(3)), min_phred, bounds)
                of = pa.array(row)
                columns = [*(b.column(k).take(of) for k in range(len(keep))), pa.array(mate.astype(np.int32)), pa.array(site.astype(np.int32)), _LETTERS.take(pa.array(letter))]
                yield pa.RecordBatch.from_arrays(columns, [*keep, "mate", "site", "call"])

    shape = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.select(*keep).schema), "mate int, site int, call string"])
    return source.mapInArrow(run, shape)


def summed_sites(counted: DataFrame, key: list[str], sums: list[str]) -> DataFrame:
    """Sums by ``key`` (with chrom and start), dealt by stretches of ``STRETCH`` positions.

    Rows of one stretch go to one task in the order they came in, so that what is shuffled are runs of rows that differ little.
    """
    dealt = counted.withColumn("_stretch", F.shiftright("start", STRETCH)).repartition("chrom", "_stretch")
    return dealt.groupBy("_stretch", *key).agg(*[F.sum(c).alias(c) for c in sums]).drop("_stretch")


def count_sites(aln: DataFrame, min_phred: int = 5, contexts: tuple[str, ...] = CONTEXTS, bounds: dict | None = None, sign: bool = False, together: int = BASES, most: int = SITES) -> DataFrame:
    """context, chrom, start, n_meth, n_unmeth (with ``sign`` also the strand): as ``extract.site_counts`` of ``extract.calls``.

    Needs chrom, pos, cigar, qual (array), xg and either xm or seq and ref; with ``bounds`` also strand and second_mate.
    A task counts in arrays and passes on one row for each site it met, so what is shuffled are sites, not bases. It looks
    at ``together`` bases at once and passes on what it has when that are more than ``most`` sites.
    """
    contexts = tuple(contexts)
    return _counted(aln.filter(F.col("chrom").isNotNull()).select(_needed(aln, "chrom", *(("strand", "second_mate") if bounds else ()))), lambda b: _read_calls(b, min_phred, contexts, bounds), _parts, sign, together, most)


def _read_calls(b: pa.RecordBatch, min_phred: int, contexts: tuple[str, ...], bounds: dict | None):
    row, _, site, kind, methylated = base_calls(b, min_phred, contexts, bounds)
    chrom, xg = (b.column(b.schema.get_field_index(c)) for c in ("chrom", "xg"))
    return row, site, kind, methylated, chrom, xg


def count_template_sites(templates: DataFrame, min_phred: int = 5, contexts: tuple[str, ...] = CONTEXTS, bounds: dict | None = None, together: int = BASES, most: int = SITES) -> DataFrame:
    """context, chrom, start, n_meth, n_unmeth over templates as in ``resolved_calls``, whose mates also have chrom and xg."""
    wanted = [CONTEXTS.index(c) for c in contexts]

    def calls(b):
        one, two = b.column(1), b.column(2)
        row, mate, site, letter = template_calls(b.column(0), one, two, min_phred, bounds)
        kind = _KIND[letter]
        on = np.isin(kind, wanted)
        at = row[on] + mate[on] * b.num_rows
        chrom, xg = (pa.concat_arrays([pc.struct_field(one, c), pc.struct_field(two, c)]) for c in ("chrom", "xg"))
        return at, site[on], kind[on].astype(np.int64), letter[on] < 97, chrom, xg

    def parts(batches, _):
        for b in batches:
            yield from (b.slice(at, 4096) for at in range(0, b.num_rows, 4096))

    return _counted(templates.select("pair_class", "one", "two"), calls, parts, False, together, most)


def _counted(source: DataFrame, calls, parts, sign: bool, together: int, most: int) -> DataFrame:
    def run(batches):
        codes, keys, counts = {}, np.zeros(0, np.int64), np.zeros((0, 2), np.int64)
        waiting, held = [], 0

        def merged():
            every = np.concatenate([keys, *(k for k, _ in waiting)])
            each = np.concatenate([counts, *(c for _, c in waiting)])
            found, of = np.unique(every, return_inverse=True)
            return found, np.stack([np.bincount(of, each[:, j], len(found)) for j in (0, 1)], 1).astype(np.int64)

        def rows():
            names = pa.array(list(codes), pa.string())
            for at in range(0, len(keys), 1 << 16):
                k, n = keys[at : at + (1 << 16)], counts[at : at + (1 << 16)]
                place = k // 6
                columns = [pa.array(CONTEXTS).take(pa.array(k % 6 // 2)), names.take(pa.array(place // _SPAN)), pa.array((place % _SPAN).astype(np.int32)), pa.array(k % 2 == 0), pa.array(n[:, 0]), pa.array(n[:, 1])]
                yield pa.RecordBatch.from_arrays(columns, ["context", "chrom", "start", "top", "n_meth", "n_unmeth"])

        for b in parts(batches, together):
            row, site, kind, methylated, chrom, xg = calls(b)
            if not len(row):
                continue
            chrom = chrom.dictionary_encode()
            code = np.array([codes.setdefault(c, len(codes)) for c in chrom.dictionary.to_pylist()], np.int64)
            low = pc.equal(xg, "CT")
            low = ~pc.fill_null(low, False).to_numpy(zero_copy_only=False)
            at = code[pc.fill_null(chrom.indices, 0).to_numpy()]
            key = ((at[row] * _SPAN + site) * 3 + kind) * 2 + (low[row] if sign else 0)
            found, of = np.unique(key, return_inverse=True)
            n = np.bincount(of, methylated, len(found)).astype(np.int64)
            waiting.append((found, np.stack([n, np.bincount(of, minlength=len(found)) - n], 1)))
            held += len(found)
            if held > most:
                keys, counts = merged()
                waiting, held = [], 0
                if len(keys) > most:
                    yield from rows()
                    codes, keys, counts = {}, np.zeros(0, np.int64), np.zeros((0, 2), np.int64)
        if waiting:
            keys, counts = merged()
        yield from rows()

    shape = "context string, chrom string, start int, top boolean, n_meth long, n_unmeth long"
    counted = source.mapInArrow(run, shape)
    if not sign:
        return summed_sites(counted, ["context", "chrom", "start"], ["n_meth", "n_unmeth"])
    return summed_sites(counted.withColumn("sign", F.when(F.col("top"), "+").otherwise("-")), ["context", "chrom", "start", "sign"], ["n_meth", "n_unmeth"])


def count_mbias(aln: DataFrame, min_phred: int = 5, bounds: dict | None = None) -> DataFrame:
    """strand, read, position (from 1), n_meth, n_unmeth of CpG calls: as ``extract.mbias`` of ``extract.calls``.

    A task holds one array of counts by strand, mate and position and passes on what is not zero.
    """

    def run(batches):
        total = np.zeros((len(STRANDS) * 2, 0, 2), np.int64)
        for b in _parts(batches):
            row, index, _, _, methylated = base_calls(b, min_phred, ("CpG",), bounds)
            if not len(row):
                continue
            of = {s: k for k, s in enumerate(STRANDS)}
            group = np.array([2 * of.get(s, -1) + bool(m) for s, m in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("strand", "second_mate")))])[row]
            if (group < 0).any():
                raise ValueError("a read with calls has no strand")
            width = max(total.shape[1], int(index.max()) + 1)
            cell = (group * width + index) * 2 + ~methylated
            total = np.pad(total, ((0, 0), (0, width - total.shape[1]), (0, 0))) + np.bincount(cell, minlength=len(STRANDS) * 4 * width).reshape(-1, width, 2)
        group, index = np.nonzero(total.sum(2))
        n = total[group, index]
        yield pa.RecordBatch.from_arrays([pa.array(STRANDS).take(pa.array(group // 2)), pa.array((group % 2 + 1).astype(np.int32)), pa.array((index + 1).astype(np.int32)), pa.array(n[:, 0]), pa.array(n[:, 1])], ["strand", "read", "position", "n_meth", "n_unmeth"])

    counted = aln.select(_needed(aln, "strand", "second_mate")).mapInArrow(run, "strand string, read int, position int, n_meth long, n_unmeth long")
    return counted.groupBy("strand", "read", "position").agg(F.sum("n_meth").alias("n_meth"), F.sum("n_unmeth").alias("n_unmeth"))


def call_maps(aln: DataFrame, keep: list[str], min_phred: int = 5, words: int = 4) -> DataFrame:
    """``keep`` columns, meth, unmeth and calls of each read: bit maps as ``dedup.call_maps`` makes them, and how many calls they hold.

    Needs pos, cigar, qual (array), xg and either xm or seq and ref. A map has ``words`` words of 62 bits, longer reads
    have as many more as they fill.
    """
    source = aln.select(*keep, *[F.col(c).alias(f"_{c}") for c in _needed(aln)])
    kinds = source.select(*keep).schema

    def run(batches):
        for whole in batches:
            own = whole.select([n for n in whole.schema.names if n.startswith("_")]).rename_columns([n[1:] for n in whole.schema.names if n.startswith("_")])
            size = pc.fill_null(pc.binary_length(own.column(own.schema.get_field_index("xm" if "xm" in own.schema.names else "seq"))), 0).to_numpy().astype(np.int64)
            at = 0
            for b in _slices(own, size, BASES):
                row, index, _, _, methylated = base_calls(b, min_phred, CONTEXTS, None)
                n = np.maximum(-(-size[at : at + len(b)] // 62), words)
                bounds = np.append(0, np.cumsum(n))
                maps = []
                for on in (methylated, ~methylated):
                    bits = np.zeros(bounds[-1], np.int64)
                    # a position has one call, so bits never meet twice
                    np.add.at(bits, bounds[row[on]] + index[on] // 62, np.int64(1) << (index[on] % 62))
                    maps.append(pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(bits)))
                calls = pa.array(np.bincount(row, minlength=len(b)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([*(whole.column(k).slice(at, len(b)) for k in range(len(keep))), *maps, calls], [*keep, "meth", "unmeth", "calls"])
                at += len(b)

    shape = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds), "meth array<long>, unmeth array<long>, calls int"])
    return source.mapInArrow(run, shape)
