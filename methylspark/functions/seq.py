"""Sequence, quality, CIGAR and flag functions as Spark columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType


def convert_ct(seq) -> Column:
    """C and c to T."""
    return F.translate(seq, "Cc", "TT")


def convert_ga(seq) -> Column:
    """G and g to A."""
    return F.translate(seq, "Gg", "AA")


def reverse_complement(seq) -> Column:
    """Upper-case reverse complement; anything but A, C, G and T becomes N."""
    return F.arrow_udf(_turned, StringType())(seq)


_COMPLEMENT = np.full(256, ord("N"), np.uint8)
_COMPLEMENT[list(b"ACGTacgt")] = list(b"TGCATGCA")


def _turned(seq: pa.Array) -> pa.Array:
    if not len(seq) or seq.null_count == len(seq):
        return seq
    if not pc.all(pc.string_is_ascii(seq)).as_py():
        return pa.array([None if s is None else _COMPLEMENT[np.frombuffer(s.upper().encode("ascii", "replace"), np.uint8)][::-1].tobytes().decode() for s in seq.to_pylist()], pa.string())
    valid, seq = pc.is_valid(seq), pc.fill_null(seq, "")
    at = np.frombuffer(seq.buffers()[1], np.int32)[seq.offset : seq.offset + len(seq) + 1].astype(np.int64)
    letters = _COMPLEMENT[np.frombuffer(seq.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]]
    at = at - at[0]
    letters = letters[np.repeat(at[:-1] + at[1:] - 1, np.diff(at)) - np.arange(len(letters))]
    text = pa.StringArray.from_buffers(len(seq), pa.py_buffer(at.astype(np.int32)), pa.py_buffer(letters))
    return pc.if_else(valid, text, pa.scalar(None, pa.string()))


def stored_sequence(original, flag) -> Column:
    """The unconverted read as it is stored: reverse-complemented on the reverse strand."""
    return F.when(has_flag(flag, 16), reverse_complement(original)).otherwise(F.upper(original))


def decode_phred(qual) -> Column:
    """Quality characters (offset 33) to numbers."""
    return F.arrow_udf(_decoded, ArrayType(IntegerType()))(qual)


def encode_phred(values) -> Column:
    """Numbers to quality characters (offset 33); characters stay as they are."""
    return F.arrow_udf(_encoded, StringType())(values)


def total_phred(values) -> Column:
    """Sum of each read's qualities, numbers or characters; null with a null among them."""
    return F.arrow_udf(_summed, IntegerType())(values)


def phred_items(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Bounds of each read's qualities, from 0, and the numbers; nulls are empty. Qualities are lists of numbers or characters (offset 33)."""
    if pa.types.is_string(values.type):
        sizes = pc.fill_null(pc.binary_length(values), 0).to_numpy()
        at = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1] if len(values) else [0, 0]
        raw = np.frombuffer(values.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
        if int(sizes.sum()) == len(raw) and (not len(raw) or raw.max() < 128 and raw.min() >= 33):
            return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), pa.array(raw - np.uint8(33))
        values = _decoded(values)
    sizes = pc.fill_null(pc.list_value_length(values), 0).to_numpy()
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), values.flatten()


def _decoded(qual: pa.Array) -> pa.Array:
    if not pc.all(pc.string_is_ascii(qual)).as_py():
        return pa.array([None if q is None else [ord(c) - 33 for c in q] for q in qual.to_pylist()], pa.list_(pa.int32()))
    sizes = pc.fill_null(pc.binary_length(qual), 0).to_numpy()
    raw = np.frombuffer("".join(pc.fill_null(qual, "").to_pylist()).encode(), np.uint8).astype(np.int32) - 33
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(raw))
    return pc.if_else(pc.is_valid(qual), lists, pa.scalar(None, lists.type)) if qual.null_count else lists


def _encoded(values: pa.Array) -> pa.Array:
    if pa.types.is_string(values.type):
        return values
    bounds, items = phred_items(values)
    plain = not items.null_count
    if plain:
        raw = items.to_numpy(zero_copy_only=False).astype(np.int64) + 33
        plain = not len(raw) or 0 <= raw.min() and raw.max() < 128
    if not plain:
        char = lambda q: "" if q < -33 else chr((q + 33) % 256)
        return pa.array([None if v is None else "".join(char(q) for q in v if q is not None) for v in values.to_pylist()], pa.string())
    text = pa.StringArray.from_buffers(len(values), pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(raw.astype(np.uint8)))
    return pc.if_else(pc.is_valid(values), text, pa.scalar(None, pa.string()))


def _summed(values: pa.Array) -> pa.Array:
    bounds, items = phred_items(values)
    if items.null_count:
        return pa.array([None if v is None or None in v else sum(v) for v in values.to_pylist()], pa.int32())
    upto = np.concatenate([[0], np.cumsum(items.to_numpy(zero_copy_only=False), dtype=np.int64)])
    total = pa.array((upto[bounds[1:]] - upto[bounds[:-1]]).astype(np.int32))
    return pc.if_else(pc.is_valid(values), total, pa.scalar(None, pa.int32()))


def has_flag(flag, bit: int) -> Column:
    return flag.bitwiseAND(F.lit(bit)) != 0


def letters(text) -> Column:
    """A string's characters as an array (taken apart once, so that lambdas need not index the string)."""
    return F.slice(F.split(text, ""), 1, F.length(text))


def cigar_ops(cigar) -> Column:
    """array<struct<n, op>>."""
    n = F.transform(F.regexp_extract_all(cigar, F.lit(r"(\d+)([MIDNSHP=X])"), F.lit(1)), lambda x: x.cast("int"))
    op = F.regexp_extract_all(cigar, F.lit(r"(\d+)([MIDNSHP=X])"), F.lit(2))
    return F.zip_with(n, op, lambda a, b: F.struct(a.alias("n"), b.alias("op")))


def cigar_positions(cigar, pos) -> Column:
    """Reference position of each read base, null for inserted and soft-clipped ones.

    Hard-clipped bases are not in the read and take no place.
    """
    run = lambda at, n: F.when(n > 0, F.sequence(at, at + n - 1)).otherwise(F.array().cast("array<int>"))
    none = lambda n: F.array_repeat(F.lit(None).cast("int"), n)

    def step(a, x):
        aligned, moves = x["op"].isin("M", "=", "X"), x["op"].isin("M", "=", "X", "D", "N")
        new = F.when(aligned, run(a["at"], x["n"])).when(x["op"].isin("I", "S"), none(x["n"])).otherwise(F.array().cast("array<int>"))
        return F.struct(F.when(moves, a["at"] + x["n"]).otherwise(a["at"]).alias("at"), F.concat(a["out"], new).alias("out"))

    start = F.struct(pos.cast("int").alias("at"), F.array().cast("array<int>").alias("out"))
    general = F.aggregate(cigar_ops(cigar), start, step, lambda a: a["out"])
    simple = F.regexp_extract(cigar, r"^(\d+)M$", 1)
    return F.when(simple != "", run(pos.cast("int"), F.try_to_number(simple, F.lit("9999999")).cast("int"))).otherwise(general)


def reference_span(cigar) -> Column:
    """Reference bases that an alignment covers."""
    return F.aggregate(F.filter(cigar_ops(cigar), lambda x: x["op"].isin("M", "=", "X", "D", "N")), F.lit(0), lambda a, x: a + x["n"])


def unclipped_start(cigar, pos) -> Column:
    """pos without the leading soft clip (a hard clip may stand before it), 0 at least."""
    clip = F.regexp_extract(cigar, r"^(?:\d+H)?(\d+)S", 1)
    return F.greatest(pos - F.coalesce(F.when(clip != "", clip.cast("int")), F.lit(0)), F.lit(0))


def strand(xr, xg, second_mate) -> Column:
    """OT, OB, CTOT or CTOB from read and genome conversions; the second mate has the other read conversion."""
    first = xr != F.when(second_mate, F.lit("GA")).otherwise(F.lit("CT"))
    return F.when(~first, F.when(xg == "CT", "OT").otherwise("OB")).otherwise(F.when(xg == "CT", "CTOT").otherwise("CTOB"))


def conversions(src_strand) -> tuple[Column, Column]:
    """(XR, XG) labels of strands 0 to 3 (OT, OB, CTOT, CTOB); null without a strand."""
    of = lambda label, strands: F.when(src_strand.isin(*strands), label)
    return F.coalesce(of("CT", (0, 1)), of("GA", (2, 3))), F.coalesce(of("CT", (0, 2)), of("GA", (1, 3)))


def score_min(length, kind: str = "L", a: float = -0.6, b: float = -0.6) -> Column:
    """Least score of an alignment as a function of read length (L, S, G or C), in single precision, cut to int."""
    f = lambda x: x.cast("float")
    n = length.cast("double")
    term = {"L": n, "S": F.sqrt(n), "G": F.ln(n), "C": F.lit(1.0)}[kind]
    return (f(F.lit(a)) + f(F.lit(b)) * f(term)).cast("float").cast("int")


#: Fixed values of the quality table. (least share of the range, quality) without a second alignment.
ALONE = {"end": [(0.8, 42), (0.7, 40), (0.6, 24), (0.5, 23), (0.4, 8), (0.3, 3), (None, 0)], "local": [(0.8, 44), (0.7, 42), (0.6, 41), (0.5, 36), (0.4, 28), (0.3, 24), (None, 22)]}
#: (least share of the score gap, [(least share of the range or "full", quality), ...]) with one.
SECOND = {
    "end": [
        (0.9, [("full", 39), (None, 33)]), (0.8, [("full", 38), (None, 27)]), (0.7, [("full", 37), (None, 26)]), (0.6, [("full", 36), (None, 22)]),
        (0.5, [("full", 35), (0.84, 25), (0.68, 16), (None, 5)]), (0.4, [("full", 34), (0.84, 21), (0.68, 14), (None, 4)]),
        (0.3, [("full", 32), (0.88, 18), (0.67, 15), (None, 3)]), (0.2, [("full", 31), (0.88, 17), (0.67, 11), (None, 0)]),
        (0.1, [("full", 30), (0.88, 12), (0.67, 7), (None, 0)]), ("some", [(0.67, 6), (None, 2)]), (None, [(0.67, 1), (None, 0)]),
    ],
    "local": [
        (0.9, [(None, 40)]), (0.8, [(None, 39)]), (0.7, [(None, 38)]), (0.6, [(None, 37)]), (0.5, [("full", 35), (0.5, 25), (None, 20)]),
        (0.4, [("full", 34), (0.5, 21), (None, 19)]), (0.3, [("full", 33), (0.5, 18), (None, 16)]), (0.2, [("full", 32), (0.5, 17), (None, 12)]),
        (0.1, [("full", 31), (0.5, 14), (None, 9)]), ("some", [(0.5, 11), (None, 2)]), (None, [(0.5, 1), (None, 0)]),
    ],
}


def mapq_sql(score: str, second: str, least: str, mode: str = "end", single=lambda v: f"cast(cast({v} as float) as double)") -> str:
    """SQL of the mapping quality from the best score, the runner-up and the least valid score.

    The text is valid in Spark and in DuckDB. Thresholds are single-precision constants widened to double.
    """
    d, over, gap = f"abs({least})", f"({score} - ({least}))", f"abs(abs({score}) - abs({second}))"

    def ladder(steps):
        out = "case"
        for share, q in steps:
            if share is None:
                return f"{out} else {q} end" if out != "case" else str(q)
            test = f"{over} = {d}" if share == "full" else f"{over} >= {d} * {single(share)}"
            out += f" when {test} then {q}"
        return out

    rest = "case"
    for share, steps in SECOND[mode]:
        if share is None:
            rest += f" else {ladder(steps)} end"
        else:
            rest += f" when {gap} > 0 then {ladder(steps)}" if share == "some" else f" when {gap} >= {d} * {single(share)} then {ladder(steps)}"
    return f"case when {second} < {least} then {ladder(ALONE[mode])} else {rest} end"


def permille(meth, unmeth) -> Column:
    """1000 * meth / (meth + unmeth) in single precision, cut; null without coverage."""
    num = (F.lit(1000.0).cast("float") * meth.cast("float")).cast("double")
    return F.try_divide(num, (meth + unmeth).cast("float").cast("double")).cast("float").cast("int")


def permille_rounded(meth, unmeth) -> Column:
    """1000 * meth / (meth + unmeth), halves away from zero."""
    return F.round(F.try_divide(F.lit(1000.0) * meth, meth + unmeth)).cast("int")


def two_decimals(x, width: int) -> Column:
    """x with two decimals as C's printf has it: exact binary ties go to the even digit.

    Quotients of whole numbers can also be the double nearest to a decimal tie, which lies beside it; the
    hundred such ties of [0, 1] are told apart by a map made here.
    """
    lower = F.floor(x * 100)
    even = F.when(lower % 2 == 0, lower).otherwise(lower + 1) / 100.0
    tie = (x * 8 == F.floor(x * 8)) & (F.floor(x * 8) % 2 == 1)
    beside = F.create_map(*[F.lit(v) for k in range(100) if (2 * k + 1) % 25 for v in ((2 * k + 1) / 200, float("%.2f" % ((2 * k + 1) / 200)))])
    return F.format_string(f"%{width}.2f", F.when(tie, even).otherwise(F.coalesce(beside[x], x)))
