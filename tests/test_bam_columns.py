"""Columnar decoding of BAM records against a decoder that takes one record at a time."""

import random
import struct

import pytest

from methylspark.sources import bam


def packed(rng, k):
    """Bytes of one random record and what it says, as plain values."""
    name = "".join(rng.choice("abcXYZ09:/#") for _ in range(rng.randrange(1, 40)))
    n = rng.choice([0, 1, 2, 7, 60, 151])
    seq = "".join(rng.choice(bam.BASES) for _ in range(n))
    steps = [(rng.choice([1, 9, 10, 99, 100, 12345, (1 << 28) - 1]), rng.randrange(9)) for _ in range(rng.choice([0, 1, 1, 3, 8]))]
    qual = None if n and rng.random() < 0.2 else [rng.randrange(94) for _ in range(n)]
    numbers = dict(flag=rng.randrange(4096), pos=rng.randrange(-1, 2**31 - 1), mapq=rng.randrange(256), mate_pos=rng.randrange(-1, 10**6), tlen=rng.randrange(-(10**6), 10**6), ref=rng.randrange(-1, 9), mate_ref=rng.randrange(-1, 9))
    codes = [bam.BASES.index(x) for x in seq] + [0] * (n % 2)
    body = struct.pack("<iiBBHHHiiii", numbers["ref"], numbers["pos"], len(name) + 1, numbers["mapq"], 4680, len(steps), numbers["flag"], n, numbers["mate_ref"], numbers["mate_pos"], numbers["tlen"])
    body += name.encode() + b"\0" + b"".join(struct.pack("<I", a << 4 | o) for a, o in steps) + bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2])) + (b"\xff" * n if qual is None else bytes(qual))
    values, extra = {}, []
    for t in bam.TAGS[: bam.WHOLE]:
        if rng.random() < 0.7:
            kind, low, high = rng.choice([("c", -128, 127), ("C", 0, 255), ("s", -(2**15), 2**15 - 1), ("S", 0, 2**16 - 1), ("i", -(2**31), 2**31 - 1), ("I", 0, 2**31 - 1)])
            values[t] = rng.randint(low, high)
            extra.append(t.encode() + kind.encode() + struct.pack("<" + bam.NUMBERS[kind], values[t]))
    for t in bam.TAGS[bam.WHOLE :]:
        if rng.random() < 0.7:
            values[t] = "".join(rng.choice("zZxXhH.=10") for _ in range(rng.randrange(0, 200)))
            extra.append(t.encode() + b"Z" + values[t].encode() + b"\0")
    extra += rng.sample([b"RGZgroup\0", b"MDH00FF\0", b"ZAAx", b"ZFf" + struct.pack("<f", 1.5), b"ZBBs" + struct.pack("<ihh", 2, 0, 8), b"ZCBI" + struct.pack("<i", 0), b"ZDBf" + struct.pack("<if", 1, 0.0)], rng.randrange(7))
    rng.shuffle(extra)
    body += b"".join(extra)
    cigar = "".join(f"{a}{bam.OPS[o]}" for a, o in steps) or "*"
    none = None if not n or qual is None else qual
    plain = (numbers["ref"], numbers["mate_ref"], name, numbers["flag"], numbers["pos"], numbers["mapq"], cigar, numbers["mate_pos"], numbers["tlen"], seq or "*", none, *(values.get(t) for t in bam.TAGS))
    return struct.pack("<i", len(body)) + body, plain


def test_columns_equal_plain_records():
    rng = random.Random(8)
    for count in (1, 2, 3, 400):
        made = [packed(rng, k) for k in range(count)]
        data = b"".join(raw for raw, _ in made)
        starts, rest = bam.chain(data + b"\x50\0\0\0half")
        assert rest == len(data) and len(starts) == count
        assert list(zip(*(c.to_pylist() for c in bam.decode(data, starts)))) == [plain for _, plain in made]


def test_broken_records_are_errors():
    rng = random.Random(1)
    raw = bytearray(packed(rng, 0)[0])
    with pytest.raises(ValueError, match="shorter"):
        bam.chain(struct.pack("<i", 3) + bytes(40))
    many = bytearray(raw)
    many[4 + 16 : 4 + 20] = struct.pack("<i", 10**6)
    with pytest.raises(ValueError, match="shorter than its parts"):
        bam.decode(bytes(many), [0])
    plain = struct.pack("<iiBBHHHiiii", 0, 5, 2, 9, 0, 0, 0, 0, -1, -1, 0) + b"r\0"
    for extra, match in ((b"XXq1", "unknown type"), (b"ASZ5\0", "whole number"), (b"ASi\1\0", "reach over")):
        with pytest.raises((ValueError, IndexError), match=match if match != "reach over" else "reach over|out of bounds"):
            bam.decode(struct.pack("<i", len(plain + extra)) + plain + extra, [0])
