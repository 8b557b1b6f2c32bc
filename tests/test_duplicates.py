"""Greedy duplicate marking of keys with very many maps, in rounds, against the plain loop."""

import random

import pytest
from pyspark.sql import functions as F

from methylspark.operators import dedup

SHAPE = "read_id long, key string, meth array<long>, unmeth array<long>, calls int, phred int"


def plain(rows):
    """A read is a duplicate if an earlier kept one of its key contradicts it nowhere."""
    want, kept = {}, {}
    for n, key, m, u, *_ in sorted(rows, key=lambda r: (-r[4], -r[5], r[0])):
        own = kept.setdefault(key, [])
        m, u = (sum(w << 62 * k for k, w in enumerate(x)) for x in (m, u))
        want[n] = any(not (m ^ a) & (u ^ b) for a, b in own)
        if not want[n]:
            own.append((m, u))
    return want


def library(rng, n, key, places, missing, words=1, kinds=64):
    """Reads of molecules that differ at some of ``places``, with calls missing at random."""
    molecules = [[rng.random() < 0.5 for _ in range(places)] for _ in range(kinds)]
    out = []
    for k in range(n):
        own = rng.choice(molecules)
        m, u = [0] * words, [0] * words
        for p, on in enumerate(own):
            if rng.random() >= missing:
                (m if on != (rng.random() < 0.02) else u)[p // 62] |= 1 << p % 62
        out.append((key, m, u, sum(x.bit_count() for x in m + u), rng.randrange(5)))
    return out


@pytest.mark.parametrize("missing,places,words", [(0.1, 40, 1), (0.6, 12, 1), (0.3, 90, 2)])
def test_rounds_equal_the_plain_loop(spark, missing, places, words):
    rng = random.Random(places)
    rows = library(rng, 700, "hot", places, missing, words) + library(rng, 90, "b", places, missing, words) + library(rng, 150, None, 5, 0.5) + [("e", [0], [0], 0, 1)] * 3
    rows = [(k, *r) for k, r in enumerate(rows)]
    want = plain(rows)
    df = spark.createDataFrame(rows, SHAPE).repartition(5)
    for row_maps in (0, 40):
        assert {r.read_id: r.duplicate for r in dedup.mark_duplicates(df, ["key"], row_maps=row_maps).collect()} == want
    assert len(set(want.values())) == 2


def test_a_chain_of_decisions(spark):
    """Map k can only be decided after map k - 1: as many rounds as the chain has links, and the answer stays right."""
    n = 12
    rows = []
    for k in range(n):
        m, u = [0], [0]
        # neighbours are compatible, maps further apart contradict each other
        for j in range(n):
            if abs(j - k) > 1:
                (m if j < k else u)[0] |= 1 << (min(j, k) * n + max(j, k)) % 61
        rows.append((k, "k", m, u, n - k, 0))
    want = plain(rows)
    got = dedup.mark_duplicates(spark.createDataFrame(rows, SHAPE), ["key"], row_maps=0)
    assert {r.read_id: r.duplicate for r in got.collect()} == want


def test_cells_bring_compatible_maps_together(spark, monkeypatch):
    monkeypatch.setattr(dedup, "CELL_MAPS", 1)
    rng = random.Random(2)
    rows = [(k, *r) for k, r in enumerate(library(rng, 300, "k", 20, 0.3))]
    maps = spark.createDataFrame([(r[0], r[2], r[3]) for r in rows], "id long, meth array<long>, unmeth array<long>").withColumn("_key", F.struct(F.lit("k").alias("key")))
    cells = {}
    for r in dedup._cells(maps).select("id", "cell").collect():
        cells.setdefault(r.id, set()).add(r.cell)
    assert len(set().union(*cells.values())) > 100
    at = {r[0]: (r[2][0], r[3][0]) for r in rows}
    for a in at:
        for b in at:
            if not (at[a][0] ^ at[b][0]) & (at[a][1] ^ at[b][1]):
                assert cells[a] & cells[b], (a, b)
