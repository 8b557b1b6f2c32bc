"""Spelling variants, conversation repair and sharding against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from methylspark.llm import conversations, sharding, spelling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    return tmp_path_factory.mktemp("tables")


def stored(spark, folder, name, rows, shape):
    path = str(folder / f"{random.random()}")
    spark.createDataFrame(rows, shape).repartition(3).write.parquet(f"{path}/{name}.parquet")
    return path


# spelling ------------------------------------------------------------------------------------------------------


def words_of(rows):
    seen = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            k = h % len(run)
            seen[run[:k] + run[k + 1 :] if h % 31 == 0 else run] += 1
    return {w: n for w, n in seen.items() if len(w) >= 7 and n >= 2}


def one_edit(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) == len(b) + 1 and any(a[:k] + a[k + 1 :] == b for k in range(len(a)))


def expected(words):
    form, out = {}, []
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    for w in words:
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 10 * words[w] else None
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, words[w], len(near[w]), words.get(form[w])))
    return sorted(out)


def spelled(seed, n):
    r = random.Random(seed)
    base = ["".join(r.choice("abcéß") for _ in range(r.randint(6, 10))) for _ in range(40)]
    out = []
    for _ in range(n):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 0, 0, 0, 1, 1, 2])):
            k = r.randrange(len(w))
            w[k : k + r.choice([0, 1])] = r.choice(["", "a", "b", "ab"])
        out.append("".join(w).upper() if r.random() < 0.1 else "".join(w))
    return " ".join(out)


def test_spelling_equals_brute_force(spark, folder):
    texts = [None, "", " 12 !", "Ünïon÷s×", spelled(1, 3000), spelled(2, 3000), spelled(2, 3000), spelled(3, 60_000), "x" * 50_000, "aaaaaaaa aaaaaaa aaaaaaaa aaaaaaa"]
    rows = [(k, t) for k, t in enumerate(texts)] + [(4, texts[4]), (None, texts[5])]
    path = stored(spark, folder, "documents", [(*r, "n", 1) for r in rows], "doc_id long, text string, word string, n int")
    got = spelling.op11_spelling(spark, path).collect()
    want = expected(words_of(rows))
    assert sorted(map(tuple, got), key=lambda r: r[0]) == want
    assert any(r[1] and r[2] != r[1] for r in want) and max(r[4] for r in want) > 20
    assert spelling.op11_spelling(spark, stored(spark, folder, "documents", [], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("share", [1, 50, 10**6])
def test_spelling_loses_no_pair_by_any_dictionary(spark, share):
    """Empty, small and full dictionaries: longer grams never cost a near word."""
    words = sorted({w for w in spelled(share, 1500).split() if len(w) >= 2})
    df = spark.createDataFrame([(w, 1) for w in words], "word string, n long")
    dictionary = spelling.gram_dictionary(df, share)
    got = Counter((r.word, r.near) for r in spelling.near_words(df, dictionary).collect())
    assert got == Counter((a, b) for a in words for b in words if one_edit(a, b))
    assert share > 1 or not dictionary


def test_gram_bound_keeps_grams_of_both_words(spark):
    """Grams that one word calls intact at a place stand in the other at the same distance from start or end."""
    r = random.Random(9)
    for _ in range(300):
        g = spelling.Grams({"".join(r.choice("ab") for _ in range(r.choice([3, 4]))) for _ in range(5)})
        w = "".join(r.choice("abc") for _ in range(r.randint(7, 12)))
        k = r.randrange(len(w))
        v = w[:k] + r.choice("abc") + w[k + 1 :]
        assert {x[0] for x in g.keys(w) if x[1:] == (k, True)} == {x[0] for x in g.keys(v) if x[1:] == (k, True)}
        v = w[:k] + w[k + 1 :]
        assert {x[0] for x in g.keys(w) if x[1:] == (k, True)} == {x[0] for x in g.keys(v) if x[1:] == (k, False)}


# conversations -------------------------------------------------------------------------------------------------


def cheapest(rows):
    """(cost, audit) of the least edits from each row's end on, all states side by side."""
    after = {"": 0, "s": 1, "u": 2, "a": 3}
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    none = (10**9, "~")
    best = {s: (0, "") if s in (after[""], after["a"]) else none for s in range(4)}

    def put_in(now):
        for _ in range(3):
            now = {s: min(v, (3 + now[3 if s == 2 else 2][0], "I" + now[3 if s == 2 else 2][1])) for s, v in now.items()}
        return now

    best = put_in(best)
    for initial, wrong in reversed(rows):
        now = {}
        for s in range(4):
            ways = [(4 + best[s][0], "D" + best[s][1])]
            if wrong not in ("blank", "duplicate"):
                more = 3 if wrong else 0
                if (s, initial) in step:
                    to = best[step[s, initial]]
                    ways.append((more + to[0], "K" + to[1]))
                to = best[3 if s == 2 else 2]
                ways.append((3 + more + to[0], "R" + to[1]))
            now[s] = min(ways)
        best = put_in(now)
    return best[0]


def test_repair_finds_the_least_of_the_cheapest_edits():
    r = random.Random(4)
    for n in range(30):
        for _ in range(40):
            rows = [(r.choice(["s", "u", "a", "u", "a", "x", ""]), r.choice([None, None, None, "blank", "duplicate", "truncated"])) for _ in range(n)]
            assert conversations.repair(rows) == cheapest(rows), rows
    long = [("ua"[k % 2] if r.random() < 0.8 else r.choice("sua"), r.choice([None] * 9 + ["blank", "duplicate", "truncated"])) for k in range(20_000)]
    assert conversations.repair(long) == cheapest(long)
    # a heuristic that knows nothing gives the same answer at more bounds
    blocks, conversations.BLOCKS = conversations.BLOCKS, 10**9
    try:
        rows = long[:150]
        assert conversations.repair(rows) == cheapest(rows)
    finally:
        conversations.BLOCKS = blocks


def repaired(conv, rows):
    """One conversation by plain rules: rows are (turn, role, text) as given."""
    kept = []
    for turn, role, text in rows:
        sign = " " if turn is None else turn
        way = zlib.crc32(f"{' ' if conv is None else conv}:{sign}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if way == 1:
            text = ""
        if way == 2:
            text = re.sub("[.!?]", "", text)
        if way == 4:
            role = "user"
        kept += [] if way == 0 else [(turn, role, text)] * (2 if way == 3 else 1)
    kept.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode()))
    facts, seen = [], set()
    for _, role, text in kept:
        ink = text.strip(" \t\n\v\f\r")
        facts.append((role[:1], "blank" if not ink else "duplicate" if (role, text) in seen else "truncated" if ink[-1] not in ".!?" else None))
        seen.add((role, text))
    cost, audit = cheapest(facts)
    out, left, at, now = [], None, 0, ""
    for e in audit:
        due = "assistant" if now == "u" else "user"
        if e == "K":
            out.append(f"{kept[at][1]}:{kept[at][2]}")
            now = kept[at][1][:1]
        elif e in "RI":
            out.append(f"{due}:{kept[at][2] if e == 'R' else ''}")
            now = due[0]
        at += e != "I"
    turns = [t for t, _, _ in kept if t is not None]
    kinds = Counter(f[1] for f in facts)
    illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(facts, facts[1:]))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (conv, gaps, kinds["blank"], kinds["duplicate"], kinds["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def test_conversations_equal_plain_rules(spark, folder):
    r = random.Random(7)
    text = lambda: r.choice([None, "", " \t", "Yes.", "No", "What? ", "ä" * r.randint(1, 40) + r.choice(".!? x")])
    role = lambda: r.choice(["user", "assistant", "user", "assistant", "system", None, "", "tool"])
    rows = [(c, r.choice([t, t, t, t, t + 3, None, 0]), role(), text()) for c in [*range(120), None] for t in range(r.randint(0, 9))]
    rows += [(500, t, "ua"[t % 2] + "ser", f"{t % 50}.") for t in range(3000)] + [(501, 1, "user", "Long " * 200_000 + ".")] + [(502, None, "user", "Hi.")] * 3
    lost = next(c for c in range(1000, 2000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows += [(lost, 0, "user", "Gone.")]
    path = stored(spark, folder, "conversations", [(*x, 1, "a") for x in rows], "conv_id long, turn long, role string, text string, cost int, audit string")
    got = sorted(map(tuple, conversations.op12_conversation_repair(spark, path).collect()), key=repr)
    own = {}
    for c, *x in rows:
        own.setdefault(c, []).append(x)
    assert got == sorted((repaired(c, x) for c, x in own.items()), key=repr)
    assert (lost, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest()) in got
    assert conversations.op12_conversation_repair(spark, stored(spark, folder, "conversations", [], "conv_id long, turn long, role string, text string")).count() == 0


def test_repaired_rows_are_what_the_digest_covers(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "You?"), (1, 2, "assistant", "Fine"), (2, 0, "assistant", "Hello.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    digests = {x.conv_id: x.repaired_sha256 for x in conversations.repair_conversations(df).collect()}
    lines = {}
    for x in conversations.repaired_rows(df).orderBy("conv_id", "place").collect():
        lines.setdefault(x.conv_id, []).append(f"{x.role}:{x.text}")
    assert lines == {1: ["user:Hi.", "assistant:", "user:You?", "assistant:Fine"], 2: ["user:", "assistant:Hello."]}
    assert {c: hashlib.sha256("\n".join(x).encode()).hexdigest() for c, x in lines.items()} == digests


# sharding ------------------------------------------------------------------------------------------------------


def shard_of(key, weights):
    bids = []
    for k, w in enumerate(weights):
        u = (int(hashlib.md5(f"{k}:{key}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        bids.append((math.log(u) / w if w else -math.inf, -k))
    return -max(bids)[1]


def test_sharding_equals_plain_rendezvous(spark, folder):
    texts = [None, "", "a", "ñ" * 200_000, "same", "same"]
    rows = [(k, texts[k % 6], "x", 9) for k in range(900)] + [(7, "hot", "x", 9)] * 500 + [(None, "none", None, None)] * 3
    path = stored(spark, folder, "documents", rows, "doc_id long, text string, shard string, slot int")
    got = sharding.op13_sharding(spark, path).collect()
    name = lambda i: "" if i is None else i
    raw = lambda t: (t or "").encode()
    want = Counter((i, len(raw(t)) + 1, zlib.crc32(raw(t)), "key", shard_of(name(i), [1] * 16), shard_of(name(i), [1] * 17)) for i, t, *_ in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32, r.law, r.shard, r.grown_shard) for r in got) == want
    assert all(r.grown_shard in (r.shard, 16) for r in got)
    for k in range(16):
        own = sorted((r.slot, r.doc_id is not None, r.doc_id or 0) for r in got if r.shard == k)
        assert [x[0] for x in own] == list(range(len(own))) and [x[1:] for x in own] == sorted(x[1:] for x in own)
    assert sharding.op13_sharding(spark, stored(spark, folder, "documents", [], "doc_id long, text string")).count() == 0


def test_weights_share_keys_and_growth_moves_few(spark):
    keys = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key"))
    weights, more = [1.0, 2.0, 0.0, 5.0], [1.0, 2.0, 0.0, 6.0]
    got = keys.select("key", sharding.rendezvous(F.col("key"), weights).alias("a"), sharding.rendezvous(F.col("key"), more).alias("b")).collect()
    n = Counter(r.a for r in got)
    assert all(abs(n[k] / 20_000 - w / 8) < 0.02 for k, w in enumerate(weights))
    assert all(r.a == r.b or r.b == 3 for r in got) and sum(r.a != r.b for r in got) < 0.06 * 20_000
    assert all(r.a == shard_of(r.key, weights) for r in got[:500])
    with pytest.raises(ValueError):
        sharding.rendezvous(F.col("key"), [0.0])


def test_written_shards(spark, folder):
    docs = spark.createDataFrame([(k % 90, f"t{k}", k) for k in range(300)], "doc_id long, text string, slot int")
    path = str(folder / "shards")
    placed = sharding.assign(docs, [1.0, 3.0])
    sharding.write_shards(placed, path, rows_per_file=40)
    back = spark.read.parquet(path)
    assert sorted((r.shard, r.slot, *r.doc) for r in back.collect()) == sorted((r.shard, r.slot, *r.doc) for r in placed.collect())
    per_file = [r.n for r in back.groupBy(F.input_file_name()).agg(F.count("*").alias("n")).collect()]
    assert max(per_file) <= 40 and len(per_file) >= 8
    assert {r.rows for r in sharding.moves(sharding.assign(docs, [1.0], [1.0])).collect()} == {300}
