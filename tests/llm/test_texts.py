"""Text operators against plain Python on small tables with nulls, empty and long texts, ties and repeats."""

import hashlib
import math
import os
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from methylspark.llm import bpe, decontaminate, simhash, token_store, toxicity
from methylspark.llm.common import work_dir
from methylspark.llm.components import connected_components

WORDS = [f"w{k}" for k in range(400)]


def prose(seed, n):
    r = np.random.default_rng(seed)
    return " ".join(r.choice(WORDS, n))


TEXTS = [None, "", " \t\n", "One two", "It's  the  end.\n\n1234 ñandú!!'s 'll", "Ünï " * 3000, prose(1, 50), prose(1, 50), prose(2, 900), "'" * 300]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "en", "s", len(t or ""), "clash", 1) for k, t in enumerate(TEXTS)]
    rows += [(3, "One two", "en", "s", 7, "clash", 1), (None, prose(1, 50), None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fp string, n int").repartition(3)


def test_bpe_equals_tiktoken(spark, docs):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})

    def want(t):
        ids = np.array(enc.encode_ordinary(t or ""), "<u4").tobytes()
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()

    got = bpe.digests(docs, path, keep=("lang",)).drop("offsets_sha256").collect()
    full = bpe.digests(docs, path, streams=True).collect()
    m = bpe.Merger(path)
    for x in full:
        size = [len(m.token[i]) for i in np.frombuffer(x.ids, "<u4")]
        assert np.frombuffer(x.offsets, "<u4").tolist() == [sum(size[:k]) for k in range(len(size))][: len(size)] or len(size) > 500
        assert x.ids_sha256 == hashlib.sha256(x.ids).hexdigest() and x.offsets_sha256 == hashlib.sha256(x.offsets).hexdigest()
    src = [(r.doc_id, r.lang, *want(r.text)) for r in docs.collect()]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, src))
    r = np.random.default_rng(5)
    signs = list("ab's'tréllvemd  \n\t ١二!?.\x1f\x00é😀ß́")
    texts = ["".join(r.choice(signs, r.integers(0, 50))) for _ in range(3000)] + ["ab" * 4000, "aé " * 300]
    m = bpe.Merger(path)
    out = m.encode([t.encode() for t in texts])
    assert [np.frombuffer(x, "<u4").tolist() for x in out] == [enc.encode_ordinary(t) for t in texts]
    assert m.decode(out) == [t.encode() for t in texts]


def test_bpe_offsets_and_round_trip(spark, docs):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    got = bpe.decode(bpe.encode(docs, path), path).select("doc_id", "ids", "offsets", "decoded").collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    m = bpe.Merger(path)
    for r in got:
        raw = (texts[r.doc_id] or "").encode()
        assert bytes(r.decoded) == raw
        ids, at = np.frombuffer(r.ids, "<u4"), np.frombuffer(r.offsets, "<u4")
        assert all(raw[o : o + len(m.token[i])] == m.token[i] for i, o in zip(ids, at))


def test_token_store_round_trip(spark, docs):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    ids = [(r.doc_id, tok.encode(r.text or "", add_special_tokens=False).ids + [2]) for r in rows]
    at, want = 0, []
    for k, x in ids:
        want.append((k, at, len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
        at += len(x)
    folder = work_dir(spark, "store")
    token_store.write_store(docs, folder, path, 2)
    got = [tuple(r) for r in token_store.read_store(spark, folder).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    back = [(r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in token_store.read_documents(spark, folder).collect()]
    assert sorted(map(repr, back)) == sorted(map(repr, ids))
    chunks = spark.read.parquet(f"{folder}/parts/kind=chunk")
    assert chunks.count() == chunks.select("hash").distinct().count()


def test_word_encoder_equals_library(tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok, enc = Tokenizer.from_file(path), token_store.WordEncoder(path, limit=500)
    assert enc.by_word
    r = np.random.default_rng(6)
    signs = list("abzAZ'srtÉéßñÜ×÷ÿİſ019.,!?-_<|>#\u0301\u00a0\u2003\x1c٣中 \n\t  ") + ["<|endoftext|>", "the", "'ll", "ing"]
    texts = ["", " "] + ["".join(r.choice(signs, r.integers(0, 40))) for _ in range(4000)]
    for part in (texts[:3000], texts[3000:], texts[:10], []):
        ids, bounds = enc.encode([t.encode() for t in part], 2)
        assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [tok.encode(t, add_special_tokens=False).ids + [2] for t in part]
    other = public_tokenizers.path("byte_bpe_50k.json")
    enc, tok = token_store.WordEncoder(other), Tokenizer.from_file(other)
    assert not enc.by_word
    ids, bounds = enc.encode([t.encode() for t in texts[:50]], 2)
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [tok.encode(t, add_special_tokens=False).ids + [2] for t in texts[:50]]


def test_token_store_finds_damage(spark, docs):
    folder = work_dir(spark, "store")
    token_store.write_store(docs, folder, public_tokenizers.path("word_bpe_49k.json"), 2)
    assert token_store.read_store(spark, folder).count() == docs.count()
    kinds = {t: spark.read.parquet(f"{folder}/{t}") for t in ("parts", "recipes", "manifest", "root")}

    def damaged(change):
        other = work_dir(spark, "store")
        for t, df in kinds.items():
            w = change(t, df).write
            (w.partitionBy("kind") if t == "parts" else w).parquet(f"{other}/{t}")
        return other

    byte = F.concat(F.expr("substring(data, 1, length(data) - 4)"), F.lit(b"\x01\x00\x00\x00"))
    part = kinds["recipes"].agg(F.max("part")).first()[0]
    hurt = {
        "does not match its address": lambda t, d: d.withColumn("data", byte) if t == "parts" else d,
        "not in the store": lambda t, d: d.orderBy("hash").offset(1) if t == "parts" else d,
        "do not match the manifest": lambda t, d: d.filter(F.col("part") != part) if t == "recipes" else d,
        "do not match the manifest ": lambda t, d: d.filter("pos <> 0") if t == "recipes" else d,
        "do not match the manifest  ": lambda t, d: d.filter(F.col("part") != part) if t == "manifest" else d,
        "does not match its root": lambda t, d: d.filter(F.col("part") != part) if t in ("manifest", "recipes") else d,
        "does not match its root ": lambda t, d: d.limit(0) if t == "root" else d,
    }
    for told, change in hurt.items():
        with pytest.raises(Exception, match=told.strip()):
            token_store.read_store(spark, damaged(change)).collect()
    import glob

    os.remove(sorted(glob.glob(f"{folder}/recipes/part-*"))[0])
    with pytest.raises(ValueError, match="do not match the manifest"):
        token_store.read_store(spark, folder)


def test_token_store_of_no_documents(spark, docs):
    folder = work_dir(spark, "store")
    token_store.write_store(docs.limit(0), folder, public_tokenizers.path("word_bpe_49k.json"), 2)
    assert token_store.read_store(spark, folder).count() == token_store.read_documents(spark, folder).count() == 0


def plain_merkle(leaves):
    level = leaves or [token_store.digest(b"")]
    while len(level) > 1:
        up = [token_store.digest(b"\x01" + a + b) for a, b in zip(level[::2], level[1::2])]
        level = up + level[len(up) * 2 :]
    return level[0]


def test_merkle_roots():
    for n in range(40):
        leaves = [token_store.digest(bytes([k])) for k in range(n)]
        assert token_store.merkle(leaves) == plain_merkle(leaves)


def test_cuts_follow_content():
    r = np.random.default_rng(3)
    a = r.integers(0, 49000, 20000)
    b = np.concatenate([r.integers(0, 49000, 777), a])
    ends = lambda x: token_store.cuts(x)[0]
    pieces = lambda x: {x[s:e].tobytes() for s, e in zip([0, *ends(x)], ends(x))}
    assert len(pieces(a) & pieces(b)) > 0.8 * len(pieces(a))
    sizes = np.diff([0, *ends(a)])
    assert sizes.sum() == len(a) and sizes.max() <= token_store.MOST and sizes[:-1].min() >= token_store.LEAST
    assert ends(a[:0]) == [] and ends(a[:5]) == [5]
    # streams laid end to end are cut as each one alone is
    streams = [a[:0], a[:5], b[:64], b[:65], a, np.zeros(9000, np.int64), b, a[:1], b[:3000]]
    bounds = np.append(0, np.cumsum([len(x) for x in streams]))
    got, counts = token_store.cuts(np.concatenate(streams), bounds)
    assert counts == [len(ends(x)) for x in streams]
    assert got == [e + s for x, s in zip(streams, bounds.tolist()) for e in ends(x)]


def test_shift_crc():
    r = np.random.default_rng(0)
    for n in (0, 1, 4, 1000, 65537):
        x, y = r.bytes(50), r.bytes(n)
        part = int(token_store.shift_crc(np.array([zlib.crc32(x)]), np.array([n]))[0])
        assert part ^ zlib.crc32(y) == zlib.crc32(x + y)


def plain_fingerprint(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    g = [" ".join(w)] if len(w) < 3 else [" ".join(w[i : i + 3]) for i in range(len(w) - 2)]
    h = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in g]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def plain_components(ids, links):
    comp = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(comp[a], comp[b])
            if comp[a] != low or comp[b] != low:
                comp[a] = comp[b] = low
                changed = True
    return comp


def test_simhash_against_brute_force(spark, docs):
    clean = docs.filter("doc_id is not null")
    base = prose(7, 300).split()
    near = [(100 + k, " ".join(base[:k] + base[k + 1 :])) for k in range(40)]
    clean = clean.select("doc_id", "text").unionByName(spark.createDataFrame(near, "doc_id long, text string"))
    fp = {(r.doc_id, r.text): plain_fingerprint(r.text) for r in clean.collect()}
    keys = list(fp)
    links = [(a[0], b[0]) for i, a in enumerate(keys) for b in keys[:i] if bin(fp[a] ^ fp[b]).count("1") <= 2]
    comp = plain_components([k[0] for k in keys], links)
    got = simhash.near_duplicates(clean).select("doc_id", "fingerprint", "component_id").collect()
    want = sorted((r.doc_id, f"{fp[(r.doc_id, r.text)]:016x}", comp[r.doc_id]) for r in clean.collect())
    assert sorted(map(tuple, got)) == want
    assert len({c for k, c in comp.items() if k >= 100}) < 40


def test_simhash_grid_loses_no_link(spark):
    r = np.random.default_rng(2)
    fps = set(r.integers(-(2**63), 2**63 - 1, 300).tolist())
    for x in list(fps)[:150]:
        bits = r.choice(64, r.integers(1, 4), replace=False)
        y = (x & (2**64 - 1)) ^ sum(1 << int(b) for b in bits)
        fps.add(y - 2**64 if y >> 63 else y)
    fps = sorted(fps)
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    got = {tuple(x) for x in simhash.link_fingerprints(df).collect()}
    want = {(a, b) for a in fps for b in fps if a < b and bin((a ^ b) & (2**64 - 1)).count("1") <= 2}
    assert got == want and want


def test_simhash_grid_follows_the_number_of_rows(spark):
    assert [simhash.spare_groups(n, 2) for n in (0, 1, 10**6, 10**9)] == [3, 3, 3, 3]
    assert simhash.spare_groups(10**11, 2) > 3 and simhash.spare_groups(2**63, 2) <= 30
    rng = np.random.default_rng(8)
    fps = [int(x) for x in rng.integers(0, 2**63, 150)]
    fps += [f ^ (1 << int(a)) ^ (1 << int(b)) for f, a, b in zip(fps, rng.integers(0, 63, 150), rng.integers(0, 63, 150))]
    df = spark.createDataFrame([(f,) for f in set(fps)], "fp long")
    want = {(a, b) for a in set(fps) for b in set(fps) if a < b and (a ^ b).bit_count() <= 2}
    for spare in (3, 5, 9):
        assert {(r.a, r.b) for r in simhash.link_fingerprints(df, 2, spare).collect()} == want


def test_components(spark):
    r = np.random.default_rng(9)
    edges = r.integers(0, 400, (300, 2)).tolist() + [[1000 + k, 1001 + k] for k in range(60)] + [[5, 5], [None, 3]]
    df = spark.createDataFrame(edges, "src long, dst long")
    real = [(a, b) for a, b in edges if a is not None and a != b]
    comp = plain_components({x for e in real for x in e}, real)
    assert {r.node: r.component for r in connected_components(df).collect()} == comp
    assert connected_components(df.limit(0)).count() == 0


def test_decontamination(spark):
    items = [(k, prose(50 + k, 40)) for k in range(6)] + [(6, "short one"), (7, None), (8, "")]
    w = items[0][1].split()
    moved = " ".join(w[25:] + ["gap"] + w[10:25] + ["x", "y"] + w[:10])
    rows = [(1, prose(1, 200)), (2, prose(2, 80) + " " + items[1][1].upper() + ". " + prose(3, 80)), (3, prose(4, 30) + " " + moved), (4, " ".join(w[:20])), (5, None), (6, ""), (7, "short one"), (8, (items[2][1] + " ") * 5), (8, (items[2][1] + " ") * 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    near = decontaminate.matches(docs, bench)
    want = [(2, 1, 1.0, 1, 40), (3, 0, 1.0, 3, 15), (8, 2, 1.0, 1, 40), (8, 2, 1.0, 1, 40)]
    assert sorted(map(tuple, near.collect())) == want
    assert decontaminate.matches(docs, bench.limit(0)).count() == 0
    assert decontaminate.matches(docs.limit(0), bench).count() == 0


def plain_tiles(doc, item, least):
    """Greedy string tiling by trying every pair of places, longest first."""
    fd, fi, out = [True] * len(doc), [True] * len(item), []
    while True:
        best = (0, 0, 0)
        for p in range(len(item)):
            for d in range(len(doc)):
                n = 0
                while d + n < len(doc) and p + n < len(item) and fd[d + n] and fi[p + n] and doc[d + n] == item[p + n]:
                    n += 1
                if n > best[0]:
                    best = (n, p, d)
        n, p, d = best
        if n < least:
            return out
        fd[d : d + n] = [False] * n
        fi[p : p + n] = [False] * n
        out.append((d, p, n))


def test_tiles_are_those_of_brute_force():
    r = np.random.default_rng(11)
    for k in range(2500):
        signs, least = int(r.integers(2, 7)), int(r.integers(2, 6))
        item = r.integers(0, signs, r.integers(1, 40)).tolist()
        doc = r.integers(0, signs, r.integers(1, 60)).tolist()
        if k % 3 == 0:  # reordered passages
            parts = np.array_split(np.array(item), int(r.integers(1, 5)))
            doc = [int(x) for p in r.permutation(len(parts)) for x in parts[p]]
        assert decontaminate.tiles(doc, item, least) == plain_tiles(doc, item, least)
    assert sum(n for *_, n in decontaminate.tiles([1] * 20000, [1] * 1000, 5)) == 1000


def test_decontamination_against_brute_force(spark):
    r = np.random.default_rng(12)
    word = ["a", "b", "c", "d"]
    items = {k: " ".join(r.choice(word, r.integers(5, 25))) for k in range(12)}
    texts = []
    for k in range(300):
        w = items[int(r.integers(12))].split()
        at = int(r.integers(len(w)))
        texts.append(" ".join([*r.choice(word, 3), *w[at:], *r.choice(word, r.integers(0, 3)), *w[:at]]))
    want = []
    for d, t in enumerate(texts):
        for k, i in items.items():
            got = plain_tiles(t.split(), i.split(), 5)
            share = sum(n for *_, n in got) / len(i.split())
            if share >= 0.8:
                want.append((d, k, share, len(got), max(n for *_, n in got)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    assert sorted(map(tuple, decontaminate.matches(docs, bench).collect())) == sorted(want) and want


def test_stages_decide_by_row(spark, tmp_path):
    item = prose(60, 40)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, item, 1), (None, prose(61, 50), 2), (1, prose(61, 50), 3), (1, prose(61, 50), 4), (2, prose(62, 50), 5), (2, prose(63, 50) + " " + item, 6), (None, None, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, uid int")
    kept = decontaminate.stage(spark, docs, str(tmp_path)).collect()
    assert sorted(x.uid for x in kept) == [2, 3, 4, 5, 7]
    kept = simhash.stage(spark, docs, str(tmp_path)).collect()
    assert len(kept) == 5 and {1, 5, 6, 7} < {x.uid for x in kept}
    assert len([x for x in kept if x.text == prose(61, 50)]) == 1 and {x.doc_id for x in kept if x.text == prose(61, 50)} == {1}


def test_toxicity_learns_from_document_labels(spark):
    r = np.random.default_rng(4)
    rows, labels = [], []
    for k in range(900):
        s = [" ".join(r.choice(WORDS, 8)) for _ in range(int(r.integers(1, 30)))]
        bad = k % 7 == 0
        if bad:
            at = int(r.integers(len(s)))
            s[at] += " " + r.choice(["slurx", "slury", "slurzen"])
        rows.append((k, ". ".join(s)))
        labels.append((k, int(bad)))
    rows += [(5000, None), (5001, ""), (5002, ". ".join(prose(k, 9) for k in range(3000))), (None, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame(labels + [(1, None), (None, 1)], "doc_id long, toxic int"))
    got = {x.doc_id: x for x in toxicity.score(docs, model).collect()}
    assert all(got[k].predicted == y for k, y in labels)
    assert got[5000].score == got[5001].score == 0 and got[5002].predicted == 0 and got[None].held_out is False
    assert all(got[k].held_out == (zlib.crc32(str(k).encode()) % 5 == 0) for k, _ in labels)
    spots = toxicity.offending(docs, model).collect()
    assert spots and all("slur" in x.sentence for x in spots)
    texts = dict(rows)
    assert all(texts[x.doc_id][x.start : x.end] == x.sentence for x in spots)
    even = toxicity.fit([(t, 1) for t, (_, y) in zip((x for _, x in rows), labels) if y] + [(prose(k, 60), 0) for k in range(129)])
    assert even.document("fine. a slury here.") >= 0.5 > even.document(prose(3, 500))
    none = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score(docs, none).filter("predicted = 1").count() == 0


def test_toxicity_scores_are_those_of_plain_noisy_or(spark):
    import math
    import re

    r = np.random.default_rng(13)
    word = [f"{a}{b}x" for a in "abcdefgh" for b in "stuvwz"]
    weights = {f: float(r.uniform(0, 9)) for w in word[::2] for f in (w + "$", w[:3])}
    texts = [". ".join(" ".join(r.choice(word, r.integers(1, 6))) for _ in range(r.integers(1, 60))) for _ in range(200)] + [None, "", "...", "\n"]
    docs = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(texts)], "doc_id long, text string, score string")
    got = {x.doc_id: x for x in toxicity.score(docs, toxicity.Model(weights)).collect()}
    for k, t in enumerate(texts):
        p = []
        for s in re.split(r"[.!?\n|]", t or ""):
            own = {f for w in re.findall(r"\w+", s.lower()) for f in (w + "$", *(w[:n] for n in (3, 4, 5, 6) if len(w) >= n)) for f in [(w, f)]}
            z = sum(weights.get(f, 0.0) for _, f in own)
            if z:
                p.append((1 / (1 + math.exp(12.0 - z)), s))
        want = 1 - math.prod(1 - x for x, _ in p)
        assert abs(got[k].score - want) < 1e-9 and got[k].predicted == int(got[k].score >= 0.5)
        if got[k].predicted:
            assert abs(got[k].worst_score - max(p)[0]) < 1e-9
            assert t[got[k].worst_start : got[k].worst_end].strip(" .") in [s.strip() for x, s in p if abs(x - got[k].worst_score) < 1e-9]
        else:
            assert got[k].worst_start is None
    assert len({x.predicted for x in got.values()}) == 2


@pytest.mark.parametrize("n", [10, 1000, 1001, 20_000, 100_000])
def test_toxicity_is_one_noisy_or_at_every_length(n):
    """Strong and weak evidence and none, in texts of up to 10^5 sentences: the product over all sentences, nothing else."""
    r = np.random.default_rng(n)
    model = toxicity.Model({"slurx$": 20.0, "half$": 11.8, "mild$": 6.0, "faint$": 2.0, "odd$": 4.5}, floor=-9.5)
    words = np.array(["plain", "faint", "odd", "mild", "half"])
    for share in (0.0, 1e-5, 1e-3, 0.05, 0.5):
        picks = np.where(r.random(n) < share, r.integers(1, 5, n), 0)
        text = ". ".join(f"a {w}" for w in words[picks])
        clean = sum(math.log1p(-model.sentence(f"a {w}")) for w in words[picks])
        assert abs(model.document(text) - (1 - math.exp(clean))) < 1e-9
    five = "half. " * 5
    for more in (900, 5000, n):
        assert abs(model.document(five + "plain. " * more) - (1 - (1 - model.sentence("half")) ** 5)) < 1e-9
    assert model.sentence("faint") == 0.0 < model.sentence("odd") < model.sentence("half") < 0.5


def test_toxicity_of_long_clean_texts(spark):
    """A model fitted on short texts leaves long clean ones alone, and finds one toxic sentence in them."""
    r = np.random.default_rng(21)
    rows = []
    for k in range(600):
        s = [" ".join(r.choice(WORDS, 7)) + (" mild word" if r.random() < 0.02 else "") for _ in range(int(r.integers(1, 25)))]
        if k % 3 == 0:
            s[int(r.integers(len(s)))] += " slurx" + (" mild" if k % 2 else "")
        rows.append((". ".join(s), int(k % 3 == 0)))
    model = toxicity.fit(rows)
    assert model.weights and toxicity.PRIOR <= model.floor < 0
    numbers = "0.12\n" * 500_000
    clean = {
        "numbers": numbers,
        "prose": ". ".join(" ".join(WORDS[k % 390 : k % 390 + 5]) for k in range(200_000)),
        "log": "\n".join(f"2024-01-01 host{k % 7} | ok | {k}" for k in range(100_000)),
        "weak": "a mild word. w1. w2. w3. w4.\n" * 50_000,
    }
    for name, t in clean.items():
        assert model.document(t) < 0.5, name
    assert model.document(numbers) == 0.0
    assert model.document(numbers + "a slurx here") >= 0.5 and model.document("a slurx here\n" + clean["weak"]) >= 0.5
    docs = spark.createDataFrame([(1, numbers), (2, numbers + "a slurx here"), (2, numbers + "a slurx here"), (3, "slurx. slurx. fine")], "doc_id long, text string")
    got = toxicity.score(docs, model).collect()
    assert sorted((x.doc_id, x.predicted) for x in got) == [(1, 0), (2, 1), (2, 1), (3, 1)]
    # of sentences with equal scores the first is the worst
    assert [(x.worst_start, x.worst_end) for x in got if x.doc_id == 3] == [(0, 6)]


def test_token_store_brings_hot_chunks_by_broadcast(spark):
    """Half of the documents are empty and many are copies: their chunks' steps are dealt over all tasks, and nothing is lost."""
    rows = [(k, None if k % 2 else prose(k, 30) if k % 3 else prose(7, 2000), k) for k in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, hash int")
    folder = work_dir(spark, "store")
    path = public_tokenizers.path("word_bpe_49k.json")
    token_store.write_store(docs, folder, path, 2)
    recipes = spark.read.schema(token_store.RECIPES).parquet(f"{folder}/recipes")
    chunks = spark.read.parquet(f"{folder}/parts").filter("kind = 'chunk'").select("hash", F.lit(1).alias("n"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        met = token_store._with_chunks(recipes, chunks)
        sizes = sorted(r.n for r in met.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect())
        assert sizes[-1] < 1.5 * sizes[0] and met.filter("n is null").count() == 0
        assert {(r.doc_id, r.n_tokens) for r in token_store.read_store(spark, folder).collect()} >= {(1, 1), (3, 1)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old[0])
        spark.conf.set("spark.sql.adaptive.enabled", old[1])
    ids = {r.doc_id: bytes(r.ids) for r in token_store.read_documents(spark, folder).collect()}
    assert len(ids) == 6000 and ids[1] == np.array([2], "<u4").tobytes() and ids[0] == ids[6] != ids[2]
