"""Archives, embeddings, licenses, secrets, rollups and the pipeline on small tables."""

from concurrent.futures import ThreadPoolExecutor
import base64
import gzip
import hashlib
import os
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from methylspark.llm import embeddings, licenses, secrets, token_counts, warc
from methylspark.llm.common import materialize, salted_join, work_dir


def test_warc_round_trip(spark):
    html = ["<p>é</p>", "", None, "<p>é</p>", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n", "\r\n\r\n", "x" * 70000, ""]
    pages = spark.createDataFrame([(k, f"http://h/{k}\r\nX: y", h, "old") for k, h in enumerate(html)] + [(0, "u", "<p>é</p>", "")], "page_id long, url string, html string, record_type string")
    captures = warc.plan_captures(pages)
    folder = work_dir(spark, "warc")
    warc.write_archives(captures, folder, file_bytes=900)
    names = [n for n in os.listdir(folder) if not n.startswith((".", "_"))]
    assert len(names) > 1 and all(n.endswith(".warc.gz") for n in names)
    raw = b"".join(gzip.decompress(open(f"{folder}/{n}", "rb").read()) for n in names)
    assert raw.count(b"WARC-Type: warcinfo") == len(names) and raw.count(b"WARC/1.1\r\nWARC-Type") == 3 * pages.count() + len(names)
    records = warc.read_archives(spark, folder)
    assert records.count() == 3 * pages.count() + len(names)
    mains = {r.record_id: r.record_type for r in records.filter("record_type in ('response', 'revisit')").collect()}
    assert len(mains) == pages.count()
    assert all(mains[r.refers_to] == "response" for r in records.filter("record_type = 'revisit'").collect())
    got = warc.assemble(records).collect()
    assert len(got) == pages.count()
    bodies = []
    for r in got:
        assert len(r.requests) == len(r.metadata) == 1
        body = bytes(r.block).split(b"\r\n\r\n", 1)[1]
        page = re.search(rb"page-id: (\d+)", bytes(r.metadata[0].block))[1]
        if r.record_type == "response":
            assert r.digest == "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode()
            bodies.append((int(page), body.decode()))
        else:
            assert body == b""
    rows = {(r.page_id, r.html): r for r in captures.collect()}
    assert sorted(bodies) == sorted((k, h) for (k, h), r in rows.items() if r.record_type == "response" for _ in range(2 if (k, h) == (0, "<p>é</p>") else 1))
    assert rows[(3, "<p>é</p>")].refers_to == 0 and rows[(7, "")].refers_to == 1 and rows[(2, "")].record_type == "revisit"
    big = warc.plan_captures(pages, min_bytes=1)
    assert {r.record_type for r in big.filter("html = ''").collect()} == {"response"}


def test_warc_indirect_and_empty(spark):
    row = ("<r>", "response", None, None, "u", "d", "sha1:x", "t", b"b", None)
    parts = [("<q>", "request", "<r>", *row[3:]), ("<m>", "metadata", "<q>", *row[3:]), ("<o>", "metadata", "<gone>", *row[3:])]
    df = spark.createDataFrame([row, *parts], warc.RECORD)
    got = warc.assemble(df).collect()
    assert len(got) == 1 and [x.record_id for x in got[0].requests + got[0].metadata] == ["<q>", "<m>"]
    assert warc.assemble(df.limit(0)).count() == 0
    twice = warc.assemble(df.unionByName(df.limit(1))).collect()
    assert len(twice) == 2 and all(len(x.requests) == len(x.metadata) == 1 for x in twice)


def test_warc_reports_lost_and_changed_payloads(spark, tmp_path):
    html = [(k, f"http://h/{k}", h) for k, h in enumerate(["a", "b", "a", None, "\xff\r\n\r\n", "a"])] + [(None, "u", "a"), (0, "u", "a")]
    spark.createDataFrame(html, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.op2_warc(spark, str(tmp_path)).collect()), key=repr)
    assert got == sorted([(0, 1, "response", None), (0, 1, "response", None), (1, 1, "response", None), (2, 1, "revisit", 0), (3, 0, "response", None), (4, 6, "response", None), (5, 1, "revisit", 0), (None, 1, "revisit", 0)], key=repr)
    folder = work_dir(spark, "warc")
    warc.write_archives(warc.plan_captures(spark.read.parquet(f"{tmp_path}/pages.parquet")), folder)
    records = materialize(warc.read_archives(spark, folder), "records")
    for bad in (records.filter("record_type <> 'response'"), records.withColumn("block", F.when(F.col("record_type") == "response", F.lit(b"x")).otherwise(F.col("block")))):
        with pytest.raises(Exception, match="missing or does not match"):
            warc.report(warc.assemble(bad)).collect()


def test_warc_reader_is_linear_in_members():
    r = np.random.default_rng(0)
    block = bytes(r.integers(97, 100, 9500, np.uint8))
    one = warc._member(warc._record("resource", [("WARC-Record-ID", "<x>")], block))
    start = time.process_time()
    assert sum(len(b) for _, b in warc.parse_records(one * 4000)) == 9500 * 4000
    assert time.process_time() - start < 4
    assert [b for _, b in warc.parse_records(zlib.decompress(one, 31) * 3)] == [block] * 3


def test_embeddings_against_brute_force(spark):
    r = np.random.default_rng(1)
    rows = []
    for k in range(400):
        base = r.standard_normal(16)
        rows.append((len(rows), base.tolist(), int(k % 3)))
        for _ in range(int(r.integers(0, 3))):
            rows.append((len(rows), (base + 0.06 * r.standard_normal(16)).tolist(), int(k % 3)))
    hot = r.standard_normal(16)
    rows += [(len(rows) + k, (hot + 0.01 * r.standard_normal(16)).tolist(), 1) for k in range(700)]
    rows += [(5000 + k, hot.tolist(), 1) for k in range(30)]
    rows += [(9000, None, 1), (9001, [0.0] * 16, 1), (9002, [float("nan")] * 16, 1), (9003, [None] * 16, 1), (9004, hot.tolist(), None), (9005, [], 1), (9006, hot.tolist()[:8], 1), (9007, [float("inf")] + [0.0] * 15, 1)]
    df = spark.createDataFrame([(*x, "clash") for x in rows], "vec_id long, embedding array<float>, label int, t string").repartition(5)
    got = {x.vec_id: x for x in embeddings.near_duplicates(df).collect()}
    ok = [(i, np.array(v, np.float32).astype(float), y) for i, v, y in rows if v and y is not None and None not in v and np.isfinite(v).all() and np.any(v) and len(v) == 16]
    x = np.array([v for _, v, _ in ok])
    lab = np.array([y for *_, y in ok])
    norm = np.sqrt((x * x).sum(1))
    link = ((x @ x.T) / norm[:, None] / norm[None] >= 0.98) & (lab[:, None] == lab[None])
    np.fill_diagonal(link, False)
    ids = np.array([i for i, *_ in ok])
    low = ids.copy()
    while True:
        new = np.minimum(low, np.where(link, low[None, :], 1 << 60).min(1))
        if (new == low).all():
            break
        low = new
    for k, i in enumerate(ids):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (link[k].sum(), low[k], low[k] == i)
    for i in range(9000, 9008):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert len(got) == len(rows) and embeddings.near_duplicates(df.limit(0)).count() == 0


def test_embeddings_with_null_ids_and_extreme_norms(spark):
    a, b = [1.0, 0.01, 0.0], [0.0, 0.01, 1.0]
    big, tiny = [1e200, 1e198, 0.0], [1e-200, 1e-202, 0.0]
    rows = [(5, a), (None, [1.0, 0.02, 0.0]), (7, b), (None, [0.0, 0.02, 1.0]), (8, big), (9, tiny), (None, [0.0, 1.0, 0.0]), (10, [1.0, 0.01]), (None, None)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, label int")
    got = sorted(map(repr, map(tuple, embeddings.near_duplicates(df).collect())))
    want = [(5, 3, 5, True), (None, 3, 5, False), (7, 1, 7, True), (None, 1, 7, False), (8, 3, 5, False), (9, 3, 5, False), (None, 0, None, False), (10, 0, 10, True), (None, 0, None, False)]
    assert got == sorted(map(repr, want))


def test_embedding_plan_keeps_recall():
    for n in (0, 1, 10**5, 10**9):
        bits, tables = embeddings.plan(n, 0.98)
        assert (1 - (1 - np.arccos(0.98) / np.pi) ** bits) ** tables <= 1e-5 and n / 2**bits <= embeddings.BUCKET
    assert embeddings.plan(50_000, 0.98)[0] == 16


def test_embeddings_in_growing_blocks_and_labels_of_any_type(spark):
    """3,000 distinct vectors of one bucket, more than the blocks of least size hold; labels keep their type."""
    rng = np.random.default_rng(3)
    base = rng.standard_normal(16)
    near = base + rng.standard_normal((3000, 16)) * 0.09
    rows = [(k, near[k].tolist(), 1.2 if k % 3 else 1.7) for k in range(3000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label double")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(df, bits=1, tables=24).collect()}
    unit = near / np.linalg.norm(near, axis=1)[:, None]
    label = np.arange(3000) % 3 > 0
    link = (unit @ unit.T >= 0.98) & (label[:, None] == label[None, :]) & ~np.eye(3000, dtype=bool)
    assert {k: n for k, (n, _) in got.items()} == dict(enumerate(link.sum(1).tolist()))
    low = np.arange(3000)
    for _ in range(100):
        low = np.minimum(low, np.where(link, low[None, :], 3000).min(1))
    assert {k: c for k, (_, c) in got.items()} == dict(enumerate(low.tolist()))


def test_salted_join_deals_hot_keys(spark):
    keys = [7] * 6000 + list(range(100, 3100)) + [None] * 50
    rows = spark.createDataFrame([(k, n) for n, k in enumerate(keys)], "key long, n long")
    values = spark.createDataFrame([(7, "a"), (7, "b"), (100, "c"), (None, "d"), (5, "e")], "key long, v string")
    joined = salted_join(rows, values, "key")
    assert sorted((r.key, r.n, r.v) for r in joined.collect()) == sorted([(7, n, v) for n in range(6000) for v in "ab"] + [(100, 6000, "c")])
    assert salted_join(rows.limit(0), values, "key").count() == salted_join(rows, values.limit(0), "key").count() == 0


def test_licenses(spark):
    mit, gpl = licenses.TEMPLATES["MIT"], licenses.TEMPLATES["GPL-3.0-line"]
    pad = " ".join(f"w{k}" for k in range(500))
    almost = mit.replace("sublicense", "resell")
    rows = [(1, f"{pad} {mit.upper()} {pad}"), (2, gpl), (3, almost), (4, None), (5, ""), (6, "two words"), (7, pad), (8, gpl + " " + gpl), (9, " ".join(mit.split()[:20])), (2, gpl)]
    df = spark.createDataFrame([(*x, "c") for x in rows], "doc_id long, text string, license string")
    got = sorted((r.doc_id, r.license, r.containment == 1.0) for r in licenses.find_licenses(df).collect())
    assert got == [(1, "MIT", True), (2, "GPL-3.0-line", True), (2, "GPL-3.0-line", True), (3, "MIT", False), (8, "GPL-3.0-line", True)]
    assert licenses.find_licenses(df.limit(0)).count() == 0
    assert licenses.find_licenses(df, {}).count() == 0


def test_license_recall_is_that_of_exact_containment(spark):
    rng = np.random.default_rng(11)
    split = lambda t: [w for w in re.split("[^a-z0-9]+", t.lower()) if w]
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    texts = []
    for body in licenses.TEMPLATES.values():
        for changed in (0, 1, 2, 4, 8):
            words = split(body)
            for k in rng.integers(0, len(words), changed):
                words[k] = f"x{k}"
            noise = [f"n{k}" for k in rng.integers(0, 500, 60)]
            at = rng.integers(0, 60)
            texts.append(" ".join(noise[:at] + words + noise[at:]))
    want = set()
    for n, t in enumerate(texts):
        g = grams(split(t))
        for name, body in licenses.TEMPLATES.items():
            own = grams(split(body))
            if own and len(own & g) >= licenses.CONTAINMENT * len(own):
                want.add((n, name, len(own & g)))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.license, r.n_shared) for r in licenses.find_licenses(df).collect()}
    assert got == want and {"MIT-text", "BSD-3-Clause-text", "ISC-text", "Zlib-text"} <= {x[1] for x in want}


#: The contract's patterns and least lengths (of group 2, or of the match), stated here on their own.
KINDS = [("assign", r"""(?ia:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6), ("access", r"AKIA[A-Z0-9]+", 20), ("hex", r"[0-9a-f]+", 24)]


def plain_base(t):
    out = []
    for k, (name, p, least) in enumerate(KINDS):
        for m in re.finditer(p, t or ""):
            if len(m[2] if name == "assign" else m[0]) >= least:
                out.append((m.start(), k, m.end(), name))
    return sorted(out)


def test_secrets(spark):
    key, blob = "AKIA" + "Q" * 16, "abcDEF+/" * 5
    texts = [None, "", "plain", f"😀 {key} then {blob}", f"{blob} alone", 'Token = "abc" password: hunter2x', "token=token: abcdefgh", f"user: alice\nsecret = {'0f' * 16} https://db.example.org/x and far " + "z " * 300 + "https://other.example.org", "deadbeef" * 4 + " API_KEY='xxxxxx'" * 3, f"login: bob {'p ' * 400}{blob}"]
    df = spark.createDataFrame([(k, t, "c") for k, t in enumerate(texts)] + [(3, texts[3], "c"), (None, texts[3], "c")], "doc_id long, text string, base string")
    for r in secrets.find_secrets(df).collect():
        t = texts[3 if r.doc_id is None else r.doc_id]
        base = plain_base(t)
        told = ",".join(f"{n}:{s}:{e}" for s, _, e, n in base)
        assert r.base_sha256 == hashlib.sha256(told.encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(x[1] == k for x in base) for k in range(3)]
        assert set(told.split(",")) - {""} <= set(r.spans.split(","))
    spans = {r.doc_id: r.spans for r in secrets.find_secrets(df).collect()}
    assert "blob" in spans[3] and spans[4] == "" and spans[9] == ""
    assert "account" in spans[7] and spans[7].count("endpoint") == 1
    assert secrets.find_secrets(df.limit(0)).count() == 0
    clean = {r.doc_id: r for r in secrets.redact(df).collect()}
    assert clean[5].text == 'Token = "abc" [SECRET]' and clean[2].text == "plain" and clean[0].text is None
    assert clean[3].text == "😀 [SECRET] then [SECRET]" and clean[4].text == texts[4] and clean[3].base == "c"


def test_secrets_of_a_text_with_very_many(spark):
    """Thousands of secrets in one text, and one that is as long as the text."""
    many = " ".join(f"token={k:06d} user=u{k:05d}" for k in range(3000))
    df = spark.createDataFrame([(1, many, "c"), (2, "a" * 500_000, "c"), (3, None, "c")], "doc_id long, text string, spans string")
    got = {r.doc_id: r for r in secrets.find_secrets(df).collect()}
    assert got[1].n_assign == 3000 and len(got[1].all_spans) == 6000 and got[2].n_hex == 1 and got[3].n_hex == 0
    starts = [m.start() for m in re.finditer("token=", many)]
    assert [s.start for s in got[1].all_spans if s.kind == 0] == starts


def test_rollup_is_idempotent(spark):
    docs = spark.createDataFrame([(1, "a b, c", "s", "en"), (2, None, "s", "en"), (3, "x", None, None)], "doc_id long, text string, source string, lang string")
    counts = token_counts.count_tokens(docs, ["source", "lang"])
    assert sorted(tuple(r) for r in counts.select("words-1", "words-2").collect()) == [(0, 0), (1, 1), (3, 4)]
    roll = token_counts.Rollup(spark, work_dir(spark, "rollup"))
    assert roll.totals().count() == 0
    first = token_counts.inserts(counts, "words-1", "words-1")
    assert roll.commit("a", first) and not roll.commit("a", first)
    assert {tuple(r) for r in roll.totals().collect()} == {("s", "en", "words-1", 2, 3), (None, None, "words-1", 1, 1)}
    assert roll.commit("b", token_counts.deletes(counts.filter("lang is null"), "words-1", "words-1"))
    assert roll.commit("c", token_counts.revisions(counts.filter("lang is not null"), "words-1", "words-1", "words-2"))
    assert roll.commit("d", first.limit(0))
    again = token_counts.Rollup(spark, roll.path)
    assert {tuple(r) for r in again.totals().collect()} == {("s", "en", "words-1", 2, 4)}


def test_rollup_counts_the_first_of_two_writers(spark):
    """Writers of one batch with different deltas, in every order in which their steps can meet."""
    one, two = [token_counts.inserts(spark.createDataFrame([("s", "en", n)], "source string, lang string, n long"), "words-1", "n") for n in (5, 50)]
    roll = token_counts.Rollup(spark, work_dir(spark, "rollup"))
    tokens = lambda: [r.tokens for r in roll.totals().collect()]
    late = roll.stage(two)
    assert roll.commit("day 1/a", one) and tokens() == [5]
    assert not roll.claim("day 1/a", late) and not roll.commit("day 1/a", two) and tokens() == [5]
    # a writer that is lost after its claim: the next one's attempt moves what was claimed
    lost = roll.stage(two)
    assert roll.claim("b", lost) and not roll.committed("b")
    assert not roll.commit("b", one) and tokens() == [55]
    with ThreadPoolExecutor(4) as pool:
        won = list(pool.map(lambda n: roll.commit("c", token_counts.inserts(spark.range(1).selectExpr("'s' as source", "'en' as lang", f"{n} as n"), "words-1", "n")), (100, 200, 300, 400)))
    assert won.count(True) == 1 and tokens() == [55 + (100, 200, 300, 400)[won.index(True)]]


def test_token_counts_of_long_texts(spark):
    docs = spark.createDataFrame([(1, "word " * 400_000), (2, "x" * 2_000_000), (3, "ñ." * 300_000)], "doc_id long, text string")
    got = {r.doc_id: (r["words-1"], r["words-2"]) for r in token_counts.count_tokens(docs, ["doc_id"]).collect()}
    assert got == {1: (400_000, 400_000), 2: (1, 1), 3: (1, 600_000)}


def test_counts_by_vocabulary_files(spark):
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    paths = {"word": public_tokenizers.path("word_bpe_49k.json"), "byte": public_tokenizers.path("byte_bpe_multi_50k.tiktoken")}
    texts = [None, "", "It's naïve, 12 times!", "x" * 500, "a b\n\nc"]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    tok = Tokenizer.from_file(paths["word"])
    ranks = token_counts.Merger(paths["byte"]).ranks
    byte = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = [(k, len(tok.encode(t or "", add_special_tokens=False).ids), len(byte.encode_ordinary(t or ""))) for k, t in enumerate(texts)]
    assert sorted(map(tuple, token_counts.count_model_tokens(docs, ["doc_id"], paths).collect())) == want


def test_token_counts_cover_all_documents_by_each_tokenizer(spark, tmp_path):
    rows = [(1, "a b, c", "s", "en"), (2, "a b, c", "s", "en"), (3, "a b, c", "t", "en"), (3, "a b, c", "t", "en"), (4, None, "s", "en"), (5, "", "s", "en"), (6, "ü-x! y", None, None), (None, "a b, c", "s", "de")]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {}
    for name, pattern in (("words-1", r"[^\x09-\x0D\x20]+"), ("words-2", r"[A-Za-z0-9\x80-\U0010FFFF]+|[^A-Za-z0-9\x80-\U0010FFFF\x09-\x0D\x20]")):
        for _, text, source, lang in rows:
            n, tokens = want.get((source, lang, name), (0, 0))
            want[source, lang, name] = n + 1, tokens + len(re.findall(pattern, text or ""))
    got = token_counts.op10_token_counts(spark, str(tmp_path)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr((*k, *v)) for k, v in want.items())
    assert want["s", "en", "words-1"] == (4, 6) and want["s", "en", "words-2"] == (4, 8)


def test_pipeline_on_small_tables(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    r = np.random.default_rng(8)
    word = [f"w{k}" for k in range(500)]
    prose = lambda n: ". ".join(" ".join(r.choice(word, 9)) for _ in range(n))
    bench = [(k, " ".join(r.choice(word, 40))) for k in range(3)]
    rows, labels = [], []
    for k in range(200):
        bad = k % 9 == 0
        rows.append((k, prose(12) + (" slurx" if bad else ""), "en", "s", 1))
        labels.append((k, 1, int(bad)))
    rows += [(300, rows[1][1], "en", "s", 1), (301, prose(5) + " " + bench[0][1] + " " + prose(5), "en", "s", 1), (302, prose(5) + " token = abcdef123456", "en", "s", 1), (303, None, None, None, None), (304, "", "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {x.doc_id: x for x in pipeline.run(spark, str(tmp_path)).collect()}
    assert sorted(got) == [k for k in range(200) if k % 9] + [302, 303]
    masked = re.sub(r"token = \w+", "[SECRET]", rows[202][1])
    assert got[302].decoded_sha256 == hashlib.sha256(masked.encode()).hexdigest()
    assert all(len(x.ids) == len(x.offsets) == 4 * x.n_tokens and x.ids_sha256 == hashlib.sha256(x.ids).hexdigest() for x in got.values())
    for name, stage in pipeline.STAGES[:-1]:
        docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns, name
