"""Toxicity by multiple-instance learning: sentences scored, combined by noisy-or (operator 7)."""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_bucket, named, table, text_bytes

#: Most labelled rows of each class that the model is fitted on, and the longest text (characters) used
#: for fitting. Scoring has no such bounds.
SAMPLE_ROWS, SAMPLE_CHARS = 2500, 20_000
#: Log odds that a sentence's evidence starts from. Sentences without evidence add nothing to a document's score.
PRIOR = -12.0
PREFIXES = (3, 4, 5, 6)
LEAST_DOCS = 4

_SENTENCE = re.compile(r"[.!?\n|]+")
_WORD = re.compile(r"\w+")


def sentences(text: str) -> list[tuple[int, int]]:
    """Code point spans of sentences with some word character."""
    out, start = [], 0
    for m in _SENTENCE.finditer(text):
        if text[start : m.end()].strip():
            out.append((start, m.end()))
        start = m.end()
    if text[start:].strip():
        out.append((start, len(text)))
    return out


def features(word: str) -> list[str]:
    """A lower-cased word and its beginnings."""
    return [word + "$", *(word[:n] for n in PREFIXES if len(word) >= n)]


class Model:
    """Weights of features; a sentence's log odds are PRIOR plus the evidence of its distinct words.

    Log odds up to ``floor``, which is fitted with the weights, are those that clean sentences have too: such a
    sentence's probability is 0, in a text of any length.
    """

    def __init__(self, weights: dict[str, float], floor: float = PRIOR, limit: int = 500_000):
        self.weights, self.floor, self.limit, self.cache = weights, floor, limit, {}

    def __getstate__(self):
        return {"weights": self.weights, "floor": self.floor, "limit": self.limit, "cache": {}}

    def word(self, w: str) -> float:
        got = self.cache.get(w)
        if got is None:
            if len(self.cache) > self.limit:
                self.cache.clear()
            get = self.weights.get
            got = self.cache[w] = sum(get(f, 0.0) for f in features(w))
        return got

    def sentence(self, text: str) -> float:
        """Probability that a sentence is toxic."""
        z = PRIOR + sum(self.word(w) for w in set(_WORD.findall(text.lower())))
        return 1.0 / (1.0 + math.exp(-min(z, 40.0))) if z > self.floor else 0.0

    def document(self, text: str) -> float:
        """Noisy-or over all sentences: the probability that not all of them are clean."""
        cache, word, floor = self.cache, self.word, self.floor
        clean = 0.0
        for s in _SENTENCE.split(text.lower()):
            ws = _WORD.findall(s)
            if not ws:
                continue
            z = PRIOR
            for w in set(ws):
                v = cache.get(w)
                z += word(w) if v is None else v
            if z > floor:
                clean -= math.log1p(math.exp(min(z, 40.0)))
        return -math.expm1(clean)

    def worst(self, text: str) -> tuple[int, int, float]:
        """Start, end and score of the sentence that scores most (the first of equals)."""
        scored = ((self.sentence(text[a:b]), -a, b) for a, b in sentences(text))
        p, start, end = max(scored, default=(0.0, 0, 0))
        return -start, end, float(p)


def _bag(text: str):
    """Features of each sentence."""
    for s in _SENTENCE.split(text.lower()):
        words = set(_WORD.findall(s))
        if words:
            yield {f for w in words for f in features(w)}


def fit(rows: list[tuple[str, int]], rounds: int = 300, rate: float = 0.5, sparse: float = 2e-3) -> Model:
    """Weights from (text, 0 or 1) rows: gradient steps on the noisy-or likelihood, weights kept positive.

    The penalty on the sum of weights leaves features that the labels do not need at zero. Rows of one
    class only, or none, give a model without evidence.
    """
    y = np.array([r[1] for r in rows], np.float64)
    if not len(y) or not 0 < y.sum() < len(y):
        return Model({})
    # texts are gone through again for each step: only counts and indices of known features are held
    toxic = Counter(f for text, label in rows if label for f in set().union(*_bag(text)))
    toxic = {f: n for f, n in toxic.items() if n >= LEAST_DOCS}
    seen = Counter(toxic)
    for text, label in rows:
        if not label:
            seen.update(toxic.keys() & set().union(*_bag(text)))
    # features that are hardly likelier in toxic rows cannot keep a positive weight; rates are by class, so
    # the balance of the sample does not matter
    odds = y.sum() / (len(y) - y.sum())
    vocab = [f for f in toxic if toxic[f] > 2 * odds * (seen[f] - toxic[f])]
    if not vocab:
        return Model({})
    index = {f: k for k, f in enumerate(vocab)}
    sent, feat, owner = array("i"), array("i"), array("i")
    for d, (text, _) in enumerate(rows):
        for b in _bag(text):
            known = [index[f] for f in b if f in index]
            if known:
                sent.extend([len(owner)] * len(known))
                feat.extend(known)
                owner.append(d)
    sent, feat, owner = (np.frombuffer(x, np.int32) for x in (sent, feat, owner))
    rank = np.log((np.array([toxic[f] for f in vocab]) + 0.5) / (np.array([seen[f] - toxic[f] for f in vocab]) + 0.5))
    w = np.clip(rank, 0, None) * 0.6
    g2 = np.full(len(vocab), 1e-8)
    balance = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    n, m = len(rows), len(owner)
    clean_row = (y == 0)[owner]
    floor = PRIOR

    def odds_of(w):
        return PRIOR + np.bincount(sent, w[feat], m)

    for step in range(rounds):
        z = odds_of(w)
        if step == rounds // 2:
            floor = highest_clean(z[clean_row])
        p = np.where(z > floor, 1 / (1 + np.exp(-np.clip(z, -40, 40))), 0.0)
        clean = np.bincount(owner, np.log1p(-np.minimum(p, 1 - 1e-12)), n)
        doc = np.clip(1 - np.exp(clean), 1e-9, 1 - 1e-9)
        # d log-likelihood / d z of a sentence: p * (y - P) / P
        up = p * ((y - doc) / doc * balance)[owner]
        grad = np.bincount(feat, up[sent], len(vocab)) - sparse * balance.min()
        g2 += grad * grad
        w = np.maximum(0.0, w + rate * grad / np.sqrt(g2))
    w = np.where(w > 1e-3, np.round(w, 6), 0.0)
    return Model({f: float(v) for f, v in zip(vocab, w) if v}, highest_clean(odds_of(w)[clean_row]))


def highest_clean(z: np.ndarray) -> float:
    """The highest log odds below even that a sentence of a clean text has.

    Texts may hold any number of sentences like those of clean ones, so such odds must not add up; odds above even
    count in any text.
    """
    return float(max(z[z < 0.0], default=PRIOR))


def train(docs: DataFrame, labels: DataFrame, held_out_mod: int = 5, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Fit on up to ``sample_rows`` labelled rows of each class, the first by a hash of the id.

    Only rows whose crc32(id as text) mod ``held_out_mod`` is not 0 are looked at. Null labels, ids and
    texts and texts of over SAMPLE_CHARS characters are not used for fitting.
    """
    known = labels.filter(F.col(label).isin(0, 1)).select(F.col(id_col).cast("long").alias("_i"), F.col(label).cast("int").alias("_y")).distinct()
    known = known.filter(crc_bucket(F.col("_i")) % held_out_mod != 0).withColumn("_h", F.xxhash64("_i"))
    chosen = [known.filter(f"_y = {y}").orderBy("_h", "_i").limit(sample_rows) for y in (0, 1)]
    chosen = chosen[0].unionByName(chosen[1])
    got = docs.select(F.col(id_col).cast("long").alias("_i"), F.col(text).cast("string").alias("_t")).join(F.broadcast(chosen), "_i")
    rows = got.filter(F.length("_t") <= SAMPLE_CHARS).select("_i", "_t", "_y").dropDuplicates(["_i", "_y"]).limit(2 * sample_rows)
    return fit([(r[1], r[2]) for r in sorted(rows.collect(), key=lambda r: (r[0], r[2]))])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, held_out, score, predicted and the place and score of the worst sentence (predicted 1 only) for each row.

    Null and empty texts score 0; a null id is not held out; repeated rows stay. Places are code points.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = held.value
        for b in batches:
            texts = [t.decode() if t else "" for t in named(b, "_b").to_pylist()]
            p = [m.document(t) if t else 0.0 for t in texts]
            worst = [m.worst(t) if x >= 0.5 else (None, None, None) for t, x in zip(texts, p)]
            cols = [pa.array(c, k) for c, k in zip(zip(*worst) if worst else [()] * 3, (pa.int32(), pa.int32(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([named(b, id_col), pa.array(p, pa.float64()), *cols], names=[id_col, "score", "worst_start", "worst_end", "worst_score"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = text_bytes(docs, id_col, text=text).mapInArrow(run, f"`{id_col}` {kind}, score double, worst_start int, worst_end int, worst_score double")
    held_out = F.coalesce(crc_bucket(F.col(id_col)) % 5 == 0, F.lit(False))
    return out.select(id_col, held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "worst_start", "worst_end", "worst_score")


def offending(docs: DataFrame, model: Model, least: float = 0.5, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, start, end, sentence, score) of each sentence that scores ``least`` or more (code points)."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = held.value
        for b in batches:
            rows = []
            for i, t in zip(named(b, id_col).to_pylist(), named(b, "_b").to_pylist()):
                whole = t.decode() if t else ""
                for s, e in sentences(whole):
                    p = float(m.sentence(whole[s:e]))
                    if p >= least:
                        rows.append((i, s, e, whole[s:e], p))
            cols = list(zip(*rows)) or [(), (), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], b.schema.field(id_col).type), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.string()), pa.array(cols[4], pa.float64())], names=[id_col, "start", "end", "sentence", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return text_bytes(docs, id_col, text=text).mapInArrow(run, f"`{id_col}` {kind}, start int, `end` int, sentence string, score double")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted and the worst sentence of every document, by a model of the labels not held out.

    Nulls, repeats and empty tables as in ``train`` and ``score``.
    """
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below 0.5, decided row by row where the text is read."""
    model = train(docs, table(spark, sf_dir, "labels"))
    held = spark.sparkContext.broadcast(model)
    columns = docs.columns

    def run(batches):
        m = held.value
        for b in batches:
            keep = [not t or m.document(t) < 0.5 for t in named(b, "text").to_pylist()]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.select(columns).mapInArrow(run, docs.schema)
