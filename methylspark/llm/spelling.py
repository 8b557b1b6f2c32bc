"""Spelling variants: words one edit apart by an index of variable-length grams (operator 11)."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from operator import methodcaller

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_sql, materialize, named, table, text_bytes

#: Lengths of grams. A gram longer than the least is in the dictionary if it has more than one of SHARE of all places of its length.
LEAST, MOST, SHARE = 2, 4, 8192
#: Words have so many letters and occurrences at least; a form has so many times the word's.
LETTERS, OCCURRENCES, TIMES = 7, 2, 10
#: What a run of letters is, and which runs lose a letter.
RUN, LOSS = r"[A-Za-zÀ-ÿ]+", 31
#: Different runs held by a task before their counts are passed on.
HELD = 500_000

_RUN = re.compile(RUN)
_LOWER = {c: c + 32 for c in range(65, 91)}
_MASK, _STEP = (1 << 64) - 1, 0x9E3779B97F4A7C15


def damaged(doc_id, run: str) -> str:
    """``run`` without one letter where the crc32 of "doc_id:run" is a multiple of LOSS."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    k = h % len(run)
    return run[:k] + run[k + 1 :] if h % LOSS == 0 else run


def occurrences(docs: DataFrame, id_col: str = "doc_id", text: str = "text", letters: int = LETTERS) -> DataFrame:
    """word, n: the damaged, lower-cased (A to Z) runs of ``letters`` or more code points and how often they occur.

    Null texts have none, a null id counts as empty text, repeated rows count each time.
    """

    def run(batches):
        held = Counter()
        rows = lambda: pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
        for b in batches:
            for i, raw in zip(named(b, id_col).to_pylist(), named(b, "_b").to_pylist()):
                if not raw:
                    continue
                own = Counter(map(methodcaller("group"), _RUN.finditer(raw.decode().translate(_LOWER))))
                for w, n in own.items():
                    # a shorter run stays too short, whether it loses a letter or not
                    if len(w) >= letters and len(w := damaged(i, w)) >= letters:
                        held[w] += n
                if len(held) > HELD:
                    yield rows()
                    held.clear()
        if held:
            yield rows()

    return text_bytes(docs, id_col, text=text).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def gram_dictionary(words: DataFrame, share: int = SHARE) -> set[str]:
    """Grams of LEAST + 1 to MOST letters that are frequent among the places of their length in distinct words.

    Fewer than ``share`` grams of one length can be so, whatever the words, so the dictionary fits a task.
    """
    out = set()
    for size in range(LEAST + 1, MOST + 1):
        at = F.sequence(F.lit(1), F.length("word") - size + 1)
        grams = words.filter(F.length("word") >= size).select(F.explode(F.transform(at, lambda p: F.substring(F.col("word"), p, F.lit(size)))).alias("gram"))
        counts = materialize(grams.groupBy("gram").agg(F.count("*").alias("n")), "grams")
        total = counts.agg(F.sum("n")).first()[0] or 0
        out |= {r[0] for r in counts.filter(F.col("n") * share > total).select("gram").collect()}
    return out


class Grams:
    """Decomposes words by a dictionary and knows which grams an edit leaves alone."""

    def __init__(self, dictionary: set[str]):
        self.dictionary = dictionary
        #: Beginnings that a longer gram of the dictionary goes on from.
        self.begun = {g[:k] for g in dictionary for k in range(LEAST, len(g))}
        self.codes: dict[str, int] = {}

    def __getstate__(self):
        return {"dictionary": self.dictionary, "begun": self.begun, "codes": {}}

    def decompose(self, word: str) -> list[str]:
        """The longest gram of the dictionary at each place, or the LEAST letters there."""
        out = []
        for p in range(len(word) - LEAST + 1):
            for size in range(MOST, LEAST, -1):
                if (g := word[p : p + size]) in self.dictionary:
                    break
            else:
                g = word[p : p + LEAST]
            out.append(g)
        return out

    def intact(self, word: str, grams: list[str], site: int) -> int:
        """How many of the first grams no edit at ``site`` can change; those after them up to ``site`` it may.

        A gram depends on MOST letters at most. One that ends before ``site`` sooner than that is also safe, unless
        the letters from its start to ``site`` begin a longer gram of the dictionary.
        """
        k = max(site - MOST + 1, 0)
        while k <= site - LEAST and len(grams[k]) <= site - k and word[k:site] not in self.begun:
            k += 1
        return k

    def keys(self, word: str) -> list[tuple[int, int, bool]]:
        """(key, site, removed) of every place where the word may differ from a near one.

        With ``removed`` the letter at ``site`` is the one that is replaced or too much, without it a letter is missing
        before ``site``. A key stands for all grams that such an edit leaves alone, to the left by their place from
        the start, to the right by their place from the end: the bound on affected grams says that a near word has
        each of them, so it is on all their lists, and lists are merged by one look-up of all together.
        """
        grams, n = self.decompose(word), len(word)
        if len(self.codes) > HELD:
            self.codes.clear()
        codes = []
        for g in grams:
            c = self.codes.get(g)
            if c is None:
                c = self.codes[g] = xxhash.xxh64_intdigest(g)
            codes.append(c)
        left = [1]
        for c in codes:
            left.append((left[-1] * _STEP + c) & _MASK)
        right = [2]
        for c in reversed(codes):
            right.append((right[-1] * _STEP ^ c) & _MASK)
        right.reverse()  # right[p] covers the grams from place p on
        last = len(codes)
        out = []
        for site in range(n + 1):
            a = left[self.intact(word, grams, site)]
            for after, removed in ((site + 1, True), (site, False)):
                if site + removed <= n:
                    key = ((a ^ (a >> 29)) * _STEP + right[min(after, last)] * 31 + site) & _MASK
                    out.append((key - (1 << 64) if key >> 63 else key, site, removed))
        return out


def near_words(words: DataFrame, dictionary: set[str] | None = None) -> DataFrame:
    """word, n, near, near_n: both directions of each pair of ``words`` (distinct word, n) exactly one edit apart.

    Each word gives a row for each place where it may differ; rows meet by key, so no list of one frequent gram is gone
    through. What meets is compared letter by letter at the place in question, which also tells the one place of a
    pair from others, so pairs come once.
    """
    spark = words.sparkSession
    held = spark.sparkContext.broadcast(Grams(gram_dictionary(words) if dictionary is None else dictionary))

    def run(batches):
        g = held.value
        for b in batches:
            texts, counts = named(b, "word").to_pylist(), named(b, "n").to_pylist()
            rows = [(k, w, n, site, removed) for w, n in zip(texts, counts) for k, site, removed in g.keys(w)]
            for at in range(0, len(rows), 20_000):
                part = list(zip(*rows[at : at + 20_000]))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(part, (pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.bool_()))], ["key", "word", "n", "site", "removed"])

    keys = words.select("word", "n").mapInArrow(run, "key long, word string, n long, site int, removed boolean")
    size = {x: F.length(f"{x}.word") for x in "ab"}
    at = F.col("a.site")
    part = lambda x, start, n: F.substring(F.col(f"{x}.word"), start, n)
    letter = lambda x, k: part(x, k + 1, F.lit(1))

    def one_too_much(x, y):
        """``x`` is ``y`` and one letter at the place: of equal letters in a row the first."""
        first = (at == 0) | (letter(x, at) != letter(x, at - 1))
        return F.col(f"{x}.removed") & ~F.col(f"{y}.removed") & (size[x] == size[y] + 1) & (part(x, at + 2, size[x]) == part(y, at + 1, size[y])) & first

    replaced = F.col("a.removed") & F.col("b.removed") & (size["a"] == size["b"]) & (letter("a", at) != letter("b", at)) & (part("a", at + 2, size["a"]) == part("b", at + 2, size["b"]))
    head = part("a", F.lit(1), at) == part("b", F.lit(1), at)
    # one condition that Spark does not take apart: both sides are then the same rows by the same key, and one shuffle serves
    # them. Keys are many times the words' size, which Spark does not know, so they are not offered for broadcast.
    near = F.coalesce((replaced | one_too_much("a", "b") | one_too_much("b", "a")) & head, F.lit(False))
    met = keys.alias("a").hint("merge").join(keys.alias("b"), (F.col("a.key") == F.col("b.key")) & (F.col("a.site") == F.col("b.site")) & near)
    return met.select("a.word", "a.n", F.col("b.word").alias("near"), F.col("b.n").alias("near_n"))


def variants(words: DataFrame, times: int = TIMES) -> DataFrame:
    """word, n, form, form_n, n_near, root of each of ``words`` (distinct word, n; a written table).

    The form is the near word of largest n, of equals the first in code-point order, if it has ``times`` the word's n;
    root is where following forms ends. A form has ``times`` the occurrences, so chains are short and without cycles;
    they are followed in doubling steps over written tables, and only words that have a form take part.
    """
    best = F.min(F.when(F.col("near").isNotNull(), F.struct((-F.col("near_n")).alias("neg"), F.col("near").alias("near"))))
    every = near_words(words).unionByName(words.select("word", "n", F.lit(None).cast("string").alias("near"), F.lit(None).cast("long").alias("near_n")))
    g = every.groupBy("word", "n").agg(best.alias("best"), F.count("near").alias("n_near"))
    usual = -F.col("best.neg") >= times * F.col("n")
    g = materialize(g.select("word", "n", "n_near", F.when(usual, F.col("best.near")).alias("form"), F.when(usual, -F.col("best.neg")).alias("form_n")), "variants")
    top = g.agg(F.max("n")).first()[0] or 1
    jumps = materialize(g.filter("form is not null").select("word", F.col("form").alias("to")), "roots")
    links = math.floor(math.log(max(top, 1), times)) + 1
    for _ in range(max(links - 1, 0).bit_length()):
        on = jumps.select(F.col("word").alias("_at"), F.col("to").alias("_to"))
        jumps = materialize(jumps.join(on, F.col("to") == F.col("_at"), "left").select("word", F.coalesce("_to", "to").alias("to")), "roots")
    return g.join(jumps, "word", "left").select("word", "n", "form", "form_n", "n_near", F.coalesce("to", "word").alias("root"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of ``documents`` with 7 letters and 2 occurrences at least.

    Texts as in ``occurrences``; an empty table gives no rows.
    """
    counted = occurrences(table(spark, sf_dir, "documents")).filter(F.col("n") >= OCCURRENCES)
    return variants(materialize(counted, "words")).select("word", "form", "root", "n", "n_near", "form_n")


#: Near words by all words with one letter taken out, at the place where it was.
OP11_SQL = f"""with recursive
r as (select doc_id, run, count(*) as n from (select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) as run from documents) where length(run) >= {LETTERS} group by all),
h as (select *, {crc_sql("coalesce(doc_id::varchar, '') || ':' || run")} as h from r),
w as (select word, sum(n)::bigint as n from (select case when h % {LOSS} = 0 then substr(run, 1, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word, n from h)
  where length(word) >= {LETTERS} group by word having sum(n) >= {OCCURRENCES}),
o as (select word, n, i, substr(word, 1, i::int - 1) || substr(word, i::int + 1) as rest from w, unnest(range(1, length(word) + 1)) t(i)),
p as (select a.word, b.word as near, b.n as near_n from o a join o b on a.i = b.i and a.rest = b.rest and a.word <> b.word
  union select o.word, w.word, w.n from o join w on o.rest = w.word union select w.word, o.word, o.n from o join w on o.rest = w.word),
b as (select word, count(*) as n_near, max(near_n) as top from p group by word),
f as (select p.word, min(near) as form, min(top) as form_n from p join b on b.word = p.word and p.near_n = b.top join w on w.word = p.word where top >= {TIMES} * w.n group by p.word),
c as (select word, form, 1 as k from f union all select c.word, f.form, k + 1 from c join f on f.word = c.form)
select w.word, f.form, coalesce(c.form, w.word) as root, w.n, coalesce(b.n_near, 0)::bigint as n_near, f.form_n::bigint as form_n
from w left join b on b.word = w.word left join f on f.word = w.word left join (select word, arg_max(form, k) as form from c group by word) c on c.word = w.word
"""
