"""Token count rollups kept up to date by signed deltas (operator 10)."""

from __future__ import annotations

import contextlib
import uuid
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import Merger, merger
from .common import attach, delete, materialize, named, slices, table, text_bytes, work_dir
from .token_store import encoder

DELTA = "source string, lang string, tokenizer string, documents bigint, tokens bigint"

#: Tokenizer versions by name: pattern of one token. Fixed values.
TOKENIZERS = {"words-1": r"[^\x09-\x0D\x20]+", "words-2": r"[A-Za-z0-9\x{80}-\x{10FFFF}]+|[^A-Za-z0-9\x{80}-\x{10FFFF}\x09-\x0D\x20]"}


def count_tokens(docs: DataFrame, keep: list[str], tokenizers: dict[str, str] = TOKENIZERS, text: str = "text") -> DataFrame:
    """``keep`` and one bigint column for each tokenizer; null and empty texts have no tokens."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(*keep, *[F.regexp_count(t, F.lit(p)).cast("long").alias(name) for name, p in tokenizers.items()])


def count_model_tokens(docs: DataFrame, keep: list[str], tokenizers: dict[str, str], text: str = "text") -> DataFrame:
    """As ``count_tokens``, by vocabulary files: names to paths of tokenizers-library JSON or tiktoken rank files."""
    kinds = {c: docs.schema[c].dataType.simpleString() for c in keep}

    def run(batches):
        models = {name: merger(path) if path.endswith(".tiktoken") else encoder(path) for name, path in tokenizers.items()}
        for batch in batches:
            for b in slices(batch, "_b"):
                texts, out = [t or b"" for t in named(b, "_b").to_pylist()], []
                for m in models.values():
                    n = [len(x) // 4 for x in m.encode(texts)] if isinstance(m, Merger) else np.diff(m.encode(texts, 0)[1]) - 1
                    out.append(pa.array(n, pa.int64()))
                yield pa.RecordBatch.from_arrays([*(named(b, c) for c in keep), *out], names=[*keep, *models])

    shape = ", ".join([*(f"`{c}` {k}" for c, k in kinds.items()), *(f"`{name}` bigint" for name in tokenizers)])
    return text_bytes(docs, *keep, text=text).mapInArrow(run, shape)


def inserts(counts: DataFrame, tokenizer: str, tokens: str) -> DataFrame:
    """Deltas of new documents (source, lang and a count column); null counts are 0 tokens."""
    n = F.coalesce(F.col(tokens), F.lit(0)).cast("long")
    return counts.select("source", "lang", F.lit(tokenizer).alias("tokenizer"), F.lit(1).cast("long").alias("documents"), n.alias("tokens"))


def deletes(counts: DataFrame, tokenizer: str, tokens: str) -> DataFrame:
    """Deltas of documents that go."""
    d = inserts(counts, tokenizer, tokens)
    return d.withColumns({"documents": -F.col("documents"), "tokens": -F.col("tokens")})


def revisions(counts: DataFrame, tokenizer: str, before: str, after: str) -> DataFrame:
    """Deltas of counts that are put right under the same tokenizer version."""
    change = F.coalesce(F.col(after), F.lit(0)) - F.coalesce(F.col(before), F.lit(0))
    return counts.select("source", "lang", F.lit(tokenizer).alias("tokenizer"), F.lit(0).cast("long").alias("documents"), change.cast("long").alias("tokens"))


class Rollup:
    """Additive totals in a folder that all executors share.

    A batch's deltas are summed and written aside. Then the writer claims the batch: it creates the batch's owner file,
    which fails for all but the first, and writes the name of its sums there. Only the owner's sums are moved into
    place, by one rename. So replays, retries and writers that race change nothing, whatever their deltas: the claim
    decides once. Where a writer is lost between claim and rename, the next attempt at that batch moves its sums.
    Sums are bounded by the number of (source, language, tokenizer) keys, whatever the batch's size. Needs a file
    system that creates a file for one writer only and renames folders as a whole.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for name in ("batches", "owners", "staged"):
            self._fs.mkdirs(self._path(f"{self.path}/{name}"))

    def _at(self, kind: str, name: str):
        return self._path(f"{self.path}/{kind}/{name}")

    def _folder(self, batch: str):
        return self._at("batches", f"batch={quote(batch, safe='')}")

    def committed(self, batch: str) -> bool:
        return self._fs.exists(self._folder(batch))

    def stage(self, deltas: DataFrame) -> str:
        """Write a batch's sums aside; their name."""
        sums = deltas.groupBy("source", "lang", "tokenizer").agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
        own = uuid.uuid4().hex
        sums.write.parquet(self._at("staged", own).toString())
        return own

    def claim(self, batch: str, own: str) -> bool:
        """Make ``own`` the sums of a batch; False where another attempt has claimed it."""
        at = self._at("owners", quote(batch, safe=""))
        try:
            out = self._fs.create(at, False)
        except Py4JJavaError as e:
            if not self._fs.exists(at):
                raise
            if e.java_exception.getClass().getSimpleName() not in ("FileAlreadyExistsException", "AlreadyBeingCreatedException", "RemoteException"):
                raise
            return False
        out.writeBytes(own)
        out.close()
        return True

    def _owner(self, batch: str) -> str:
        with contextlib.closing(self._fs.open(self._at("owners", quote(batch, safe="")))) as f:
            return "".join(chr(c) for c in iter(f.read, -1))

    def _place(self, batch: str) -> None:
        """Move the owner's sums into place, if they are not there yet."""
        own = self._owner(batch)
        if not self._fs.rename(self._at("staged", own), self._folder(batch)) and not self.committed(batch):
            raise OSError(f"the sums of batch {batch} could not be moved into place")

    def commit(self, batch: str, deltas: DataFrame) -> bool:
        """Add a batch; False if another attempt at it came first, whose sums then are in place."""
        if self.committed(batch):
            return False
        own = self.stage(deltas)
        first = self.claim(batch, own)
        if not first:
            delete(self.spark, self._at("staged", own).toString())
        if not self.committed(batch):
            self._place(batch)
        return first

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, documents, tokens over all batches; keys that came down to nothing stay out."""
        read = self.spark.read.schema(f"{DELTA}, batch string").parquet(f"{self.path}/batches")
        sums = read.groupBy("source", "lang", "tokenizer").agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
        return sums.filter("documents <> 0 or tokens <> 0")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' tokens by both tokenizer versions, reached by deltas of each kind.

    1. ``arrivals`` inserts every document under words-1 with an outdated count (that of words-2).
    2. ``copies`` deletes documents whose text a smaller doc_id has, and is sent twice.
    3. ``returns`` inserts them again with the right words-1 count.
    4. ``repair`` revises the rest from the outdated count to that of words-1.
    5. ``recount`` inserts every document by words-2.
    """
    docs = table(spark, sf_dir, "documents").withColumn("key", F.md5(F.encode(F.coalesce("text", F.lit("")), "utf-8")))
    counts = materialize(count_tokens(docs, ["doc_id", "source", "lang", "key"]), "counts")
    first = materialize(counts.groupBy("key").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1"), "counts")
    marked = attach(counts, first, "key", "first", "n").withColumn("copy", F.coalesce(F.col("first") < F.col("doc_id"), F.lit(False)))
    marked = materialize(marked.drop("key", "first"), "counts")
    copies, rest = marked.filter("copy"), marked.filter("not copy")
    rollup = Rollup(spark, work_dir(spark, "rollup"))
    batches = {
        "arrivals": inserts(marked, "words-1", "words-2"),
        "copies": deletes(copies, "words-1", "words-2"),
        "returns": inserts(copies, "words-1", "words-1"),
        "repair": revisions(rest, "words-1", "words-2", "words-1"),
        "recount": inserts(marked, "words-2", "words-2"),
    }
    for name in ("arrivals", "copies", "copies", "returns", "repair", "recount", "arrivals"):
        rollup.commit(name, batches[name])
    return rollup.totals()


#: Each tokenizer's own count over all documents, whatever deltas lead there.
OP10_SQL = r"""
with c as (select source, lang,
  len(regexp_extract_all(coalesce(text, ''), '[^\x09-\x0D\x20]+')) as w1,
  len(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9\x{80}-\x{10FFFF}]+|[^A-Za-z0-9\x{80}-\x{10FFFF}\x09-\x0D\x20]')) as w2 from documents)
select source, lang, t.tokenizer, count(*)::bigint as documents, sum(case when t.tokenizer = 'words-1' then w1 else w2 end)::bigint as tokens
from c, (values ('words-1'), ('words-2')) t(tokenizer) group by all
"""
