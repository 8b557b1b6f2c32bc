"""Secret scans with multipart credential linking, in Spark SQL functions only (operator 8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, numbered, table

#: Kind, pattern (kinds in the order in which equal starts are listed).
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ACCOUNT = r"""(?i)\b(?:user(?:name)?|login|account|client_?id|access_?key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}"""
BLOB = r"[A-Za-z0-9+/_-]{32,}"
ENDPOINT = r"""https?://[^\x00-\x20"'<>]+|\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?::[0-9]+)?\b"""
KINDS = ["assign", "access", "hex", "account", "blob", "endpoint"]
#: Parts that stand for each role. A weak part counts only near a part of a role listed beside it.
IDENTIFIER, SECRET, PLACE = "identifier", "secret", "endpoint"
ROLE = {"assign": SECRET, "access": IDENTIFIER, "hex": SECRET, "account": IDENTIFIER, "blob": SECRET, "endpoint": PLACE}
NEEDS = {"account": [SECRET], "blob": [IDENTIFIER, PLACE], "endpoint": [SECRET]}
#: Code points between the starts of parts that belong together.
SCOPE = 200

_SPANS = "array<struct<start:int,kind:int,end:int>>"


def _found(text, kind: int, pattern: str, keep_group: int | None = None, least: int = 0):
    """Spans of a pattern's leftmost non-overlapping matches, in code points.

    What stands between matches (split) and the matches themselves (extract) give all positions. Matches
    whose group ``keep_group`` is shorter than ``least`` are dropped afterwards.
    """
    p = F.lit(pattern)
    between, whole = F.split(text, pattern, -1), F.regexp_extract_all(text, p, F.lit(0))
    sizes = F.transform(whole, lambda m: F.length(m))
    value = F.transform(F.regexp_extract_all(text, p, F.lit(keep_group)), lambda m: F.length(m)) if keep_group else sizes
    steps = F.zip_with(F.zip_with(F.slice(between, 1, F.size(whole)), sizes, lambda b, n: F.struct(F.length(b).alias("gap"), n.alias("n"))), value, lambda s, v: F.struct(s["gap"].alias("gap"), s["n"].alias("n"), v.alias("v")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("out"))

    def step(a, s):
        begin = a["at"] + s["gap"]
        span = F.struct(begin.alias("start"), F.lit(kind).alias("kind"), (begin + s["n"]).alias("end"))
        return F.struct((begin + s["n"]).alias("at"), F.when(s["v"] >= least, F.concat(a["out"], F.array(span))).otherwise(a["out"]).alias("out"))

    spans = F.aggregate(steps, start, step, lambda a: a["out"])
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(_SPANS))


def scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """uid, id, base and weak: sorted spans of base kinds, and weak candidates that touch no base span.

    One row for each row of ``docs``; null and empty texts have no spans. uid tells repeated rows apart.
    """
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    d = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias(id_col), t.alias("t"))
    base = F.array_sort(F.concat(_found(F.col("t"), 0, ASSIGN, 2, 6), _found(F.col("t"), 1, ACCESS), _found(F.col("t"), 2, HEX)))
    weak = F.concat(_found(F.col("t"), 3, ACCOUNT), _found(F.col("t"), 4, BLOB), _found(F.col("t"), 5, ENDPOINT))
    free = F.filter("w", lambda x: ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    return d.select("uid", id_col, base.alias("base"), weak.alias("w")).select("uid", id_col, "base", free.alias("weak"))


def link(scanned: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(uid, start, kind, end) of weak candidates with a complementary part at most ``scope`` away.

    An interval join in bins as wide as the scope: a part in the same bin is near enough, and of each
    neighbour bin the last or first part of a role decides. So a bin gives one row for each role, and
    documents full of parts stay linear.
    """
    every = scanned.select("uid", F.explode(F.concat("base", "weak")).alias("s")).select("uid", "s.*")
    role = F.create_map(*[F.lit(x) for k, v in ROLE.items() for x in (KINDS.index(k), v)])
    parts = every.withColumns({"role": role[F.col("kind")], "bin": F.floor(F.col("start") / scope).cast("int")})
    ends = parts.groupBy("uid", "bin", "role").agg(F.min("start").alias("first"), F.max("start").alias("last"))
    needs = F.create_map(*[x for k, v in NEEDS.items() for x in (F.lit(KINDS.index(k)), F.array(*[F.lit(r) for r in v]))])
    weak = parts.filter(F.col("kind") >= 3).drop("role").withColumn("need", F.explode(needs[F.col("kind")]))
    probe = weak.withColumn("_bin", F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1)))
    e = ends.select("uid", F.col("bin").alias("_bin"), F.col("role").alias("need"), "first", "last")
    joined = probe.join(e, ["uid", "_bin", "need"])
    near = F.when(F.col("_bin") < F.col("bin"), F.col("start") - F.col("last") <= scope).when(F.col("_bin") > F.col("bin"), F.col("first") - F.col("start") <= scope).otherwise(True)
    return joined.filter(near).select("uid", "start", "kind", "end").distinct()


def _joined(spans):
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_secrets(docs: DataFrame, scope: int = SCOPE, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_assign, n_access, n_hex, base_sha256, spans and the sorted array ``all_spans`` for each row.

    Null and empty texts have no spans; null ids and repeated rows keep a row each, told apart by number; an empty table
    gives no rows.
    """
    scanned = materialize(scan(docs, id_col, text), "secrets")
    has_weak = scanned.filter(F.size("weak") > 0)
    # a document's own candidates come together again, never more than one text holds
    linked = link(has_weak, scope).groupBy("uid").agg(F.collect_list(F.struct("start", "kind", "end")).alias("linked"))
    every = F.array_sort(F.concat("base", F.coalesce("linked", F.array().cast(_SPANS))))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias("n_" + KINDS[k])
    out = scanned.join(linked, "uid", "left").withColumn("all_spans", every)
    return out.select(id_col, count(0), count(1), count(2), F.sha2(F.encode(_joined(F.col("base")), "utf-8"), 256).alias("base_sha256"), _joined(F.col("all_spans")).alias("spans"), "all_spans")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of every document; nulls, repeats and empty tables as in ``find_secrets``."""
    return find_secrets(table(spark, sf_dir, "documents")).drop("all_spans")


def _masked(docs: DataFrame, scope: int, text: str, mask: str) -> DataFrame:
    """doc (a struct of all columns, spans of its text masked) and whether there were any."""
    held = numbered(docs, "redact")
    found = find_secrets(held.select(F.col("uid").alias("row"), F.col("doc")[text].alias("t")), scope, "row", "t")
    # written down, so that Spark knows the spans' size when it chooses how to bring them to the texts
    hit = materialize(found.filter(F.size("all_spans") > 0).select(F.col("row").alias("uid"), F.col("all_spans").alias("spans")), "redact")
    t = F.col("doc")[text]
    # sorted spans; one that begins before an earlier one's end is covered, or goes on from there
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<begin:int,start:int>>").alias("cuts"))

    def step(a, s):
        cut = F.struct(a["at"].alias("begin"), s["start"].alias("start"))
        cuts = F.when(s["start"] >= a["at"], F.concat(a["cuts"], F.array(cut))).otherwise(a["cuts"])
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), cuts.alias("cuts"))

    def finish(a):
        kept = F.transform(a["cuts"], lambda c: F.concat(F.substring(t, c["begin"] + 1, c["start"] - c["begin"]), F.lit(mask)))
        return F.concat(F.array_join(kept, ""), F.substring(t, a["at"] + 1, F.length(t)))

    clean = F.aggregate("spans", start, step, finish)
    joined = held.join(hit, "uid", "left")
    changed = F.col("spans").isNotNull()
    return joined.select(F.when(changed, F.col("doc").withField(text, clean)).otherwise(F.col("doc")).alias("doc"), changed.alias("changed"))


def redact(docs: DataFrame, scope: int = SCOPE, text: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with each text's spans replaced by ``mask``; overlapping spans count as one.

    Rows without spans are returned as they are. The text is joined to its spans by a row number that is
    written down once, so repeated rows keep apart.
    """
    return _masked(docs, scope, text, mask).select("doc.*")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked, n_chars brought up to date where a text changed."""
    n = F.when(F.col("changed"), F.length("doc.text").cast("long")).otherwise(F.col("doc.n_chars"))
    return _masked(docs, SCOPE, "text", "[SECRET]").select(F.col("doc").withField("n_chars", n).alias("doc")).select("doc.*")


def _sql_kind(kind: int, pattern: str, group: int = 0, least: int = 0) -> str:
    p = pattern.replace("'", "''")
    return f"""select doc_id, {kind} as kind, unnest(list_transform(range(1, len(m) + 1), lambda i: {{'start':
      (list_sum(list_transform(b[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0))::bigint,
      'n': length(m[i]), 'v': length(v[i])}})) as s, {least} as least
      from (select doc_id, regexp_split_to_array(t, '{p}') as b, regexp_extract_all(t, '{p}', 0) as m, regexp_extract_all(t, '{p}', {group}) as v from d)"""


_PARTS = [(0, ASSIGN, 2, 6), (1, ACCESS, 0, 0), (2, HEX, 0, 0), (3, ACCOUNT, 0, 0), (4, BLOB, 0, 0), (5, ENDPOINT, 0, 0)]
_NAMES = "['assign', 'access', 'hex', 'account', 'blob', 'endpoint']"
OP8_SQL = f"""
with d as (select doc_id, coalesce(text, '') as t from documents),
m as ({" union all ".join(_sql_kind(*p) for p in _PARTS)}),
s as (select doc_id, kind, s.start as start, s.start + s.n as stop from m where s.v >= least),
base as (select * from s where kind < 3),
weak as (select w.* from s w where kind >= 3 and not exists (select 1 from base b where b.doc_id = w.doc_id and b.start < w.stop and w.start < b.stop)),
part as (select *, case when kind in (0, 2, 4) then 'secret' when kind in (1, 3) then 'identifier' else 'endpoint' end as role from (select * from base union all select * from weak)),
linked as (select distinct w.* from weak w join part p on p.doc_id = w.doc_id and abs(p.start - w.start) <= {SCOPE}
  and ((w.kind = 3 and p.role = 'secret') or (w.kind = 4 and p.role in ('identifier', 'endpoint')) or (w.kind = 5 and p.role = 'secret'))),
every as (select * from base union all select * from linked),
g as (select doc_id, count(*) filter (kind = 0) as a, count(*) filter (kind = 1) as c, count(*) filter (kind = 2) as h,
  string_agg({_NAMES}[kind + 1] || ':' || start || ':' || stop, ',' order by start, kind) filter (kind < 3) as bs,
  string_agg({_NAMES}[kind + 1] || ':' || start || ':' || stop, ',' order by start, kind) as sp from every group by doc_id)
select d.doc_id, coalesce(a, 0)::bigint as n_assign, coalesce(c, 0)::bigint as n_access, coalesce(h, 0)::bigint as n_hex,
  sha256(coalesce(bs, '')) as base_sha256, coalesce(sp, '') as spans
from d left join g on g.doc_id = d.doc_id
"""
