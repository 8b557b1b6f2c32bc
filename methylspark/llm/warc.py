"""WARC archives: writing captures, reading records back, assembling transactions (operator 2)."""

from __future__ import annotations

import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attach, materialize, named, slices, table, work_dir

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
#: Compressed bytes after which an archive file ends (a longer record makes a longer file).
FILE_BYTES = 32_000_000


def sha1_base32(col) -> F.Column:
    """Bare upper-case base32 SHA-1 of a binary column: eight groups of five hex digits, each four base-32 digits."""
    h = F.sha1(col)
    groups = [F.lpad(F.conv(F.substring(h, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*groups), DIGITS, BASE32)


def plan_captures(pages: DataFrame, id_col: str = "page_id", payload: str = "html", url: str = "url", min_bytes: int = 0) -> DataFrame:
    """page_id, url, html, uid and what the record will say: payload_bytes, payload_digest, record_type, refers_to, refers_uid.

    Of records with equal payloads of ``min_bytes`` or more, the smallest page_id is the response and the
    others revisit it. Null payloads are empty ones. Rows that share the smallest page_id are all
    responses, and revisits name the first of them; a null page_id never serves as the original.
    """
    body = F.coalesce(F.col(payload).cast("string"), F.lit(""))
    p = pages.select(F.col(id_col).alias("page_id"), F.col(url).cast("string").alias("url"), body.alias("html"))
    p = p.withColumns({"payload_bytes": F.octet_length("html").cast("long"), "payload_digest": sha1_base32(F.col("html").cast("binary")), "uid": F.monotonically_increasing_id()})
    p = p.withColumn("_key", F.when(F.col("payload_bytes") >= min_bytes, F.concat_ws(":", "payload_digest", F.col("payload_bytes").cast("string"))))
    first = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "uid")))
    shared = p.filter("_key is not null").groupBy("_key").agg(F.count("*").alias("_n"), first.alias("_first")).filter("_n > 1 and _first is not null")
    p = attach(p, materialize(shared, "payloads"), "_key", "_first", "_n")
    again = F.col("_first").isNotNull() & ~F.col("_first.page_id").eqNullSafe(F.col("page_id"))
    out = {"record_type": F.when(again, "revisit").otherwise("response"), "refers_to": F.when(again, F.col("_first.page_id")), "refers_uid": F.when(again, F.col("_first.uid"))}
    return p.withColumns(out).drop("_key", "_first")


def _urn(kind: str, page, uid) -> str:
    h = hashlib.md5(f"{kind}:{page}/{uid}".encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"


def _record(kind: str, headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in headers if v is not None), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _member(data: bytes) -> bytes:
    """A gzip member; short records need no large window."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31) if len(data) > 8192 else zlib.compressobj(6, zlib.DEFLATED, 29, 6)
    return z.compress(data) + z.flush()


_SIGNS = {k: " " for k in (*range(32), 127)}
_HTTP = "application/http; msgtype=%s"


def _response(uri: str, page, uid, digest: str, date: str, html: bytes, refers: tuple | None = None) -> bytes:
    """A response, or (with ``refers``) a revisit of the page and row number named there."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(html)
    headers = [("WARC-Record-ID", _urn("main", page, uid)), ("WARC-Date", date), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if refers:
        headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", _urn("main", *refers))]
    headers.append(("Content-Type", _HTTP % "response"))
    return _record("revisit" if refers else "response", headers, head if refers else head + html)


def _segments(date: str, file_bytes: int):
    """Map captures to rows that each hold one archive file, but for its last byte, which is zero."""

    def close(held: list[bytes]) -> pa.RecordBatch:
        data = b"".join(held)
        if data[-1]:  # only after a record of 16 MB or more: an empty member ends with zeros
            data += _member(b"")
        return pa.RecordBatch.from_arrays([pa.array([data[:-1]], pa.binary())], names=["segment"])

    def run(batches):
        held, size = [], 0
        names = ("page_id", "uid", "url", "html", "payload_bytes", "payload_digest", "record_type", "refers_to", "refers_uid")
        for batch in batches:
            for b in slices(batch, "html"):
                for page, uid, url, html, n, digest, kind, to, to_uid in zip(*(named(b, c).to_pylist() for c in names)):
                    uri, main = (url or "").translate(_SIGNS), _urn("main", page, uid)
                    if not held:
                        info = [("WARC-Record-ID", _urn("info", page, uid)), ("WARC-Date", date), ("Content-Type", "application/warc-fields")]
                        held, size = [_member(_record("warcinfo", info, b"format: WARC File Format 1.1\r\n"))], 0
                    said = lambda kind, form: [("WARC-Record-ID", _urn(kind, page, uid)), ("WARC-Concurrent-To", main), ("WARC-Date", date), ("WARC-Target-URI", uri), ("Content-Type", form)]  # noqa: B023, E731
                    told = b"page-id: %s\r\npayload-bytes: %d\r\n" % (b"" if page is None else str(page).encode(), n)
                    refers = (to, to_uid) if kind == "revisit" else None
                    members = [
                        _member(_record("request", said("request", _HTTP % "request"), f"GET {uri} HTTP/1.1\r\n\r\n".encode())),
                        _member(_response(uri, page, uid, digest, date, html, refers)),
                        _member(_record("metadata", said("metadata", "application/warc-fields"), told)),
                    ]
                    held += members
                    size += sum(map(len, members))
                    if size >= file_bytes:
                        yield close(held)
                        held = []
        if held:
            yield close(held)

    return run


def write_archives(captures: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", file_bytes: int = FILE_BYTES) -> None:
    """Write a warcinfo record a file and request, response or revisit, and metadata records of each capture.

    Each record is a gzip member of its own. Files end after ``file_bytes``. Spark's text writer takes
    each file as one line of bytes with a zero byte, the last one of every short member, as line end; so
    the committed job output is whole even if executors are lost. Files get their usual ending afterwards.
    """
    spark = captures.sparkSession
    names = ["page_id", "uid", "url", "html", "payload_bytes", "payload_digest", "record_type", "refers_to", "refers_uid"]
    raw = captures.select(*names).withColumn("html", F.col("html").cast("binary"))
    files = raw.mapInArrow(_segments(date, file_bytes), "segment binary").select(F.col("segment").cast("string").alias("value"))
    files.write.option("lineSep", "\x00").option("maxRecordsPerFile", 1).text(path)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for at in [x.getPath() for x in fs.listStatus(hadoop.Path(path))]:  # one call a file of FILE_BYTES
        name = at.getName()
        if name.endswith(".txt") and not fs.rename(at, hadoop.Path(at.getParent(), name[:-4] + ".warc.gz")):
            raise OSError(f"{name} could not be renamed")


class _Inflate:
    """Bytes of a gzip file (any number of members) as asked for, without inflating it whole."""

    CHUNK = 65536

    def __init__(self, data: bytes):
        self.data, self.at, self.z, self.buf = memoryview(data), 0, zlib.decompressobj(31), bytearray()
        if data[:2] != b"\x1f\x8b":
            self.buf, self.data = bytearray(data), memoryview(b"")

    def fill(self, n: int) -> bool:
        while len(self.buf) < n and self.at < len(self.data):
            if self.z.eof:
                self.z = zlib.decompressobj(31)
            chunk = self.data[self.at : self.at + self.CHUNK]
            self.buf += self.z.decompress(chunk)
            # what follows a member's end is read again by the next one
            self.at += len(chunk) - len(self.z.unused_data)
        return len(self.buf) >= n

    def take(self, n: int) -> bytes:
        if not self.fill(n):
            raise ValueError("an archive ends inside a record")
        out = bytes(self.buf[:n])
        del self.buf[:n]
        return out

    def head(self) -> bytes | None:
        """Up to and without the next empty line; None at the end."""
        size, seen = 1024, 0
        while True:
            more = self.fill(size)
            at = self.buf.find(b"\r\n\r\n", max(0, seen - 3))
            if at >= 0:
                break
            if not more:
                if bytes(self.buf).strip():
                    raise ValueError("an archive ends inside a record's header")
                return None
            seen, size = len(self.buf), 2 * max(size, len(self.buf))
        out = bytes(self.buf[:at])
        del self.buf[: at + 4]
        return out


def parse_records(data: bytes):
    """Yield (headers with lower-case names, block) of each WARC record, by Content-Length."""
    src = _Inflate(data)
    while (head := src.head()) is not None:
        first, *lines = head.lstrip(b"\r\n").split(b"\r\n")
        if not first.startswith(b"WARC/"):
            raise ValueError("a record does not begin with its version")
        headers: dict[str, str] = {}
        for line in lines:
            k, _, v = line.partition(b":")
            headers.setdefault(k.strip().lower().decode("utf-8", "replace"), v.strip().decode("utf-8", "replace"))
        block = src.take(int(headers.get("content-length", "0")))
        src.take(4)
        yield headers, block


RECORD = "record_id string, record_type string, concurrent_to string, refers_to string, uri string, date string, digest string, content_type string, block binary, body_at int"


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Records of every archive below ``path`` (plain or gzip), one row each; a file goes through one task.

    body_at: bytes before the body of an HTTP block (null in other blocks).
    """

    def run(batches):
        names = ("warc-record-id", "warc-type", "warc-concurrent-to", "warc-refers-to", "warc-target-uri", "warc-date", "warc-payload-digest", "content-type")
        kinds = {"string": pa.string(), "binary": pa.binary(), "int": pa.int32()}
        schema = pa.schema([(name, kinds[kind]) for name, kind in map(str.split, RECORD.split(", "))])
        batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)
        for b in batches:
            for data in named(b, "content"):
                rows, held = [], 0
                for headers, block in parse_records(data.as_py()):
                    http = headers.get("content-type", "").startswith("application/http")
                    end = block.find(b"\r\n\r\n") if http else -1
                    rows.append([*map(headers.get, names), block, end + 4 if end >= 0 else None])
                    held += len(block)
                    if held > 4_000_000 or len(rows) >= 20_000:
                        yield batch(rows)
                        rows, held = [], 0
                if rows:
                    yield batch(rows)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    return files.mapInArrow(run, RECORD)


MAIN = ("response", "revisit")


def index_of(records: DataFrame) -> DataFrame:
    """Records without the blocks of responses and revisits, for what needs no payload."""
    return records.withColumn("block", F.when(~F.col("record_type").isin(*MAIN), F.col("block")))


def assemble(records: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """One nested row per capture: its record's columns, requests, metadata.

    A capture is a response or revisit record, whole. Requests and metadata reach it by their
    concurrent-to identifier, directly or over one other record (metadata that names the request). Records
    that name no capture are left out; captures without partners have empty arrays. Captures that share a
    record id each get all partners that name it; partners that repeat are listed as often. As a capture is
    one row, so are all its partners. ``index`` (see ``index_of``) may give the identifiers and partners
    from a written table; payloads then travel once.
    """
    index = records if index is None else index
    part = index.filter("record_type in ('request', 'metadata') and concurrent_to is not null")
    ids = index.filter(F.col("record_type").isin(*MAIN)).select(F.col("record_id").alias("concurrent_to"), F.col("record_id").alias("_capture")).distinct()
    direct = part.join(ids, "concurrent_to")
    hop = direct.select(F.col("record_id").alias("concurrent_to"), "_capture").distinct()
    indirect = part.join(ids.select("concurrent_to"), "concurrent_to", "left_anti").join(hop, "concurrent_to")
    item = F.struct("record_id", "uri", "date", "content_type", "block")
    grouped = direct.unionByName(indirect).groupBy("_capture").agg(
        F.array_sort(F.collect_list(F.when(F.col("record_type") == "request", item))).alias("requests"),
        F.array_sort(F.collect_list(F.when(F.col("record_type") == "metadata", item))).alias("metadata"),
    )
    main = records.filter(F.col("record_type").isin(*MAIN))
    out = main.join(grouped, main.record_id == F.col("_capture"), "left").drop("_capture", "concurrent_to")
    return out.withColumns({c: F.coalesce(c, F.array().cast(grouped.schema[c].dataType)) for c in ("requests", "metadata")})


def _page_id(block) -> F.Column:
    """The page id that a metadata block states, if any."""
    told = F.regexp_extract(F.decode(block, "utf-8"), r"(?:^|\n)page-id: (-?[0-9]+)", 1)
    return F.when(told != "", told).cast("long")


def report(captures: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, n_requests, n_metadata of each capture."""
    body = F.expr("substring(block, coalesce(body_at, 0) + 1)")
    response = F.col("record_type") == "response"
    stated = F.regexp_replace("digest", "^sha1:", "")
    rows = materialize(
        captures.select(
            "record_id", "record_type", F.col("refers_to").alias("names"), stated.alias("stated"), _page_id(F.get(F.col("metadata"), F.lit(0))["block"]).alias("page_id"),
            F.when(response, F.octet_length(body)).cast("long").alias("bytes"), F.when(response, sha1_base32(body)).alias("sha1"),
            F.size("requests").alias("n_requests"), F.size("metadata").alias("n_metadata"),
        ),
        "warc-captures",
    )
    # what each response that is referred to holds; very popular ones reach their revisits by broadcast
    told = F.struct(F.col("page_id").alias("page"), "bytes", "sha1")
    originals = rows.filter(response).select(F.col("record_id").alias("names"), told.alias("told"))
    popular = rows.filter("record_type = 'revisit'").groupBy("names").agg(F.count("*").alias("n")).join(originals, "names")
    out = attach(rows, materialize(popular, "warc-originals"), "names", "told", "n")
    size, sha1 = F.coalesce("told.bytes", "bytes"), F.coalesce("told.sha1", "sha1")
    sound = F.when(sha1 == F.col("stated"), sha1).otherwise(F.raise_error(F.lit("a payload is missing or does not match its digest")).cast("string"))
    return out.select("page_id", size.alias("payload_bytes"), sound.alias("payload_digest"), "record_type", F.col("told.page").alias("refers_to"), "n_requests", "n_metadata")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the pages as archives, read them back, assemble captures, and report each one.

    One row for each row of pages: null html counts as empty, rows with a null page_id are captures that no
    other refers to, repeated rows stay, an empty table gives none. Size and digest are those of the payload
    read back (a revisit's: of the response it refers to); a capture whose payload differs from the digest
    stated, or a revisit whose response is missing, is an error.
    """
    path = work_dir(spark, "warc")
    write_archives(plan_captures(table(spark, sf_dir, "pages")), path)
    records = read_archives(spark, path)
    index = materialize(index_of(records), "warc-index")
    return report(assemble(records, index))


OP2_SQL = """
with p as (select page_id, coalesce(html, '') as html from pages),
q as (select page_id, strlen(html)::bigint as payload_bytes, sha1(html) as h,
             count(*) over (partition by html) as c, min(page_id) over (partition by html) as f from p)
select page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + (((('0x' || substr(h, 1 + 5 * (k // 4)::int, 5))::bigint) >> (15 - 5 * (k % 4))::int) & 31)::int, 1)), '') as payload_digest,
  case when c > 1 and f <> page_id then 'revisit' else 'response' end as record_type,
  case when c > 1 and f <> page_id then f end as refers_to,
  1::int as n_requests, 1::int as n_metadata
from q
"""
