"""Reader of FASTQ files: records are framed inside the splits that tasks read."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from methylspark.operators.staging import written

#: Lines of a split that are looked at to find where its first record begins.
LOOK = 400
#: Up to so many splits (a row of about 150 bytes each) reach the records by broadcast.
SPLITS_BROADCAST = 200_000
SHAPE = "entry int, file string, block long, kind string, line long, n long, name string, seq string, qual string, piece array<string>"
_SCHEMA = pa.schema([
    ("entry", pa.int32()), ("file", pa.string()), ("block", pa.int64()), ("kind", pa.string()), ("line", pa.int64()), ("n", pa.int64()),
    ("name", pa.string()), ("seq", pa.string()), ("qual", pa.string()), ("piece", pa.list_(pa.string())),
])


def first_record(lines: pa.Array) -> int | None:
    """Which of the first four lines begins a record; None where too few lines are held to tell.

    Names begin with @ and the third lines of records with +, sequences with neither, so four lines in a row fit one
    way only. A quality line may begin with either and decides nothing.
    """
    held = lines.slice(0, LOOK)
    filled = np.flatnonzero(pc.not_equal(held, "").to_numpy(zero_copy_only=False))
    n = filled[-1] + 1 if len(filled) else 0  # empty lines may end a file
    at, plus = (pc.starts_with(held, mark).to_numpy(zero_copy_only=False)[:n] for mark in "@+")
    if n < 4:
        return None
    fits = [p for p in range(4) if at[p::4].all() and plus[(p + 2) % 4 :: 4].all()]
    if len(fits) != 1:
        raise ValueError("lines that are no FASTQ records")
    return fits[0]


class _Split:
    """Frames the lines of one split as they come; what it gives out are record batches of SHAPE."""

    def __init__(self, entry: int, file: str, block: int):
        self.key, self.begun = (entry, file, block), block == 0
        self.held, self.at, self.lines = pa.array([], pa.string()), 0, 0

    def _batch(self, rows: int, kind: str, **columns) -> pa.RecordBatch:
        own = dict(zip(("entry", "file", "block"), self.key)) | {"kind": kind}
        fields = [columns.get(f.name, pa.repeat(pa.scalar(own[f.name], f.type), rows) if f.name in own else pa.nulls(rows, f.type)) for f in _SCHEMA]
        return pa.RecordBatch.from_arrays(fields, schema=_SCHEMA)

    def _piece(self, kind: str, lines: pa.Array) -> pa.RecordBatch:
        return self._batch(1, kind, line=pa.array([self.at]), piece=pa.array([lines.to_pylist()], pa.list_(pa.string())))

    def feed(self, lines: pa.Array):
        self.lines += len(lines)
        self.held = pa.concat_arrays([self.held, lines]) if len(self.held) else lines
        if not self.begun:
            first = first_record(self.held)
            if first is None:
                return
            self.begun = True
            yield self._piece("h", self.held.slice(0, first))
            self.held, self.at = self.held.slice(first), first
        n = len(self.held) // 4
        if n:
            name, seq, plus, qual = (self.held.take(pa.array(np.arange(k, 4 * n, 4))) for k in range(4))
            marked = pc.and_(pc.starts_with(name, "@"), pc.starts_with(plus, "+"))
            blank = pc.equal(pc.binary_join_element_wise(name, seq, plus, qual, ""), "")
            if not pc.all(pc.or_(marked, blank)).as_py():
                raise ValueError("lines that are no FASTQ records")
            line = pa.array(self.at + 4 * np.arange(n))
            yield self._batch(n, "r", line=line, name=name, seq=seq, qual=qual).filter(pc.invert(blank))
            self.held, self.at = self.held.slice(4 * n), self.at + 4 * n

    def end(self):
        """What is left over, and how many lines there were."""
        yield self._piece("t" if self.begun else "l", self.held)
        yield self._batch(1, "s", n=pa.array([self.lines]))


def _frame(batches):
    now, split = None, None
    for b in batches:
        if not b.num_rows:
            continue
        files = b.column(1).dictionary_encode()
        codes, entries, blocks = files.indices.to_numpy(), b.column(0).to_numpy(), b.column(2).to_numpy()
        fresh = np.r_[True, (codes[1:] != codes[:-1]) | (blocks[1:] != blocks[:-1]) | (entries[1:] != entries[:-1])]
        starts = np.flatnonzero(fresh)
        for lo, hi in zip(starts, np.r_[starts[1:], b.num_rows]):  # one step for each split in the batch
            key = (int(entries[lo]), files.dictionary[codes[lo]].as_py(), int(blocks[lo]))
            if key != now:
                if split:
                    yield from split.end()
                now, split = key, _Split(*key)
            yield from split.feed(b.column(3).slice(lo, hi - lo))
    if split:
        yield from split.end()


def read_fastq(spark: SparkSession, paths: str | list[str], mate: int = 1, upto: int | None = None) -> DataFrame:
    """file, ordinal, mate, name, seq, qual of plain or compressed FASTQ files.

    ``paths`` is a list, or names with commas between them; each may be a folder or a pattern, whose files come in
    the order of their names. ``file`` counts files in that order, ``ordinal`` reads of a file. ``upto`` keeps the
    first reads of each file.

    Texts are read once, in splits. A task finds where records begin in its split and frames them four lines at a
    time, by columns. Lines of records that reach over a split's ends, a few a split, are put together in a table of
    their own; the records themselves are written once (``staging.written``) and never shuffled. Line numbers, from
    the counted lines of the splits before, hold each split to what it took for a first record. A file that ends inside
    a record, or holds other lines, is an error; empty lines after the last record are passed over.
    """
    paths = [p.strip() for p in paths.split(",")] if isinstance(paths, str) else paths
    each = [spark.read.text(p).select(F.lit(k).alias("entry"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value") for k, p in enumerate(paths)]
    read = written(reduce(DataFrame.unionByName, each).mapInArrow(_frame, SHAPE), "fastq")
    key = ["entry", "file", "block"]
    earlier = Window.partitionBy("entry", "file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each split
    splits = read.filter("kind = 's'").select(*key, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"), (F.dense_rank().over(Window.orderBy("entry", "file")) - 1).alias("k"))
    near = F.broadcast if splits.count() <= SPLITS_BROADCAST else lambda x: x
    wrong = F.raise_error(F.lit("records of a FASTQ file do not begin where a split took them to")).cast("long")
    place = F.col("before") + F.col("line")
    ordinal = F.when(place % 4 == 0, F.expr("(before + line) div 4")).otherwise(wrong)
    whole = read.filter("kind = 'r'").join(near(splits), key).select("k", ordinal.alias("ordinal"), "name", "seq", "qual")
    # the lines after a split's last whole record go on in the next splits, up to the first whole record there
    pieces = read.filter("kind in ('h', 'l', 't')").join(splits, key)
    run = F.count_if(F.col("kind") == "t").over(Window.partitionBy("k").orderBy("block", "kind"))
    parts = F.array_sort(F.collect_list(F.struct("block", "kind", place.alias("at"), "piece")))
    g = pieces.withColumn("g", run).groupBy("k", "g").agg(parts.alias("p"))
    g = g.select("k", F.col("p")[0]["at"].alias("at"), F.flatten(F.transform("p", lambda x: x["piece"])).alias("l"))
    full = F.expr("size(l) div 4")
    cut = F.exists(F.slice("l", full * 4 + 1, F.size("l")), lambda x: x != "") | (F.col("at") % 4 != 0)
    ended = F.when(cut, F.raise_error(F.lit("a FASTQ file ends inside a record")).cast("int")).otherwise(full)
    line = lambda n, j: F.get(F.col("l"), (n * 4 + j).cast("int"))
    found = F.transform(F.sequence(F.lit(0), F.greatest(ended - 1, F.lit(0))), lambda n: F.struct((F.col("at") / 4 + n).cast("long").alias("ordinal"), *[line(n, j).alias(c) for j, c in enumerate(("name", "seq", "plus", "qual"))]))
    rest = g.select("k", F.explode(found).alias("r")).select("k", "r.*").filter("concat_ws('', name, seq, plus, qual) != ''")
    other = F.raise_error(F.lit("lines that are no FASTQ records")).cast("string")
    rest = rest.withColumn("name", F.when(F.col("name").startswith("@") & F.col("plus").startswith("+"), F.col("name")).otherwise(other)).drop("plus")
    out = whole.unionByName(rest)
    if upto is not None:
        out = out.filter(F.col("ordinal") < upto)
    return out.select(F.col("k").alias("file"), "ordinal", F.lit(mate).alias("mate"), F.regexp_extract("name", r"^@(\S*)", 1).alias("name"), "seq", "qual")


def read_fastq_pairs(spark: SparkSession, first: str | list[str], second: str | list[str], upto: int | None = None) -> DataFrame:
    """file, ordinal, name, seq1, qual1, seq2, qual2: read n of file k of ``first`` with read n of file k of ``second``.

    The name is that of mate 1. A read without its mate is an error.
    """
    a, b = [read_fastq(spark, p, m, upto).select("file", "ordinal", *[F.col(c).alias(f"{c}{m}") for c in ("name", "seq", "qual")]) for m, p in ((1, first), (2, second))]
    # of mate 2 only what is given out travels, and that it is there
    b = b.withColumn("name2", F.col("name2").isNotNull())
    lost = F.col("name1").isNull() | F.col("name2").isNull()
    name = F.when(lost, F.raise_error(F.lit("a read has no mate in the other file")).cast("string")).otherwise(F.col("name1"))
    return a.join(b, ["file", "ordinal"], "full").select("file", "ordinal", name.alias("name"), "seq1", "qual1", "seq2", "qual2")


def reads_per_file(reads: DataFrame) -> DataFrame:
    """file, reads: how many reads each FASTQ file gave."""
    return reads.groupBy("file").agg(F.count("*").alias("reads"))
