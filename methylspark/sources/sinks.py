"""Writers of the domain's text formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from methylspark.functions.seq import encode_phred, has_flag, reference_span, reverse_complement
from methylspark.operators.staging import remove, stage_path, written


TRACK = "track type=bedGraph"


def write_bedgraph(sites: DataFrame, path: str) -> None:
    """One sorted file ``path``_<context>.bedGraph for each of the three contexts, which begins with the track line.

    ``sites`` are evaluated once, into a stage table that the sort takes its ranges from. All contexts are sorted
    and written together, a part file for each range and context, and then put together in the order of ranges
    by the file system.
    """
    spark = sites.sparkSession
    cols = ["chrom", "start", "end", "permille", "n_meth", "n_unmeth"]
    stage, parts = stage_path(spark, "bedgraph"), stage_path(spark, "bedgraph")
    rows = written(sites.select("context", "chrom", "start", F.concat_ws("\t", *[F.col(c).cast("string") for c in cols]).alias("value")), "bedgraph", stage)
    by = ["context", "chrom", "start"]
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.repartitionByRange(ranges, *by).sortWithinPartitions(*by).select("context", "value").write.partitionBy("context").text(parts)
    for context in ("CpG", "CHG", "CHH"):
        join_files(spark, f"{parts}/context={context}", f"{path}_{context}.bedGraph", TRACK)
    for folder in (stage, parts):
        remove(spark, folder)


def join_files(spark: SparkSession, folder: str, target: str, first_line: str | None = None) -> None:
    """Make ``target`` of a line, if one is given, and the part files of ``folder`` (which may be absent), in the order of their names.

    The file system appends the files where it can (HDFS); elsewhere their bytes are copied one file after the other.
    """
    hadoop = spark.sparkContext._jvm.org.apache.hadoop
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    at, to = hadoop.fs.Path(folder), hadoop.fs.Path(target)
    fs = to.getFileSystem(conf)
    names = sorted(x.getPath().getName() for x in fs.listStatus(at)) if fs.exists(at) else []
    files = [hadoop.fs.Path(at, n) for n in names if n.startswith("part-")]
    out = fs.create(to, False)
    try:
        if first_line is not None:
            out.write(bytearray(f"{first_line}\n".encode()))
        if fs.getScheme() != "hdfs":
            for f in files:
                source = fs.open(f)
                try:
                    hadoop.io.IOUtils.copyBytes(source, out, 1 << 20, False)
                finally:
                    source.close()
    finally:
        out.close()
    if fs.getScheme() == "hdfs" and files:
        own = spark.sparkContext._gateway.new_array(hadoop.fs.Path, len(files))
        for k, f in enumerate(files):
            own[k] = f
        fs.concat(to, own)


def write_table(df: DataFrame, path: str, sep: str = "\t", header: bool = True) -> None:
    """methylKit, MOABS, M-bias, BEAT and matrix tables as separated text."""
    df.write.option("sep", sep).option("header", str(header).lower()).csv(path)


def write_mbias(m: DataFrame, path: str) -> None:
    """OT, OB, CTOT, CTOB by position, then mate; positions without calls are left out."""
    rank = F.array_position(F.array(*[F.lit(s) for s in ("OT", "OB", "CTOT", "CTOB")]), F.col("strand"))
    out = m.filter("n_meth + n_unmeth > 0").orderBy(rank, "position", "read")
    write_table(out.select(F.col("strand").alias("Strand"), F.col("read").alias("Read"), F.col("position").alias("Position"), F.col("n_meth").alias("nMethylated"), F.col("n_unmeth").alias("nUnmethylated")), path)


def fastq_records(aln: DataFrame) -> DataFrame:
    """Unmapped reads as FASTQ records, reversed reads turned back."""
    back = has_flag(F.col("flag"), 16)
    qual = encode_phred(F.when(back, F.reverse("qual")).otherwise(F.col("qual")))
    seq = F.when(back, reverse_complement(F.col("seq"))).otherwise(F.col("seq"))
    return aln.filter(has_flag(F.col("flag"), 4)).select(F.concat_ws("\n", F.concat(F.lit("@"), "qname"), seq, F.lit("+"), qual).alias("value"))


def _characters(rows: DataFrame):
    """The column ``qual`` as characters: as it is, or encoded from numbers."""
    return F.col("qual") if rows.schema["qual"].dataType.typeName() == "string" else encode_phred(F.col("qual"))


def write_fastq(reads: DataFrame, path: str, compression: str | None = None) -> None:
    """Reads (name, seq, qual as numbers or characters) as FASTQ, a file for each partition, in their order."""
    record = F.concat_ws("\n", F.concat(F.lit("@"), F.col("name").cast("string")), "seq", F.lit("+"), _characters(reads))
    w = reads.select(record.alias("value")).write
    (w.option("compression", compression) if compression else w).text(path)


def write_fastq_pairs(first: DataFrame, path: str, compression: str | None = None, per_file: int = 200_000) -> None:
    """Pairs (name, seq1, qual1, seq2, qual2; qualities as characters) as FASTQ in ``path``/mate=1 and ``path``/mate=2.

    Both mates are written by one job, from one evaluation: a task has a file of each open and adds a record to both, so record
    n of file k of one folder is the mate of record n of file k of the other, and nothing is dealt or sorted for that. A file has
    ``per_file`` records at most.
    """
    record = lambda k: F.concat_ws("\n", F.concat(F.lit("@"), F.col("name").cast("string")), f"seq{k}", F.lit("+"), f"qual{k}")
    both = first.select(F.explode(F.array(*[F.struct(F.lit(k).alias("mate"), record(k).alias("value")) for k in (1, 2)])).alias("r")).select("r.*")
    conf, name = first.sparkSession.conf, "spark.sql.maxConcurrentOutputFileWriters"
    before = conf.get(name)
    # with files open side by side Spark does not sort a task's rows by folder
    conf.set(name, "2")
    try:
        w = both.write.partitionBy("mate").option("maxRecordsPerFile", str(per_file))
        (w.option("compression", compression) if compression else w).text(path)
    finally:
        conf.set(name, before)


def write_unmapped(aln: DataFrame, path: str, order: list[str] | None = None) -> None:
    """Unmapped reads as compressed FASTQ; with ``order`` (see ``write_sam``) in the order of input."""
    fastq_records(aln.orderBy(*order) if order else aln).write.option("compression", "gzip").text(path)


#: Columns that the FASTQ reader gives a read and that tell its place in the input.
INPUT_ORDER = ["file", "ordinal", "mate"]


#: Column, tag and type of each tag that is written.
TAGS = [("as_score", "AS", "i"), ("xs_score", "XS", "i"), ("nm", "NM", "i"), ("xm", "XM", "Z"), ("xx", "XX", "Z"), ("xr", "XR", "Z"), ("xg", "XG", "Z")]


def sam_lines(aln: DataFrame, keep: list[str] = ()) -> DataFrame:
    """SAM text of alignments (and ``keep`` columns): positions from 1, without tags that are null."""
    size = F.length if aln.schema["qual"].dataType.typeName() == "string" else F.size
    qual = F.when(size("qual") > 0, _characters(aln)).otherwise("*")
    before, after = ["qname", "flag", "chrom", "pos", "mapq", "cigar"], ["mate_chrom", "mate_pos", "tlen", "seq"]
    fields = [F.col(c) + 1 if c in ("pos", "mate_pos") else F.col(c) for c in before + after]
    tags = [F.concat(F.lit(f"{t}:{k}:"), F.col(c).cast("string")) for c, t, k in TAGS if c in aln.columns]
    return aln.select(*keep, F.concat_ws("\t", *[f.cast("string") for f in fields], qual, *tags).alias("value"))


def write_sam(aln: DataFrame, contigs: DataFrame, path: str, program: str = "methylspark", by_position: bool = False, order: list[str] | None = None, header: DataFrame | None = None, compression: str | None = None) -> None:
    """Header lines in ``path``/header, alignments in ``path``/records: one after the other they are a SAM text.

    ``by_position`` sorts by contig order, position, end and mate, unplaced reads last. ``order`` names columns that
    carry the order of input, such as INPUT_ORDER. Either way rows are sorted by ranges over all tasks, and the
    part files in the order of their names are in that order. ``header`` (n, value), such as ``headers.merge_headers``
    makes it, stands in place of lines made from ``contigs``. Alignments that bring their contig's ``ord`` are not joined to ``contigs``.
    What is sorted are lines, so a quality takes one byte. ``compression`` (such as gzip) is that of the records' files.
    """
    sorted_by = "coordinate" if by_position else "unsorted"
    ends = contigs.sparkSession.createDataFrame([(0, 0, f"@HD\tVN:1.6\tSO:{sorted_by}"), (2, 0, f"@PG\tID:{program}\tPN:{program}")], "k int, ord int, value string")
    sq = F.concat(F.lit("@SQ\tSN:"), "chrom", F.lit("\tLN:"), F.col("length").cast("string"))
    head = contigs.select(F.lit(1).alias("k"), F.col("ord").cast("int").alias("ord"), sq.alias("value")).unionByName(ends)
    head = head.orderBy("k", "ord") if header is None else header.orderBy("n")
    head.select("value").write.text(f"{path}/header")
    if by_position:
        placed = aln.withColumn("_ord", F.col("ord")) if "ord" in aln.columns else aln.join(contigs.select("chrom", F.col("ord").alias("_ord")), "chrom", "left")
        placed = placed.withColumns({"_pos": F.col("pos"), "_end": F.col("pos") + reference_span(F.col("cigar")), "_two": has_flag(F.col("flag"), 128)})
        lines = sam_lines(placed, ["_ord", "_pos", "_end", "_two"]).orderBy(F.asc_nulls_last("_ord"), "_pos", "_end", "_two")
    elif order:
        lines = sam_lines(aln, order).orderBy(*order)
    else:
        lines = sam_lines(aln)
    w = lines.select("value").write
    (w.option("compression", compression) if compression else w).text(f"{path}/records")


def write_fasta(contigs: DataFrame, path: str, width: int = 60) -> None:
    """A record for each contig, in lines of ``width`` bases; in order of ``ord`` where it is given."""
    rows = contigs.orderBy("ord") if "ord" in contigs.columns else contigs
    body = F.regexp_replace("seq", f"(.{{{width}}})(?=.)", "$1\n")
    rows.select(F.concat(F.lit(">"), "chrom", F.lit("\n"), body).alias("value")).write.text(path)


def report_lines(chosen: DataFrame, totals: DataFrame) -> DataFrame:
    """n, value: the run's report from the one row of ``metrics`` or ``pair_metrics`` and the one row of ``context_totals``.

    A run of pairs has lines for concordant and discordant pairs, as shares of pairs, and for singletons.

    Shares of nothing are written as nan.
    """

    def lines(df, first, named_counts):
        share = lambda a, b: F.when(F.col(b) > 0, F.format_string("%6.2f%%", F.lit(100.0) * F.col(a) / F.nullif(F.col(b), F.lit(0)))).otherwise("nan")
        rows = [F.struct(F.lit(first + k).alias("n"), F.concat(F.lit(f"{label}\t"), F.col(a).cast("string"), F.lit("\t"), share(a, b)).alias("value")) for k, (label, a, b) in enumerate(named_counts)]
        return df.select(F.explode(F.array(*rows)).alias("r")).select("r.*")

    strands = [(name, f"strand{k}", "reads") for k, name in enumerate(("OT", "OB", "CTOT", "CTOB"))]
    contexts = [(f"methylated {c}", f"m_{c.lower()}", f"t_{c.lower()}") for c in ("CpG", "CHG", "CHH")]
    if "concordant" in chosen.columns:
        chosen = chosen.withColumns({"pairs": F.floor(F.col("reads") / 2), "unmapped": F.col("reads") - sum(F.col(f"strand{k}") for k in range(4))})
        kinds = [("pairs", "pairs", "pairs"), ("concordant pairs", "concordant", "pairs"), ("discordant pairs", "discordant", "pairs"), ("singletons", "singletons", "reads")]
    else:
        kinds = []
    return lines(chosen, 0, [("reads", "reads", "reads"), *kinds, *strands, ("unmapped", "unmapped", "reads")]).unionByName(lines(totals, 100, contexts))


def write_report(chosen: DataFrame, totals: DataFrame, path: str) -> None:
    report_lines(chosen, totals).orderBy("n").select("value").write.text(path)
