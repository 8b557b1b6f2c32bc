"""Writers: one sorted bedGraph file for each context from one evaluation, and output in the order of input."""

import gzip
import random

from pyspark.sql import functions as F

from methylspark.sources import fastq, sinks, text


def test_bedgraph_is_one_sorted_file_from_one_evaluation(spark, tmp_path):
    rng = random.Random(3)
    rows = [(rng.choice(["CpG", "CHH"]), f"c{rng.randrange(4)}", p, p + 1, 500, 1, 1) for p in rng.sample(range(10**6), 3000)]
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    shape = "context string, chrom string, start int, end int, permille int, n_meth long, n_unmeth long"
    sites = spark.createDataFrame(rows, shape).repartition(5).mapInArrow(count, shape)
    sinks.write_bedgraph(sites, str(tmp_path / "out"))
    assert seen.value == len(rows)
    for context in ("CpG", "CHG", "CHH"):
        own = sorted(r[1:] for r in rows if r[0] == context)
        lines = (tmp_path / f"out_{context}.bedGraph").read_text().splitlines()
        assert lines == ["track type=bedGraph", *("\t".join(map(str, r)) for r in own)]
        assert sorted(map(tuple, text.read_bedgraph(spark, str(tmp_path / f"out_{context}.bedGraph")).collect())) == own


def lines_of(folder, opener=open):
    return [x for f in sorted(folder.glob("part-*")) for x in opener(f, "rt").read().splitlines()]


def test_output_in_the_order_of_input(spark, tmp_path):
    for name, n in (("a.fq", 400), ("b.fq", 300)):
        (tmp_path / name).write_text("".join(f"@{name}.{k}\nACGTAC\n+\nIIIIII\n" for k in range(n)))
    reads = fastq.read_fastq(spark, [str(tmp_path / n) for n in ("a.fq", "b.fq")]).repartition(7)
    flag = F.when(F.col("ordinal") % 3 == 0, 4).otherwise(0)
    aln = reads.select(*sinks.INPUT_ORDER, F.col("name").alias("qname"), flag.alias("flag"), F.lit("c").alias("chrom"), (F.col("ordinal") * 7 % 50).cast("int").alias("pos"), F.lit(9).alias("mapq"), F.lit("6M").alias("cigar"), F.lit("*").alias("mate_chrom"), F.lit(-1).alias("mate_pos"), F.lit(0).alias("tlen"), "seq", F.array_repeat(F.lit(40), 6).alias("qual"))
    names = [f"{f}.{k}" for f, n in (("a.fq", 400), ("b.fq", 300)) for k in range(n)]
    contigs = spark.createDataFrame([("c", 0, 60)], "chrom string, ord int, length int")
    adaptive = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sinks.write_sam(aln, contigs, str(tmp_path / "sam"), order=sinks.INPUT_ORDER)
        sinks.write_unmapped(aln, str(tmp_path / "none"), sinks.INPUT_ORDER)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", adaptive)
    assert len(list((tmp_path / "sam" / "records").glob("part-*"))) > 1
    assert [x.split("\t")[0] for x in lines_of(tmp_path / "sam" / "records")] == names
    assert [x[1:] for x in lines_of(tmp_path / "none", gzip.open)[::4]] == [x for x in names if int(x.split(".")[-1]) % 3 == 0]
