"""How the store is written: rows are dealt while they are narrow, sorted once, and its buckets grow with the reads."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.readwriter import DataFrameWriter

from methylspark.operators import genome
from methylspark.plans import derive
from methylspark.plans.queries import queries
from methylspark.sources import store

SF = "/root/testdata/sf0.001"


@pytest.fixture
def written(monkeypatch):
    """Plans of the tables that are saved, from the writer down."""
    plans, save = [], DataFrameWriter.saveAsTable

    def noted(self, *args, **kw):
        plans.append(self._df._jdf.queryExecution().executedPlan().toString())
        return save(self, *args, **kw)

    monkeypatch.setattr(DataFrameWriter, "saveAsTable", noted)
    return plans


@pytest.mark.parametrize("threshold", ["-1", "10m"])
def test_bases_are_made_behind_the_shuffle(spark, written, threshold):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        got = {(r.read_id, r.pos) for r in queries()["stored_region"](spark, SF).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    plan = next(p for p in written if "_first_bases" in p)
    above = plan[: plan.index("Exchange hashpartitioning(bin")]
    assert "_first_bases" in above and "_first_characters" in above
    assert ("SortMergeJoin" if threshold == "-1" else "BroadcastHashJoin") in above
    want = derive.labelled(spark, SF).filter("chrom = 'c000003' and pos < 900 and pos + 60 > 200")
    assert got == {(r.read_id, r.pos) for r in want.collect()} and got


def test_stored_counts_shuffle_no_bases(spark, written):
    """The same sites as from reads that are not stored; bases are in no shuffle, neither when the store is written nor when it is counted."""
    df = queries()["stored_site_counts"](spark, SF)
    got = df.select("context", "chrom", "start", "n_meth", "n_unmeth")
    want = queries()["site_counts"](spark, SF).select(*got.columns)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty() and not got.isEmpty()
    plan = next(p for p in written if "_first_bases" in p)
    for p in (plan, df._jdf.queryExecution().executedPlan().toString()):
        for line in p.splitlines():
            if "Exchange hashpartitioning" in line:
                below = p[p.index(line) + len(line) :].splitlines()[0]
                assert "seq#" not in below and "qual#" not in below and "xm#" not in below
    assert plan.index("_first_bases") < plan.index("Exchange hashpartitioning(bin")


@pytest.mark.parametrize("pos", [0, 1, 2, 3, 43, 44, 45, 46, 47, 48, 90])
def test_windows_inside_and_over_the_ends(spark, pos):
    """Windows of five bases and two more on both sides of 50 bases, with N beyond them."""
    text = "".join(random.Random(4).choice("ACGTacgt") for _ in range(50))
    aln = spark.createDataFrame([("c", pos, "5M", 0), (None, None, "*", 4)], "chrom string, pos int, cigar string, flag int")
    got = genome.with_reference(aln, spark.createDataFrame([("c", text)], "chrom string, seq string"), max_span=60)
    padded = "NN" + text + "N" * 60
    assert {r.chrom: r.ref for r in got.collect()} == {"c": padded[pos : pos + 9], None: None}


def test_buckets_grow_with_the_reads(spark, tmp_path, monkeypatch):
    layout = lambda path: spark.read.parquet(f"{path}/{store.LAYOUT}").first().buckets
    derive.stored(spark, SF, str(tmp_path / "few"))
    monkeypatch.setattr(derive, "_BUCKET", 500)
    derive.stored(spark, SF, str(tmp_path / "many"))
    assert layout(tmp_path / "few") == derive._tasks(spark) and layout(tmp_path / "many") == -(-4 * 1500 // 500)
    few, many = (store.referenced(store.open_store(spark, str(tmp_path / p))).drop("ref") for p in ("few", "many"))
    assert few.exceptAll(many).isEmpty() and many.exceptAll(few).isEmpty()
    want = derive.windowed(spark, SF, True).drop("ref")
    assert set(few.columns) == {*want.columns, "bin", "tile"}
    assert few.select(want.columns).exceptAll(want).isEmpty() and want.exceptAll(few.select(want.columns)).isEmpty()


def test_finished_rows_equal_given_ones(spark, tmp_path):
    """Gaps, tile borders and unmapped reads: the same rows, one sorted file a bucket, and the setting of the session is left as it was."""
    r = random.Random(2)
    contigs = spark.createDataFrame([(f"c{k}", "".join(r.choice("ACGT") for _ in range(n))) for k, n in enumerate((40_000, 9_000, 300, 0))], "chrom string, seq string")
    rows = [(k, f"c{k % 3}", r.choice((0, 8191, 8192, r.randrange(30_000))) % (40_000, 8_900, 200)[k % 3], "20M3D30M" if k % 7 == 0 else "50M", 4 if k % 50 == 0 else 0) for k in range(900)]
    rows += [(1000, None, None, "*", 4), (1001, "*", -1, "*", 4)]
    narrow = spark.createDataFrame(rows, "read_id int, chrom string, pos int, cigar string, flag int").repartition(5)
    wide = lambda df: df.withColumn("seq", F.upper(F.substring("ref", 3, 50)))
    option = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(option)
    store.write_store(narrow, contigs, str(tmp_path / "finished"), buckets=8, finish=wide)
    assert spark.conf.get(option) == before
    one = store.open_store(spark, str(tmp_path / "finished"))
    assert set(one.alignments.columns) == {*narrow.columns, "seq", "bin", "tile"}
    given = one.alignments.drop("bin", "tile")
    store.write_store(given, contigs, str(tmp_path / "given"), buckets=8)
    two = store.open_store(spark, str(tmp_path / "given"))
    mapped = lambda s: sorted(map(str, store.referenced(s).select(*given.columns, "tile", "ref").collect()))
    assert mapped(one) == mapped(two) and len(mapped(one)) == 902
    text = {x.chrom: x.seq for x in contigs.collect()}
    for x in given.collect():
        assert x.seq == (None if x.flag else (text[x.chrom][x.pos : x.pos + 50]))
    for s in (one, two):
        files = {}
        for x in s.alignments.select(F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("i"), "bin", "pos").collect():
            files.setdefault(x.f, []).append((x.i, x.bin, -1 if x.pos is None else x.pos))
        assert 1 < len(files) <= 8 and len({f.split("_")[-1] for f in files}) == len(files)
        for of in files.values():
            placed = [x[1:] for x in sorted(of)]
            assert placed == sorted(placed)
