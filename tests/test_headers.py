"""Headers of several inputs: read, merged, written and read again."""

import pytest

from methylspark import __version__
from methylspark.sources import bam, headers, sinks, text
from test_domain import bam_bytes, blocked

A = ["@HD\tVN:1.4", "@SQ\tSN:c1\tLN:100\tM5:x", "@SQ\tSN:c2\tLN:50", "@RG\tID:g\tSM:s", "@PG\tID:bt\tPN:bt\tVN:2", "@PG\tID:sort\tPP:bt", "@CO\tone: a\tb"]
B = ["@SQ\tSN:c1\tLN:100", "@SQ\tSN:c9\tLN:7", "@SQ\tSN:c2\tLN:50", "@RG\tID:g\tSM:s", "@RG\tID:h", "@PG\tID:bt\tPN:bt\tVN:3", "@PG\tID:mark\tPP:bt", "@CO\ttwo"]
RECORD = "r1\t16\tc1\t5\t30\t4M\t*\t0\t0\tACGT\tIIII\tXM:Z:z..Z"


def merged(spark, *inputs, **more):
    rows = [(f"f{k}", n, x) for k, lines in enumerate(inputs) for n, x in enumerate(lines, 1)]
    h = spark.createDataFrame(rows, "file string, n int, value string")
    return [r.value for r in headers.merge_headers(h, "ms", __version__, "ms in out", **more).orderBy("n").collect()]


def test_headers_are_merged(spark):
    assert merged(spark, A, B, sorted_by="coordinate") == [
        "@HD\tVN:1.6\tSO:coordinate", "@SQ\tSN:c1\tLN:100\tM5:x", "@SQ\tSN:c2\tLN:50", "@SQ\tSN:c9\tLN:7", "@RG\tID:g\tSM:s", "@RG\tID:h",
        "@PG\tID:bt\tPN:bt\tVN:2", "@PG\tID:sort\tPP:bt", "@PG\tID:bt.2\tPN:bt\tVN:3", "@PG\tID:mark\tPP:bt.2",
        f"@PG\tID:ms\tPN:ms\tPP:mark\tVN:{__version__}\tCL:ms in out", f"@PG\tID:ms.1\tPN:ms\tPP:sort\tVN:{__version__}\tCL:ms in out", "@CO\tone: a\tb", "@CO\ttwo",
    ]
    assert merged(spark, A, A)[1:4] == A[1:4] and len(merged(spark, A, A)) == len(A) + 1
    assert merged(spark, ["@PG\tID:ms"])[1:] == ["@PG\tID:ms", f"@PG\tID:ms.1\tPN:ms\tPP:ms\tVN:{__version__}\tCL:ms in out"]
    assert merged(spark)[1:] == [f"@PG\tID:ms\tPN:ms\tVN:{__version__}\tCL:ms in out"]


@pytest.mark.parametrize("other,match", [(["@SQ\tSN:c2\tLN:51"], "two lengths"), (["@SQ\tSN:c2\tLN:50", "@SQ\tSN:c1\tLN:100"], "different orders"), (["@RG\tID:g\tSM:t"], "two descriptions")])
def test_conflicts_are_errors(spark, other, match):
    with pytest.raises(Exception, match=match):
        merged(spark, A, other)


def test_headers_of_files_make_a_round_trip(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.sam").write_text("\n".join([*A, RECORD]) + "\n")
    (tmp_path / "in" / "b.sam").write_text("\n".join([*B, RECORD.replace("r1", "r2")]) + "\n")
    h = headers.read_sam_headers(spark, str(tmp_path / "in"))
    one = headers.merge_headers(h, "ms", __version__, "ms --all")
    contigs = spark.createDataFrame([], "chrom string, ord int, length int")
    sinks.write_sam(text.read_sam(spark, str(tmp_path / "in")), contigs, str(tmp_path / "out"), header=one)
    lines = [x for f in sorted((tmp_path / "out" / "header").glob("part-*")) for x in f.read_text().splitlines()]
    kept = {x for x in A + B if x[:3] in ("@RG", "@CO")} | {"@SQ\tSN:c1\tLN:100\tM5:x", "@SQ\tSN:c2\tLN:50", "@SQ\tSN:c9\tLN:7"}
    assert kept <= set(lines) and lines[0].startswith("@HD") and [x[:3] for x in lines] == sorted((x[:3] for x in lines), key=["@HD", "@SQ", "@RG", "@PG", "@CO"].index)
    whole = tmp_path / "again.sam"
    whole.write_text("\n".join(lines) + "\n" + "".join(f.read_text() for f in (tmp_path / "out" / "records").glob("part-*")))
    again = headers.read_sam_headers(spark, str(whole))
    assert [r.value for r in again.orderBy("n").collect()] == lines and text.read_sam(spark, str(whole)).count() == 2


def test_bam_headers(spark, tmp_path):
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "x.bam").write_bytes(blocked(bam_bytes([], ["c1", "c2"]), 23))
    assert [(r.n, r.value) for r in headers.read_bam_headers(spark, str(tmp_path / "b")).orderBy("n").collect()] == [(1, "@CO"), (2, "@SQ\tSN:c1\tLN:1000"), (3, "@SQ\tSN:c2\tLN:1000")]
    assert bam.read_bam(spark, str(tmp_path / "b")).count() == 0
