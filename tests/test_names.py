import pytest

from methylspark.sources.names import output_name


@pytest.mark.parametrize("path,kind,folder,want", [
    ("/d/r_1.fastq.gz", "alignments", None, "/d/r_1.bam"), ("r.fq", "unmapped", "/out/", "/out/r.unmapped.fq.gz"), ("s3a://b/x.fq.bz2", "converted_ct", None, "s3a://b/x.CT.fq.gz"),
    ("a.b.fastq", "converted_ga", None, "a.b.GA.fq.gz"), ("reads.txt", "alignments", "o", "o/reads.txt.bam"), ("/d/x.bam", "CHG", None, "/d/x_CHG.bedGraph"), ("x.sam", "mbias", "/m", "/m/x_mbias.txt"),
    ("x_CpG.bedGraph", "merged", None, "x_CpG.merged.bedGraph"), ("x.bedgraph", "moabs", None, "x.moabs"), ("x.tsv", "methylkit", None, "x.tsv.methylKit"), ("x.gz", "CpG", None, "x.gz_CpG.bedGraph"),
])
def test_output_names(path, kind, folder, want):
    assert output_name(path, kind, folder) == want
