"""Names of outputs that follow from the names of inputs."""

from __future__ import annotations

import posixpath

#: Endings that are taken off an input's name (packed ones first, then one of the second list), and the output's ending.
PACKED = [".gz", ".GZ", ".bz", ".bz2"]
READS, ALIGNMENTS, SITES = [".fastq", ".fq"], [".sam", ".bam", ".cram"], [".bedGraph", ".bedgraph"]
OUTPUTS = {
    "alignments": (READS, ".bam"), "converted_ct": (READS, ".CT.fq.gz"), "converted_ga": (READS, ".GA.fq.gz"), "unmapped": (READS, ".unmapped.fq.gz"),
    "CpG": (ALIGNMENTS, "_CpG.bedGraph"), "CHG": (ALIGNMENTS, "_CHG.bedGraph"), "CHH": (ALIGNMENTS, "_CHH.bedGraph"), "mbias": (ALIGNMENTS, "_mbias.txt"),
    "merged": (SITES, ".merged.bedGraph"), "methylkit": (SITES, ".methylKit"), "moabs": (SITES, ".moabs"),
}


def without(path: str, endings: list[str]) -> str:
    """``path`` without the first of ``endings`` that it has."""
    return next((path.removesuffix(e) for e in endings if path.endswith(e)), path)


def output_name(path: str, kind: str, folder: str | None = None) -> str:
    """Where the output of a kind (see OUTPUTS) made from the input ``path`` goes: beside it, or into ``folder``."""
    endings, ending = OUTPUTS[kind]
    at, name = posixpath.split(path)
    name = without(without(name, PACKED) if endings is READS else name, endings)
    return posixpath.join(at if folder is None else folder, name + ending)
