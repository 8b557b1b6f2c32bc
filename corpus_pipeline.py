"""Corpus pipeline: toxicity, near-duplicates, benchmark leaks, secrets, token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from methylspark.llm import bpe, decontaminate, secrets, simhash, toxicity
from methylspark.llm.common import materialize, table

STAGES = [
    ("toxicity", toxicity.stage),
    ("simhash_dedup", simhash.stage),
    ("decontamination", decontaminate.stage),
    ("secrets", secrets.stage),
    ("byte_bpe", bpe.stage),
]

#: Fingerprints, a trained model and merge ranks have no SQL form; tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each one's rows are written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
