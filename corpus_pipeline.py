"""The corpus pipeline: documents, judged, without near duplicates, repeated strings and leaked benchmark items, as tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seriesforge.llm import stages
from seriesforge.llm.common import scratch_path, table, written

STAGES = [
    ("quality rules", stages.quality_rules),
    ("near-dedup", stages.near_dedup),
    ("suffix-array dedup", stages.repeated_strings),
    ("benchmark decontamination", stages.decontamination),
    ("byte-level BPE", stages.encoding),
]

# Trees that are fitted here and XXH64 have no SQL: tests/llm compares the run with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written to the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), scratch_path(spark, f"stage-{name.replace(' ', '-')}"))
    return STAGES[-1][1](spark, docs, sf_dir)
