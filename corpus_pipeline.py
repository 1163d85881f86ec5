"""From raw documents to training sequences, a stage after the other.

Each stage takes (spark, docs, sf_dir), where docs is what the stage before has kept, and returns a DataFrame
that is written as Parquet and read again for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from unionlog.llm import decontamination, quality_rules, retrieval_packing, simhash_dedup, suffix_dedup
from unionlog.llm.common import cut, table

STAGES = [
    ("quality_rules", quality_rules.stage),
    ("simhash_near_dedup", simhash_dedup.stage),
    ("suffix_array_dedup", suffix_dedup.stage),
    ("benchmark_decontamination", decontamination.stage),
    ("retrieval_packing", retrieval_packing.stage),
]

#: Fingerprints, suffix arrays and alignments are beyond SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
