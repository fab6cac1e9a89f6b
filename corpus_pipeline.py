"""Documents from raw to a training mix; each stage calls one operator of foliospark.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliospark.llm import common, decontaminate, mixing, simhash_gph, suffix_dedup, toxicity
from foliospark.session import cut_lineage

STAGES = [
    ("toxicity", toxicity.stage),
    ("simhash_near_dedup", simhash_gph.stage),
    ("suffix_dedup", suffix_dedup.stage),
    ("benchmark_decontamination", decontaminate.stage),
    ("source_mix", mixing.stage),
]
#: Trained scores, connected components and byte-wise repeats have no plain SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each one's rows are a table in the shared folder before the next reads them."""
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
