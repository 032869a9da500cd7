"""The corpus pipeline: quality rules, near-duplicates, decontamination, mixing and sharding."""

from __future__ import annotations

from lodestar.llm import decontaminate, mixing, neardup, quality, sharding
from lodestar.runtime import scratch

STAGES = [
    ("quality rules", quality.stage),
    ("near duplicates", neardup.stage),
    ("decontamination", decontaminate.stage),
    ("mixing", mixing.stage),
    ("sharding", sharding.stage),
]

#: SQL can't express the trained model, near-duplicate and decontamination stages; tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark, sf_dir: str):
    """All stages applied to documents, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        at = scratch(spark, "pipeline-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
    return STAGES[-1][1](spark, docs, sf_dir)
