"""Documents to a training mix: five operators, each on what the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tulya.llm import decontaminate, language, linededup, minhash, mixing
from tulya.llm.common import written

#: (name, function of (spark, docs, sf_dir)), in order.
STAGES = [
    ("language_id", language.stage),
    ("line_dedup", linededup.stage),
    ("minhash_dedup", minhash.stage),
    ("decontaminate", decontaminate.stage),
    ("mixing", mixing.stage),
]

#: The fitted language model and its scores can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of sf_dir's documents; every stage is written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
