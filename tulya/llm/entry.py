"""The queries of this subpackage and the SQL that some of them can be held against."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import sql

_WHERE = {
    "op1_decontaminate": ("decontaminate", "op1"),
    "op2_language_id": ("language", "op2"),
    "op3_line_dedup": ("linededup", "op3"),
    "op4_mixing": ("mixing", "op4"),
    "op5_warc": ("warc", "op5"),
    "op6_lm_score": ("pseudolikelihood", "op6"),
    "op7_quality_rules": ("rules", "op7"),
    "op8_quality_classifier": ("kneserney", "op8"),
    "op9_minhash": ("minhash", "op9"),
    "op10_substring_dedup": ("substrings", "op10"),
    "op11_fingerprints": ("fingerprints", "op11"),
    "op12_filter_audit": ("audit", "op12"),
    "op13_spelling": ("spelling", "op13"),
}


def _query(module: str, name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return getattr(importlib.import_module(f"{__package__}.{module}"), name)(spark, sf_dir)

    return run


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: _query(*v) for k, v in _WHERE.items()} | {"pipeline": _pipeline}


def oracle_sql() -> dict[str, str]:
    return dict(sql.ORACLES)
