"""SQL functions for sessions, and the interfaces that models plug into."""

from __future__ import annotations

from typing import Protocol

import pandas as pd
from pyspark.sql import SparkSession

#: Temporary SQL functions by name: arguments, type and body.
SQL_FUNCTIONS = {
    "wilson_lower": ("k DOUBLE, n DOUBLE", "DOUBLE", "CASE WHEN n <= 0 THEN 0D ELSE least(1D, greatest(0D, (k / n + 3.8416D / (2 * n) - 1.96D * sqrt(k / n * (1 - k / n) / n + 3.8416D / (4 * n * n))) / (1 + 3.8416D / n))) END"),
    "rrf_score": ("weight DOUBLE, rank BIGINT", "DOUBLE", "weight / (60 + rank)"),
    "memory_decay": ("importance DOUBLE, days DOUBLE, halflife DOUBLE, accesses BIGINT", "DOUBLE", "greatest(0.01D, importance * exp(-0.693D * days / (halflife * (1 + ln(1 + accesses)))))"),
    "gate": ("similarity DOUBLE", "STRING", "CASE WHEN similarity >= 0.92D THEN 'reinforce' WHEN similarity >= 0.75D THEN 'update' ELSE 'create' END"),
    "was_valid_at": ("valid_from TIMESTAMP, valid_to TIMESTAMP, at TIMESTAMP", "BOOLEAN", "valid_from <= at AND (valid_to IS NULL OR valid_to > at)"),
    "adamic_adar": ("degree BIGINT", "DOUBLE", "1 / ln(2 + degree)"),
    "normalize_mention": ("name STRING", "STRING", r"trim(regexp_replace(translate(lower(name), '-_/.', '    '), '\\s+', ' '))"),
}


def register(spark: SparkSession) -> list[str]:
    for name, (args, kind, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")
    return sorted(SQL_FUNCTIONS)


class Embedder(Protocol):
    def embed(self, texts: pd.Series) -> pd.Series: ...


class Judge(Protocol):
    def judge(self, first: pd.Series, second: pd.Series) -> pd.DataFrame: ...
