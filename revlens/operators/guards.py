"""Required-column guards.

Columns are checked on the driver from ``df.columns`` at plan-build time; no
job runs. A missing column yields an empty frame with the operator's fixed
schema, and ``guard_report`` gives the reasons as rows.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession


def missing(df: DataFrame | None, required: Iterable[str]) -> list[str]:
    if df is None:
        return sorted(set(required))
    have = set(df.columns)
    return sorted(c for c in set(required) if c not in have)


def empty(spark: SparkSession, ddl: str) -> DataFrame:
    """Empty frame with a fixed schema given as DDL (``"a string, b bigint"``)."""
    return spark.createDataFrame([], ddl)


def guard_report(spark: SparkSession, checks: list[tuple[str, DataFrame | None, Iterable[str]]]) -> DataFrame:
    """One row per operator: name, available, missing columns, reason."""
    rows = []
    for name, df, req in checks:
        miss = missing(df, req)
        reason = ("All required columns are present." if not miss else
                  f"I cannot compute this because the required column/table is missing: {', '.join(miss)}.")
        rows.append((name, not miss, miss, reason))
    return spark.createDataFrame(rows, "operator string, available boolean, missing array<string>, reason string")
