"""Parquet table catalog for a scale-factor directory.

Tables are read lazily; Catalyst prunes columns and pushes filters into the
Parquet scan, so callers select what they need and nothing else is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def read_table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """A fresh reader: files added or replaced since the last call are seen."""
    if name not in TABLES:
        raise KeyError(f"unknown table {name!r}")
    return spark.read.parquet(f"{base.rstrip('/')}/{name}.parquet")


class Catalog:
    """Lazy access to the tables of one directory (``cat.orders`` etc.).

    A table is listed once per ``Catalog`` object, so all uses in one query
    read the same files; nothing outlives the object.
    """

    def __init__(self, spark: SparkSession, base: str):
        self.spark = spark
        self.base = base
        self._read: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        if name not in self._read:
            self._read[name] = read_table(self.spark, self.base, name)
        return self._read[name]
