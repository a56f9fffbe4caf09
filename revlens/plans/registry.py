"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame.

Each query reads the testdata tables through the CRM views and runs one
library operator over the whole tables. Column names match the oracle SQL in
``revlens.plans.oracle``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from revlens.sources import crm_views
from revlens.sources.tables import Catalog

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}


def register(name: str):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        return fn
    return deco


class Modules:
    """Lazy CRM module frames for one directory.

    A view is built once per ``Modules`` object, so one query's uses of a
    module share the same plan; nothing outlives the object.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.cat = Catalog(spark, sf_dir)
        self.spark = spark
        self.sf_dir = sf_dir
        self._built: dict[str, DataFrame] = {}

    def _view(self, name: str) -> DataFrame:
        if name not in self._built:
            self._built[name] = crm_views.VIEW_BUILDERS[name](self.cat)
        return self._built[name]

    @property
    def leads(self) -> DataFrame:
        return self._view("Leads")

    @property
    def deals(self) -> DataFrame:
        return self._view("Deals")

    @property
    def accounts(self) -> DataFrame:
        return self._view("Accounts")

    @property
    def products(self) -> DataFrame:
        return self._view("Products")

    @property
    def vendors(self) -> DataFrame:
        return self._view("Vendors")

    @property
    def purchase_orders(self) -> DataFrame:
        return self._view("Purchase Orders")

    @property
    def activities(self) -> DataFrame:
        return self._view("Activities")

    def all(self) -> dict[str, DataFrame]:
        return {n: self._view(n) for n in crm_views.VIEW_BUILDERS}


def _load_all():
    # importing the modules registers their queries
    from revlens.plans import (queries_charts, queries_core, queries_docs, queries_health, queries_ingest,  # noqa: F401
                               queries_metrics, queries_text)


def queries() -> dict[str, QueryFn]:
    _load_all()
    return dict(QUERIES)
