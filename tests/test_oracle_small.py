"""Spark vs DuckDB oracle on sf0.001, inside pytest.

A representative query of each family always runs; every registered query
runs with REVLENS_FULL_ORACLE=1 (about three minutes).
"""

import os
import sys

import duckdb
import pytest

import __spark_entry__ as E
from revlens.sources.tables import TABLES

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "scripts"))
from oracle_check import SPARK_TO_SQL, rows_of  # noqa: E402

FAMILY = ["deals_by_stage", "sales_rep_performance", "lead_conversion", "forecast_quality", "monthly_trend",
          "metric_average_deal_size_by_customer_type", "share_by_region", "compound_account", "upcoming_closings",
          "module_health", "join_coverage", "auto_insights", "summary_documents", "vector_top_k",
          "annotate_questions", "chart_specs", "ingest_region_pipeline", "answer_rows",
          "detect_modules", "signature_parts", "changed_parts", "corpus_merge"]
NAMES = sorted(E.oracle_sql()) if os.environ.get("REVLENS_FULL_ORACLE") == "1" else FAMILY


@pytest.fixture(scope="module")
def con(sf_small):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_small}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, sf_small, con, name):
    sdf = E.queries()[name](spark, sf_small)
    srows = [tuple(r) for r in sdf.collect()]
    sql = E.oracle_sql()[name]
    rel = con.sql(sql)
    otypes = dict(zip(rel.columns, (str(t) for t in rel.types)))
    res = con.execute(sql)
    ocols = [d[0] for d in res.description]
    assert sorted(sdf.columns) == sorted(ocols)
    for f in sdf.schema.fields:
        assert SPARK_TO_SQL.get(f.dataType.simpleString(), f.dataType.simpleString()) == otypes[f.name], f.name
    assert rows_of(sdf.columns, srows) == rows_of(ocols, res.fetchall())
