"""Driver contract and plan shape on sf0.001."""

import pytest

import __spark_entry__ as E


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["Deal_Stage", "Deal_Count", "Total_Amount"]
    assert df.count() > 0


def test_every_query_has_an_oracle_or_is_documented():
    rows_only = set()
    from revlens.plans.registry import queries
    missing = set(queries()) - set(E.oracle_sql())
    assert missing <= rows_only, sorted(missing - rows_only)


@pytest.mark.parametrize("name", ["deals_by_stage", "region_pipeline", "metric_revenue_by_account_name",
                                  "vector_top_k", "annotate_questions", "auto_insights"])
def test_no_python_udf_in_plans(spark, sf_small, name):
    plan = E.queries()[name](spark, sf_small)._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_pushdown_and_pruning(spark, sf_small):
    df = E.queries()["forecast_filter"](spark, sf_small)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_orderstatus:string,o_totalprice:double" in plan \
        or "o_orderkey" in plan
    assert "l_quantity" not in plan  # unused lineitem columns are pruned


def test_top_k_is_partial_before_shuffle(spark, sf_small):
    plan = E.queries()["vector_top_k"](spark, sf_small)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_partition_pruning_on_materialized_deals(spark, sf_small):
    df = E.queries()["deals_by_stage_1998"](spark, sf_small)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(Closing_Year" in plan and "= 1998)" in plan
