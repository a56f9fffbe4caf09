"""One-pass report aggregates against the group-by operators."""

import datetime as dt
import random

from pyspark.sql import functions as F

from revlens.operators import aggregates as agg
from revlens.operators import documents, insights, ranking, report, trends

DEALS = "Deal_ID bigint, Lead_ID bigint, Amount decimal(18,2), Deal_Stage string, Forecast_Category string, Closing_Date date, Product_Category string, Region string"
LEADS = "Lead_ID bigint, Lead_Source string, Estimated_Value decimal(18,2), Sales_Rep string, Region string"


def tables(spark, seed=1, n=400):
    from decimal import Decimal
    r = random.Random(seed)
    pick = lambda *x: r.choice([*x, None])
    deals = [(i, pick(*range(60)), pick(*(Decimal(k * 10 - 30) for k in range(12))), pick("Closed Won", "Closed Lost", "Negotiation", "Quotation Sent"),
              pick("Pipeline", "Commit", "At Risk", "Best Case", "Closed", "Omitted"), pick(*(dt.date(2024, m, 5) for m in (1, 2, 5, 9))), pick("A", "B", "C"), pick("N", "S"))
             for i in range(n)]
    leads = [(pick(*range(50)), pick("web", "fair"), pick(Decimal(5), Decimal("7.5")), pick("x", "y", "z"), pick("N", "S")) for _ in range(70)]
    return spark.createDataFrame(leads, LEADS), spark.createDataFrame(deals, DEALS)


def first(df, *cols):
    row = df.select(*cols).first()
    return tuple(row) if row else None


def struct(row, name):
    return tuple(row[name]) if row[name] is not None else None


def test_facts_equal_the_operators(spark):
    for seed in range(3):
        leads, deals = tables(spark, seed)
        f = report.facts(report.build(leads, deals)).first()
        kpi = agg.kpi_forecast_stage(deals).first()
        for c in ("Total_Deals", "Pipeline_Amount", "Pipeline_Deals", "Commit_Amount", "At_Risk_Amount", "Closed_Won_Amount", "Closed_Won", "Closed_Lost", "Average_Deal_Size", "Win_Rate"):
            assert f[c] == kpi[c], c
        assert struct(f, "top_Product_Category") == first(agg.product_category_revenue(deals), "Product_Category", "Total_Amount", "Deal_Count")
        assert struct(f, "top_Region") == first(ranking.top_n(agg._count_and_sum(deals.where("Region is not null"), "Region", "Deal_ID", "Amount", "c", "v", "v"), "v", "Region", 1), "Region", "v", "c")
        assert struct(f, "top_Deal_Stage") == first(agg.deals_by_stage(deals), "Deal_Stage", "Total_Amount", "Deal_Count")
        assert struct(f, "weakest") == first(agg.forecast_quality(deals), "Product_Category", "Weak_Forecast_Amount", "Weak_Forecast_Ratio")
        assert struct(f, "open_region") == first(agg.region_pipeline(leads, deals), "Region", "Total_Amount")
        assert struct(f, "top_source") == first(ranking.top_source(leads), "Lead_Source", "Total_Estimated_Value", "Lead_Count")
        assert struct(f, "conversion") == first(agg.lead_conversion(leads, deals), "Lead_Source", "Estimated_Value", "Conversion_Rate")
        rep = ranking.top_n(agg.sales_rep_performance(leads, deals), "Total_Deal_Amount", "Sales_Rep", 1)
        assert struct(f, "top_rep") == first(rep, "Sales_Rep", "Total_Deal_Amount", "Deal_Count")


def test_months_forecasts_and_regions_of_leads(spark):
    leads, deals = tables(spark, 5)
    r = report.build(leads, deals.drop("Region"))
    assert struct(report.facts(r).first(), "open_region") == first(agg.region_pipeline(leads, deals.drop("Region")), "Region", "Total_Amount")
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(report.pipeline_months(r)) == key(trends.monthly_trend(deals, forecast_category="Pipeline"))
    assert key(report.forecast_totals(r)) == key(agg.forecast_summary(deals).select("Forecast_Category", "Total_Amount"))


def test_own_reps_of_deals(spark):
    leads, deals = tables(spark, 6)
    own = deals.withColumn("Sales_Rep", F.when(F.col("Deal_ID") % 3 > 0, F.concat(F.lit("r"), F.col("Deal_ID") % 4)))
    rep = ranking.top_n(agg.sales_rep_performance(leads, own), "Total_Deal_Amount", "Sales_Rep", 1)
    assert struct(report.facts(report.build(leads, own)).first(), "top_rep") == first(rep, "Sales_Rep", "Total_Deal_Amount", "Deal_Count")


def test_lists_equal_the_operators(spark):
    _, deals = tables(spark, 7)
    got = report.top_lists(deals, 10)
    for name, want in (("At Risk", ranking.top_deals(deals, "At Risk")), ("Commit", ranking.top_deals(deals, "Commit")), ("Upcoming", ranking.upcoming_closings(deals))):
        assert [r.Deal_ID for r in got.where(F.col("list") == name).orderBy("place").collect()] == [r.Deal_ID for r in want.collect()]


def test_missing_columns_and_empty_frames(spark):
    leads, deals = tables(spark, 8)
    few = deals.select("Deal_ID", "Amount")
    assert [r.title for r in insights.auto_insights(leads.select("Lead_ID"), few).collect()][0] == "Total Open Pipeline Value"
    assert documents.summary_documents(leads.select("Lead_ID"), few).count() == 0
    assert documents.summary_documents(leads.limit(0), deals.limit(0)).count() == 0
    assert report.facts(report.build(leads.limit(0), deals.limit(0))).first().Total_Deals == 0


def test_deals_are_aggregated_in_one_scan(spark, tmp_path):
    """One scan of Deals for every number, one of four columns for the ordered lists, and no copy of Deals on disk."""
    leads, deals = tables(spark, 9)
    leads.write.parquet(f"{tmp_path}/leads")
    deals.write.parquet(f"{tmp_path}/deals")
    leads, deals = spark.read.parquet(f"{tmp_path}/leads"), spark.read.parquet(f"{tmp_path}/deals")
    scans = lambda df: df._jdf.queryExecution().executedPlan().toString().count(f"{tmp_path}/deals")
    assert scans(report.deal_cube(deals, False)) == 1
    r = report.build(leads, deals, several=True)
    assert r.cube.columns.count("Deal_ID") == 0 and scans(report.facts(r)) == 0
    assert scans(insights.auto_insights(leads, deals, r)) == 0 and scans(documents.summary_documents(leads, deals, None, r)) == 1
    plan = report.top_lists(deals, 10)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Product_Category" not in plan
