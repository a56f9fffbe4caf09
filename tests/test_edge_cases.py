"""Empty inputs and missing columns give empty fixed-schema results, never errors."""

import pytest

from revlens.operators import aggregates as agg
from revlens.operators import insights, ranking, trends
from revlens.plans.metrics import Sources, build_metric

DEALS = ("Deal_ID string, Lead_ID string, Deal_Stage string, Amount decimal(18,2), Margin decimal(18,4), "
         "Closing_Date date, Forecast_Category string, Product_Category string")
LEADS = "Lead_ID string, Lead_Source string, Estimated_Value decimal(18,2), Sales_Rep string, Region string"


@pytest.fixture()
def empty(spark):
    return spark.createDataFrame([], DEALS), spark.createDataFrame([], LEADS)


OPS = {
    "deals_by_stage": lambda l, d: agg.deals_by_stage(d),
    "forecast_summary": lambda l, d: agg.forecast_summary(d),
    "leads_by_source": lambda l, d: agg.leads_by_source(l),
    "region_pipeline": lambda l, d: agg.region_pipeline(l, d),
    "sales_rep_performance": lambda l, d: agg.sales_rep_performance(l, d),
    "forecast_quality": lambda l, d: agg.forecast_quality(d),
    "lead_conversion": lambda l, d: agg.lead_conversion(l, d),
    "win_rate": lambda l, d: agg.win_rate(d),
    "win_rate_by_source": lambda l, d: build_metric(Sources(deals=d, leads=l), "win_rate", "Lead_Source"),
    "monthly_trend": lambda l, d: trends.monthly_trend(d),
    "pipeline_trend": lambda l, d: trends.monthly_trend(d, forecast_category="Pipeline"),
    "revenue_by_region": lambda l, d: build_metric(Sources(deals=d, leads=l), "revenue", "Region", share=True),
    "top_deals": lambda l, d: ranking.top_deals(d, "At Risk"),
}


@pytest.mark.parametrize("name", sorted(OPS))
def test_empty_inputs(empty, name):
    deals, leads = empty
    assert OPS[name](leads, deals).count() == 0


@pytest.mark.parametrize("name", sorted(OPS))
def test_missing_columns(spark, name):
    deals = spark.createDataFrame([("D1",)], "Deal_ID string")
    leads = spark.createDataFrame([("L1",)], "Lead_ID string")
    assert OPS[name](leads, deals).count() == 0


def test_insights_on_empty_deals(empty):
    deals, leads = empty
    rows = {r["title"]: r for r in insights.auto_insights(leads, deals).collect()}
    assert rows["Average Deal Size"]["metric"] == "N/A"
    assert rows["Win Rate"]["metric"] == "N/A"
    assert rows["Management Focus Recommendation"]["metric"] == "N/A"
    assert "Top Product Category" not in rows


def test_kpis_of_empty_deals_are_zero(empty):
    deals, _ = empty
    k = agg.kpi_forecast_stage(deals).first()
    assert k["Total_Deals"] == 0 and k["Pipeline_Amount"] == 0.0 and k["Win_Rate"] is None
    assert agg.total_pipeline(deals).first()[0] == 0.0
