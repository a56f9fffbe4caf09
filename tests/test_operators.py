"""Operator behaviour on the reference's test shapes (own values)."""

from decimal import Decimal

import pytest

from conftest import rows
from revlens.operators import aggregates as agg
from revlens.operators import joins, ranking, trends
from revlens.plans.metrics import Sources, build_metric

D = Decimal


@pytest.fixture()
def leads(spark):
    data = [("L001", "Website Inquiry", D("500000"), "Aisha Khan", "UAE", "EPC"),
            ("L002", "Partner Channel", D("300000"), "Omar Ali", "Saudi Arabia", "Distributor"),
            ("L003", "Partner Channel", D("1200000"), "Omar Ali", "Saudi Arabia", "Installer"),
            ("L004", "Referral", D("250000"), "Sara Noor", "Oman", "Government Client"),
            ("L005", "Website Inquiry", D("150000"), "Aisha Khan", "Dubai", "Commercial Client")]
    return spark.createDataFrame(data, "Lead_ID string, Lead_Source string, Estimated_Value decimal(18,2), "
                                       "Sales_Rep string, Region string, Customer_Type string")


@pytest.fixture()
def deals(spark):
    import datetime as dt
    data = [("D001", "L001", "Closed Won", D("1000000"), D("150000"), dt.date(2024, 6, 1), "Closed", "Panels"),
            ("D002", "L001", "Closed Lost", D("500000"), D("60000"), dt.date(2024, 7, 1), "Omitted", "Panels"),
            ("D003", "L002", "Negotiation", D("200000"), D("30000"), dt.date(2024, 8, 1), "Pipeline", "Batteries"),
            ("D004", "L003", "Proposal", D("700000"), D("90000"), dt.date(2024, 9, 1), "At Risk", "Batteries"),
            ("D005", "L005", "Closed Won", D("350000"), D("50000"), dt.date(2024, 11, 1), "Pipeline", "Panels")]
    return spark.createDataFrame(data, "Deal_ID string, Lead_ID string, Deal_Stage string, Amount decimal(18,2), "
                                       "Margin decimal(18,4), Closing_Date date, Forecast_Category string, "
                                       "Product_Category string")


def test_total_pipeline(deals):
    assert rows(agg.total_pipeline(deals)) == [(550000.0,)]


def test_trend_fills_missing_months_with_zero(deals):
    t = rows(trends.monthly_trend(deals), "Closing_Month", "Total_Amount")
    assert [m for m, _ in t] == ["Jun 2024", "Jul 2024", "Aug 2024", "Sep 2024", "Oct 2024", "Nov 2024"]
    assert dict(t)["Oct 2024"] == 0.0


def test_trend_pipeline_only(deals):
    t = rows(trends.monthly_trend(deals, forecast_category="Pipeline"), "Closing_Month", "Total_Amount")
    assert t == [("Aug 2024", 200000.0), ("Sep 2024", 0.0), ("Oct 2024", 0.0), ("Nov 2024", 350000.0)]


def test_trend_unparsable_dates_give_empty(spark):
    df = spark.createDataFrame([("not a date", D("1"))], "Closing_Date string, Amount decimal(18,2)")
    assert trends.monthly_trend(df).count() == 0


def test_weakest_forecast_quality_is_batteries(deals):
    top = agg.forecast_quality(deals).first()
    assert top["Product_Category"] == "Batteries"
    assert top["Weak_Forecast_Ratio"] == pytest.approx(1.0)


def test_conversion_columns_in_order(leads, deals):
    c = agg.lead_conversion(leads, deals)
    assert c.columns == ["Lead_Source", "Total_Leads", "Converted_Leads", "Estimated_Value",
                         "Avg_Estimated_Value", "Conversion_Rate"]
    got = {r["Lead_Source"]: (r["Total_Leads"], r["Converted_Leads"]) for r in c.collect()}
    assert got == {"Partner Channel": (2, 2), "Website Inquiry": (2, 2), "Referral": (1, 0)}


def test_open_pipeline_by_region_excludes_closed(spark):
    data = [("D001", "L001", D("100000"), "Pipeline", "Negotiation", "Dubai"),
            ("D002", "L002", D("200000"), "Commit", "PO Received", "Abu Dhabi"),
            ("D003", "L003", D("300000"), "Closed", "Closed Won", "Dubai"),
            ("D004", "L004", D("400000"), "At Risk", "Technical Discussion", "Saudi Arabia"),
            ("D005", "L005", D("500000"), "Best Case", "Closed Lost", "Oman")]
    deals = spark.createDataFrame(data, "Deal_ID string, Lead_ID string, Amount decimal(18,2), "
                                        "Forecast_Category string, Deal_Stage string, Region string")
    empty_leads = spark.createDataFrame([], "Lead_ID string")
    out = rows(agg.region_pipeline(empty_leads, deals), "Region", "Total_Amount")
    assert out == [("Saudi Arabia", 400000.0), ("Abu Dhabi", 200000.0), ("Dubai", 100000.0)]


def test_rep_performance_from_deal_owner_without_leads(spark):
    deals = spark.createDataFrame([("D001", "L001", "Aisha", D("100000")), ("D002", "L002", "Omar", D("250000"))],
                                  "Deal_ID string, Lead_ID string, Sales_Rep string, Amount decimal(18,2)")
    empty_leads = spark.createDataFrame([], "Lead_ID string")
    out = rows(agg.sales_rep_performance(empty_leads, deals), "Sales_Rep", "Total_Deal_Amount")
    assert out == [("Omar", 250000.0), ("Aisha", 100000.0)]


def test_rep_performance_missing_rep_is_empty(spark):
    deals = spark.createDataFrame([("D001", D("1000"))], "Deal_ID string, Amount decimal(18,2)")
    assert agg.sales_rep_performance(spark.createDataFrame([], "Lead_ID string"), deals).count() == 0


def test_fan_out_join_repeats_deals_for_duplicate_leads(spark):
    deals = spark.createDataFrame([("D1", "L1", D("10"))], "Deal_ID string, Lead_ID string, Amount decimal(18,2)")
    leads = spark.createDataFrame([("L1", "A"), ("L1", "B")], "Lead_ID string, Sales_Rep string")
    assert joins.with_lead_dimension(deals, leads, "Sales_Rep").count() == 2
    assert joins.with_lookup(deals, leads, "Lead_ID", ["Sales_Rep"]).count() == 1


def test_share_and_limit(leads, deals):
    src = Sources(deals=deals, leads=leads)
    full = build_metric(src, "revenue", "Region", share=True, full_distribution=True)
    assert "Share_Percentage" in full.columns and full.count() >= 3
    assert sum(r["Share_Percentage"] for r in full.collect()) == pytest.approx(100.0)
    top = build_metric(src, "revenue", "Region", limit=1)
    assert top.count() == 1


def test_win_rate_by_dimension_only_closed_groups(leads, deals):
    src = Sources(deals=deals, leads=leads)
    wr = {r["Lead_Source"]: r["Win_Rate"] for r in build_metric(src, "win_rate", "Lead_Source").collect()}
    assert wr == {"Website Inquiry": pytest.approx(200 / 3)}


def test_invalid_dimension_rejected(leads, deals):
    with pytest.raises(ValueError):
        build_metric(Sources(deals=deals, leads=leads), "margin", "Deal_Stage")


def test_compound_ranking_columns_and_priority(leads, deals):
    d = joins.with_lookup(deals, leads, "Lead_ID", ["Customer_Type"])
    r = ranking.compound_ranking(d, "Customer_Type")
    assert {"Customer_Type", "Total_Revenue", "Average_Deal_Size", "Deal_Count", "Priority_Rank"} <= set(r.columns)
    assert ranking.priority_segment(r, "Customer_Type").first()["Customer_Type"] == "EPC"


def test_coverage_matched_and_unmatched(spark):
    left = spark.createDataFrame([("L1",), ("L2",), (None,)], "Lead_ID string")
    right = spark.createDataFrame([("L1",), ("L2",)], "Lead_ID string")
    c = joins.coverage(left, [(0, right, "Lead_ID")]).first()
    assert (c["rows_checked"], c["matched_rows"], c["rows_checked"] - c["matched_rows"]) == (2, 2, 0)
    orphan = spark.createDataFrame([("L1",), ("L9",)], "Lead_ID string")
    c = joins.coverage(orphan, [(0, right, "Lead_ID")]).first()
    assert (c["rows_checked"], c["matched_rows"], c["rows_checked"] - c["matched_rows"]) == (2, 1, 1)
    dup = spark.createDataFrame([("L1",), ("L1",)], "Lead_ID string")
    assert joins.coverage(left, [(0, dup, "Lead_ID")]).first()["lookup_has_duplicates"] is True
