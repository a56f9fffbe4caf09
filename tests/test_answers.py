"""Structured answer contexts by kind of result."""

from pyspark.sql import functions as F

from revlens.operators import answers as A


def told(spark, r):
    rows = A.context_rows(spark, r).collect()
    part = lambda p: [(x.Position, x.Field, x.Value) for x in sorted((y for y in rows if y.Part == p), key=lambda y: y.Position)]
    return {f: v for _, f, v in part("context")}, part("preview"), [v for _, _, v in part("observation")], [v for _, _, v in part("limitation")]


def months(spark, n):
    return spark.createDataFrame([(f"2024-0{m}-01", f"M{m}", float(m * 1000 % 7000)) for m in range(1, n + 1)], "Period_Start string, Closing_Month string, Total_Amount double")


def test_monthly_trend_has_its_peak(spark):
    context, preview, notes, limits = told(spark, A.Result("Monthly Pipeline Trend (AED)", "?", months(spark, 8), (F.col("Period_Start").asc(),), answer="text"))
    assert context["metric_type"] == "monthly_pipeline_trend" and context["time_period"] == "monthly" and context["chart_type"] == "line_chart"
    assert context["main_value"] == "M6 at AED 6,000" and notes[-1] == "Highest month is M6." and not limits
    assert [v for _, f, v in preview if f == "Closing_Month"] == ["M1", "M2", "M3", "M4", "M5"]
    assert (context["x_axis"], context["y_axis"]) == ("Closing Month", "Total Amount (AED)")


def test_empty_data_keeps_the_answer_and_says_so(spark):
    context, preview, notes, limits = told(spark, A.Result("Monthly pipeline trend", "?", months(spark, 0), (F.col("Period_Start").asc(),), answer="none"))
    assert context["main_value"] == "none" and not preview and limits == [A.NO_PREVIEW] and len(notes) == 2
    context, preview, notes, limits = told(spark, A.Result("Total Pipeline Value", "?", answer="AED 5", answer_type="metric"))
    assert context["chart_type"] == "no_chart" and limits == [A.NO_PREVIEW] and notes == ["Pipeline totals come from the Amount column."]


def test_kinds_by_title_source_key_and_column(spark):
    d = spark.createDataFrame([("a", 1)], "Deal_Stage string, Deal_Count int")
    other = spark.createDataFrame([("a", 1)], "Region string, Value int")
    of = lambda *a, **k: A.kind_of(A.Result(*a, **k)).metric_type
    assert of("x", "?", chart_key="monthly_pipeline_trend") == "monthly_pipeline_trend"
    assert of("Forecast Quality by Stage", "?", d) == "forecast_quality"  # the first rule that fits
    assert of("x", "?", other, source="lead conversion analysis") == "lead_source_conversion"
    assert of("Conversion by lead source", "?") == "lead_source_conversion" and of("Lead source count", "?", other) == "general_revenue_insight"
    assert of("x", "?", d) == "deal_stage_breakdown" and of("Top sales rep", "?", other) == "sales_rep_performance"


def test_general_results_show_no_ids_or_companies(spark):
    d = spark.createDataFrame([(i, f"c{i}", "N", i * 1.5, i, "x", "y", "z") for i in range(9)],
                              "Deal_ID int, Company_Name string, Region string, Total_Amount double, Deal_Count int, a string, b string, c string")
    context, preview, notes, limits = told(spark, A.Result("Deals", "?", d, (F.col("Total_Amount").desc(), F.col("Deal_ID").asc()), answer_type="dynamic_chart", chart_type="bar"))
    assert {f for _, f, _ in preview} == {"Region", "Total_Amount", "Deal_Count", "a", "b"} and len(preview) == 25
    assert (1, "Total_Amount", "12.0000") in preview and (5, "Deal_Count", "4") in preview
    assert (context["x_axis"], context["y_axis"], context["chart_type"], context["main_entity"]) == ("Region", "Total Amount", "bar", "Deals")
    assert not notes and not limits


def test_axes_of_a_chart_without_rows(spark):
    d = months(spark, 0).select("Closing_Month", "Total_Amount")
    context, *_ = told(spark, A.Result("x", "?", d, answer_type="dynamic_chart", chart_type="line", axes=("Closing_Month", "Sum_Of")))
    assert (context["x_axis"], context["y_axis"]) == ("Closing Month", "Sum Of")
    context, *_ = told(spark, A.Result("x", "?", answer_type="chart", chart_type="bar"))
    assert (context["x_axis"], context["y_axis"]) == (None, "Value")
