"""Chart spec, chart data, preview and label queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from revlens.functions.columns import day_label, format_compact, month_key, month_label
from revlens.operators import aggregates as agg
from revlens.operators import answers, charts, joins, trends
from revlens.plans.metrics import Sources, build_metric
from revlens.plans.registry import Modules, register
from revlens.plans.queries_text import _user_turns

# Example questions from the reference's supported dynamic charts; their
# specs come from ``charts.spec_for_question`` (K4) at run time.
PIPELINE_BY_REP = "Show pipeline by sales rep"
MONTHLY_PIPELINE = "Show monthly pipeline by closing date"
LEADS_BY_SOURCE = "Plot leads by source"


def _chart(spark, sf_dir, question):
    m = Modules(spark, sf_dir)
    spec = charts.spec_for_question(spark, question)
    return spec, charts.chart_data(spec, m.leads, m.deals)


@register("chart_specs")
def q_chart_specs(spark, sf_dir):
    u = _user_turns(spark, sf_dir)
    return charts.with_chart_spec(u).select("conv_id", "turn", "chart_spec.*")


@register("chart_data_pipeline_by_rep")
def q_chart_data_pipeline_by_rep(spark, sf_dir):
    return _chart(spark, sf_dir, PIPELINE_BY_REP)[1]


@register("chart_data_monthly_pipeline")
def q_chart_data_monthly_pipeline(spark, sf_dir):
    return _chart(spark, sf_dir, MONTHLY_PIPELINE)[1]


@register("chart_data_leads_by_source")
def q_chart_data_leads_by_source(spark, sf_dir):
    return _chart(spark, sf_dir, LEADS_BY_SOURCE)[1]


@register("chart_explanation")
def q_chart_explanation(spark, sf_dir):
    spec, data = _chart(spark, sf_dir, PIPELINE_BY_REP)
    return charts.chart_explanation(spec, data)


@register("chart_explanation_monthly")
def q_chart_explanation_monthly(spark, sf_dir):
    spec, data = _chart(spark, sf_dir, MONTHLY_PIPELINE)
    return charts.chart_explanation(spec, data)


@register("safe_preview")
def q_safe_preview(spark, sf_dir):
    p = charts.safe_preview(Modules(spark, sf_dir).deals)
    # plain output types: money as double, dates as ISO text
    return p.select(*[F.col(c).cast("double").alias(c) if t.startswith("decimal")
                      else F.date_format(c, "yyyy-MM-dd").alias(c) if t == "date" else F.col(c)
                      for c, t in p.dtypes])


@register("date_labels")
def q_date_labels(spark, sf_dir):
    d = Modules(spark, sf_dir).deals
    return d.select("Deal_ID", month_label("Closing_Date").alias("Month_Label"),
                    month_key("Closing_Date").alias("Month_Key"), day_label("Closing_Date").alias("Day_Label"))


@register("answer_rows")
def q_answer_rows(spark, sf_dir):
    """The structured context of an answer of each kind, and of one without rows."""
    m = Modules(spark, sf_dir)
    leads, deals = m.leads, m.deals
    src = Sources(deals=deals, leads=leads, accounts=m.accounts, products=m.products)
    with_category = joins.with_lookup(deals, src.products, "Product_ID", ["Product_Category"])
    desc, asc = lambda c: F.col(c).desc_nulls_last(), lambda c: F.col(c).asc()
    results = [
        answers.Result("Monthly Pipeline Trend", "How does the pipeline develop?", trends.monthly_trend(deals, forecast_category="Pipeline"), (asc("Period_Start"),),
                       answer="The pipeline by closing month.", action="Review months without deals.", answer_type="chart", chart_key="monthly_pipeline_trend"),
        answers.Result("Weak Forecasts", "Which category has the weakest forecast?", agg.forecast_quality(with_category),
                       (desc("Weak_Forecast_Ratio"), desc("Weak_Forecast_Amount"), asc("Product_Category")), "forecast quality analysis", "Categories by weak share."),
        answers.Result("Lead Source Conversion", "Which sources convert?", agg.lead_conversion(leads, deals),
                       (desc("Estimated_Value"), asc("Conversion_Rate"), asc("Lead_Source")), answer="Sources by value."),
        answers.Result("Where Deals Are", "Where are the deals?", agg.deals_by_stage(deals), (desc("Total_Amount"), asc("Deal_Stage")), answer_type="chart", chart_type="bar"),
        answers.Result("Sales Rep Performance", "Who sells most?", agg.sales_rep_performance(leads, deals),
                       (desc("Total_Deal_Amount"), desc("Total_Estimated_Value"), asc("Sales_Rep"))),
        answers.Result("Total Pipeline Value", "How large is the pipeline?", answer=agg.total_pipeline(deals).select(format_compact("Total_Pipeline_Amount")), answer_type="metric"),
        answers.Result("Revenue by Region", "What is revenue by region?", build_metric(src, "revenue", "Region"), (desc("Total_Amount"), asc("Region")), answer_type="dynamic_chart",
                       chart_type="bar", axes=("Region", "Total_Amount")),
        answers.Result("Sources below Average", "Which sources are below average?", agg.lead_conversion(leads, deals).where(F.col("Conversion_Rate") < 0).drop("Lead_ID"),
                       (asc("Lead_Source"),), answer="None.", answer_type="dynamic_chart", chart_type="line", axes=("Lead_Source", "Conversion_Rate")),
    ]
    return answers.answer_rows(spark, results)
