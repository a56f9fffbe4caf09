"""Core KPI, group-by, join and ratio queries (sections B, C, D of the survey)."""

from __future__ import annotations

from pyspark.sql import functions as F

from revlens.operators import aggregates as agg
from revlens.operators import joins
from revlens.plans.registry import Modules, register


@register("deals_by_stage")
def q_deals_by_stage(spark, sf_dir):
    return agg.deals_by_stage(Modules(spark, sf_dir).deals)


@register("leads_by_source")
def q_leads_by_source(spark, sf_dir):
    return agg.leads_by_source(Modules(spark, sf_dir).leads)


@register("forecast_summary")
def q_forecast_summary(spark, sf_dir):
    return agg.forecast_summary(Modules(spark, sf_dir).deals)


@register("product_category_revenue")
def q_product_category_revenue(spark, sf_dir):
    m = Modules(spark, sf_dir)
    d = joins.with_lookup(m.deals, m.products, "Product_ID", ["Product_Category"])
    return agg.product_category_revenue(d)


@register("region_pipeline")
def q_region_pipeline(spark, sf_dir):
    m = Modules(spark, sf_dir)
    return agg.region_pipeline(m.leads, m.deals)


@register("sales_rep_performance")
def q_sales_rep_performance(spark, sf_dir):
    m = Modules(spark, sf_dir)
    return agg.sales_rep_performance(m.leads, m.deals)


@register("kpi_totals")
def q_kpi_totals(spark, sf_dir):
    m = Modules(spark, sf_dir)
    return agg.kpi_totals(m.leads, m.deals)


@register("kpi_forecast_stage")
def q_kpi_forecast_stage(spark, sf_dir):
    return agg.kpi_forecast_stage(Modules(spark, sf_dir).deals)


@register("total_pipeline")
def q_total_pipeline(spark, sf_dir):
    return agg.total_pipeline(Modules(spark, sf_dir).deals)


@register("avg_deal_size")
def q_avg_deal_size(spark, sf_dir):
    return agg.avg_deal_size(Modules(spark, sf_dir).deals)


@register("win_rate_total")
def q_win_rate_total(spark, sf_dir):
    return agg.win_rate(Modules(spark, sf_dir).deals)


@register("open_pipeline")
def q_open_pipeline(spark, sf_dir):
    d = agg.open_pipeline(Modules(spark, sf_dir).deals)
    return d.select("Deal_ID", "Lead_ID", "Deal_Stage", "Forecast_Category",
                    F.col("Amount").cast("double").alias("Amount"))


@register("forecast_filter")
def q_forecast_filter(spark, sf_dir):
    d = agg.forecast_filter(Modules(spark, sf_dir).deals, "Commit")
    return d.select("Deal_ID", "Forecast_Category", F.col("Amount").cast("double").alias("Amount"))


@register("stage_filter")
def q_stage_filter(spark, sf_dir):
    d = agg.stage_filter(Modules(spark, sf_dir).deals, "Negotiation")
    return d.select("Deal_ID", "Deal_Stage", F.col("Amount").cast("double").alias("Amount"))


@register("filter_ci")
def q_filter_ci(spark, sf_dir):
    m = Modules(spark, sf_dir)
    d = joins.with_lead_dimension(m.deals, m.leads, "Region")
    d = agg.filter_ci(d, {"Region": "asia", "Forecast_Category": "best case"})
    return agg.group_sum(d, "Amount", "Deal_Stage", "Total_Amount")


@register("forecast_quality")
def q_forecast_quality(spark, sf_dir):
    m = Modules(spark, sf_dir)
    d = joins.with_lookup(m.deals, m.products, "Product_ID", ["Product_Category"])
    return agg.forecast_quality(d)


@register("lead_conversion")
def q_lead_conversion(spark, sf_dir):
    m = Modules(spark, sf_dir)
    return agg.lead_conversion(m.leads, m.deals)


@register("below_avg_conversion")
def q_below_avg_conversion(spark, sf_dir):
    m = Modules(spark, sf_dir)
    return agg.below_average_conversion(agg.lead_conversion(m.leads, m.deals))


@register("deals_with_rep")
def q_deals_with_rep(spark, sf_dir):
    m = Modules(spark, sf_dir)
    d = joins.with_lead_dimension(m.deals, m.leads, "Sales_Rep")
    return d.select("Deal_ID", "Lead_ID", "Sales_Rep")


@register("deals_with_region")
def q_deals_with_region(spark, sf_dir):
    m = Modules(spark, sf_dir)
    d = joins.with_lead_dimension(m.deals, m.leads, "Region")
    return d.select("Deal_ID", "Lead_ID", "Region")


@register("deals_with_dim")
def q_deals_with_dim(spark, sf_dir):
    m = Modules(spark, sf_dir)
    d = joins.with_lead_dimension(m.deals, m.leads, "Lead_Source")
    return agg.group_count(d, "Deal_ID", "Lead_Source", "Deal_Count")


@register("orphan_deals")
def q_orphan_deals(spark, sf_dir):
    m = Modules(spark, sf_dir)
    return joins.orphan_rows(m.deals, m.leads, "Lead_ID").select("Deal_ID", "Lead_ID")


@register("stage_by_region")
def q_stage_by_region(spark, sf_dir):
    m = Modules(spark, sf_dir)
    return agg.stage_by_region(joins.with_lead_dimension(m.deals, m.leads, "Region"))


@register("number_formats")
def q_number_formats(spark, sf_dir):
    """H1/H2/H5: compact, full and percent-of-total text of the stage totals."""
    from revlens.functions.columns import format_compact, format_full, format_percent
    from revlens.plans.distributed import share_of_total
    t = share_of_total(agg.deals_by_stage(Modules(spark, sf_dir).deals), "Total_Amount")
    return t.select("Deal_Stage", format_compact("Total_Amount").alias("Compact"),
                    format_full("Total_Amount").alias("Full"),
                    format_percent("Share_Percentage", 1).alias("Share_Text"))


@register("filter_exact")
def q_filter_exact(spark, sf_dir):
    """Exact-equality filter map (Pipeline deals in Negotiation)."""
    d = agg.filter_exact(Modules(spark, sf_dir).deals, {"Forecast_Category": "Pipeline", "Deal_Stage": "Negotiation"})
    return d.select("Deal_ID", "Forecast_Category", "Deal_Stage", F.col("Amount").cast("double").alias("Amount"))
