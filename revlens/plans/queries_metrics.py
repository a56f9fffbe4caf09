"""Trend, metric x dimension, ranking and top-k queries (sections D19-D26, E, F, L)."""

from __future__ import annotations

from revlens.operators import aggregates as agg
from revlens.operators import joins, ranking, trends
from revlens.plans.metrics import Sources, build_metric, metric_keys
from revlens.plans.registry import Modules, register


def _sources(m: Modules) -> Sources:
    return Sources(deals=m.deals, leads=m.leads, accounts=m.accounts, products=m.products)


@register("monthly_trend")
def q_monthly_trend(spark, sf_dir):
    return trends.monthly_trend(Modules(spark, sf_dir).deals)


@register("monthly_pipeline_trend")
def q_monthly_pipeline_trend(spark, sf_dir):
    return trends.monthly_trend(Modules(spark, sf_dir).deals, forecast_category="Pipeline")


@register("peak_month")
def q_peak_month(spark, sf_dir):
    return trends.peak_month(trends.monthly_trend(Modules(spark, sf_dir).deals, forecast_category="Pipeline"))


@register("chart_data_month")
def q_chart_data_month(spark, sf_dir):
    return trends.chart_data_month(Modules(spark, sf_dir).deals, "Closing_Date", "Amount", "sum")


@register("chart_data_category")
def q_chart_data_category(spark, sf_dir):
    return trends.chart_data_category(Modules(spark, sf_dir).deals, "Deal_Stage", "Amount", "mean")


def _metric_query(metric: str, dim: str):
    def fn(spark, sf_dir):
        return build_metric(_sources(Modules(spark, sf_dir)), metric, dim)
    fn.__doc__ = f"{metric} by {dim} (full distribution, largest first)."
    return fn


for _key, _metric, _dim in metric_keys():
    register(_key)(_metric_query(_metric, _dim))


@register("share_by_region")
def q_share_by_region(spark, sf_dir):
    return build_metric(_sources(Modules(spark, sf_dir)), "revenue", "Region", share=True,
                        full_distribution=True)


@register("composition_share")
def q_composition_share(spark, sf_dir):
    return build_metric(_sources(Modules(spark, sf_dir)), "deal_count", "Forecast_Category", share=True,
                        full_distribution=True)


@register("top_n_regions")
def q_top_n_regions(spark, sf_dir):
    return build_metric(_sources(Modules(spark, sf_dir)), "revenue", "Region", limit=3)


@register("bottom_n_categories")
def q_bottom_n_categories(spark, sf_dir):
    return build_metric(_sources(Modules(spark, sf_dir)), "revenue", "Product_Category", order="asc", limit=3)


@register("top_accounts_share")
def q_top_accounts_share(spark, sf_dir):
    return build_metric(_sources(Modules(spark, sf_dir)), "revenue", "Account_Name", share=True, limit=10)


@register("compound_customer_type")
def q_compound_customer_type(spark, sf_dir):
    m = Modules(spark, sf_dir)
    d = joins.with_lookup(m.deals, m.leads, "Lead_ID", ["Customer_Type"])
    return ranking.compound_ranking(d, "Customer_Type")


@register("compound_account")
def q_compound_account(spark, sf_dir):
    m = Modules(spark, sf_dir)
    d = joins.with_lookup(m.deals, m.accounts, "Account_ID", ["Account_Name"])
    return ranking.compound_ranking(d, "Account_Name")


@register("priority_segment")
def q_priority_segment(spark, sf_dir):
    m = Modules(spark, sf_dir)
    d = joins.with_lookup(m.deals, m.leads, "Lead_ID", ["Customer_Type"])
    return ranking.priority_segment(ranking.compound_ranking(d, "Customer_Type"), "Customer_Type")


@register("top_source")
def q_top_source(spark, sf_dir):
    return ranking.top_source(Modules(spark, sf_dir).leads)


@register("top_rep_pipeline")
def q_top_rep_pipeline(spark, sf_dir):
    m = Modules(spark, sf_dir)
    return ranking.top_rep_pipeline(m.leads, m.deals)


@register("top_product")
def q_top_product(spark, sf_dir):
    m = Modules(spark, sf_dir)
    return ranking.top_product(joins.with_lookup(m.deals, m.products, "Product_ID", ["Product_Category"]))


@register("top_region")
def q_top_region(spark, sf_dir):
    m = Modules(spark, sf_dir)
    return ranking.top_region(m.deals, m.leads)


@register("top_stage")
def q_top_stage(spark, sf_dir):
    return ranking.top_stage(Modules(spark, sf_dir).deals)


@register("top_at_risk_deals")
def q_top_at_risk_deals(spark, sf_dir):
    return ranking.top_deals(Modules(spark, sf_dir).deals, "At Risk", 10)


@register("top_commit_deals")
def q_top_commit_deals(spark, sf_dir):
    return ranking.top_deals(Modules(spark, sf_dir).deals, "Commit", 10)


@register("upcoming_closings")
def q_upcoming_closings(spark, sf_dir):
    return ranking.upcoming_closings(Modules(spark, sf_dir).deals, 10)


@register("margin_by_category_filtered")
def q_margin_by_category_filtered(spark, sf_dir):
    return build_metric(_sources(Modules(spark, sf_dir)), "margin", "Product_Category",
                        filters={"Deal_Stage": "closed won"})


@register("win_rate_by_lead_region")
def q_win_rate_by_lead_region(spark, sf_dir):
    m = Modules(spark, sf_dir)
    return agg.win_rate(joins.with_lead_dimension(m.deals, m.leads, "Region"), "Region")
