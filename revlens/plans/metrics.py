"""Metric x dimension layer (section L, D21, E3, F2).

``build_metric`` composes a lazy DataFrame for one metric over one
dimension: resolve the dataset (joins where the dimension lives outside
Deals), apply filters, aggregate, optionally add the share of total, order
and limit. The dimension must be one of the metric's valid dimensions.

Dataset resolution, in order:

1. Account dimensions (Account_Name, Customer_Type, Region) absent from Deals
   come from Accounts through Account_ID, key-deduplicated (C4), when
   Accounts is given and has the column.
2. Product dimensions (Product_Name, Product_Category) come from Products
   through Product_ID, key-deduplicated (C4).
3. A column already on Deals is used as is.
4. Region, Sales_Rep and Lead_Source come from Leads through Lead_ID, with
   fan-out (C3).
5. Customer_Type comes from Leads through Lead_ID, key-deduplicated (C5).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.operators import aggregates as agg
from revlens.operators import guards, joins
from revlens.plans.distributed import share_of_total
from revlens.plans.semantic import ACCOUNT_DIMENSIONS, LEAD_DIMENSIONS, METRICS, PRODUCT_DIMENSIONS

GROUPED_METRICS = ("revenue", "pipeline", "deal_count", "average_deal_size", "margin", "win_rate")
ADDITIVE_METRICS = ("revenue", "pipeline", "deal_count", "margin")


@dataclass
class Sources:
    deals: DataFrame
    leads: DataFrame | None = None
    accounts: DataFrame | None = None
    products: DataFrame | None = None


def resolve_dataset(src: Sources, dimension: str) -> tuple[DataFrame | None, list[str]]:
    deals = src.deals
    if (dimension in ACCOUNT_DIMENSIONS and dimension not in deals.columns
            and src.accounts is not None and dimension in src.accounts.columns):
        miss = guards.missing(deals, ["Account_ID"]) + guards.missing(src.accounts, ["Account_ID"])
        if miss:
            return None, sorted(set(miss))
        return joins.with_lookup(deals, src.accounts, "Account_ID", [dimension]), []
    if (dimension in PRODUCT_DIMENSIONS and dimension not in deals.columns
            and src.products is not None and dimension in src.products.columns):
        miss = guards.missing(deals, ["Product_ID"]) + guards.missing(src.products, ["Product_ID"])
        if miss:
            return None, sorted(set(miss))
        return joins.with_lookup(deals, src.products, "Product_ID", [dimension]), []
    if dimension in deals.columns:
        return deals, []
    if src.leads is not None and dimension in src.leads.columns and "Lead_ID" in deals.columns:
        if dimension in LEAD_DIMENSIONS:
            return joins.with_lead_dimension(deals, src.leads, dimension), []
        if dimension == "Customer_Type":
            return joins.with_lookup(deals, src.leads, "Lead_ID", [dimension]), []
    return None, [dimension]


def build_metric(src: Sources, metric: str, dimension: str, filters: dict | None = None,
                 order: str = "desc", limit: int | None = None, share: bool = False,
                 full_distribution: bool = False, pipeline_only: bool = False) -> DataFrame:
    """One grouped metric table: ``[dimension, <value column>, (Share_Percentage)]``."""
    spec = METRICS[metric]
    if metric not in GROUPED_METRICS:
        raise ValueError(f"{metric} is not a grouped metric")
    if dimension not in spec.valid_dimensions:
        raise ValueError(f"{dimension} is not a valid dimension of {metric}")
    spark = src.deals.sparkSession
    out = spec.output
    dataset, miss = resolve_dataset(src, dimension)
    if dataset is None:
        return guards.empty(spark, f"`{dimension}` string, `{out}` double")
    if pipeline_only and "Forecast_Category" in dataset.columns:
        dataset = dataset.where(F.col("Forecast_Category") == "Pipeline")
    if filters:
        dataset = agg.filter_ci(dataset, filters)
    if metric == "revenue":
        table = agg.group_sum(dataset, "Amount", dimension, out)
    elif metric == "pipeline":
        if dimension != "Forecast_Category" and "Forecast_Category" in dataset.columns:
            dataset = dataset.where(F.col("Forecast_Category") == "Pipeline")
        table = agg.group_sum(dataset, "Amount", dimension, out)
    elif metric == "average_deal_size":
        table = agg.group_average(dataset, "Amount", dimension, out)
    elif metric == "deal_count":
        table = agg.group_count(dataset, "Deal_ID", dimension, out)
    elif metric == "margin":
        table = agg.group_sum(dataset, "Margin", dimension, out)
    else:  # win_rate
        table = agg.win_rate(dataset, dimension)
    if share and metric in ADDITIVE_METRICS:
        table = share_of_total(table, out)
    value = F.col(out)
    ordering = [value.asc_nulls_last() if order == "asc" else value.desc_nulls_last(), F.col(dimension).asc()]
    table = table.orderBy(*ordering)
    if limit and not full_distribution:
        table = table.limit(limit)
    return table


def metric_keys() -> list[tuple[str, str, str]]:
    """(query key, metric, dimension) for every supported grouped pair."""
    out = []
    for metric in GROUPED_METRICS:
        for dim in METRICS[metric].valid_dimensions:
            out.append((f"metric_{metric}_by_{dim.lower()}", metric, dim))
    return out
