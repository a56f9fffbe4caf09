"""KPIs and group-by tables.

Every aggregate is a ``groupBy().agg()`` of algebraic functions (sum, count,
min, max_by), so Spark plans a partial (map-side) aggregate before the
shuffle: a dimension value that holds a third of all rows costs one partial
row per map task, not a hot reducer. The one distinct count (leads per
source in ``lead_conversion``) uses Spark's two-level rewrite, first
grouping by (source, lead id). Conditional sums are ``sum(when(...))`` in the
same pass.
Grouped results carry a total order (value, then the dimension ascending) so
any ``limit`` after them is deterministic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.functions.columns import count_where, in_set, money_mean, money_sum, safe_ratio
from revlens.operators import guards
from revlens.operators.joins import conversion_flag, has_values, with_lead_dimension
from revlens.plans.semantic import (CLOSED_STAGES, OPEN_FORECAST_CATEGORIES, OPEN_STAGES,
                                    STRONG_FORECAST_CATEGORIES, WEAK_FORECAST_CATEGORIES)


def _spark(df: DataFrame):
    return df.sparkSession


def _one_row_join(a: DataFrame, b: DataFrame) -> DataFrame:
    """Join two single-row aggregates (constant key, broadcast: size is one row)."""
    return (a.withColumn("__k", F.lit(1))
            .join(F.broadcast(b.withColumn("__k", F.lit(1))), "__k").drop("__k"))


# --------------------------------------------------------------------- filters
def open_pipeline_condition(df: DataFrame) -> Column | None:
    """B1: (open forecast OR open stage) AND NOT closed stage; None if neither column."""
    has_f = "Forecast_Category" in df.columns
    has_s = "Deal_Stage" in df.columns
    if not (has_f or has_s):
        return None
    fmask = in_set("Forecast_Category", OPEN_FORECAST_CATEGORIES) if has_f else F.lit(False)
    smask = in_set("Deal_Stage", OPEN_STAGES) if has_s else F.lit(False)
    closed = in_set("Deal_Stage", CLOSED_STAGES) if has_s else F.lit(False)
    return (fmask | smask) & ~closed


def open_pipeline(deals: DataFrame) -> DataFrame:
    """B1: open (active) pipeline deals; empty when Amount or both flag columns are missing."""
    cond = open_pipeline_condition(deals)
    if cond is None or "Amount" not in deals.columns:
        return deals.limit(0)
    return deals.where(cond)


def forecast_filter(deals: DataFrame, category: str) -> DataFrame:
    """B2: deals of one forecast category."""
    if "Forecast_Category" not in deals.columns:
        return deals.limit(0)
    return deals.where(F.col("Forecast_Category") == F.lit(category))


def stage_filter(deals: DataFrame, stage: str) -> DataFrame:
    """Deals of one stage."""
    if "Deal_Stage" not in deals.columns:
        return deals.limit(0)
    return deals.where(F.col("Deal_Stage") == F.lit(stage))


def filter_ci(df: DataFrame, filters: dict[str, str]) -> DataFrame:
    """Case-insensitive equality on each (column, value); missing column raises."""
    for column, value in filters.items():
        if column not in df.columns:
            raise KeyError(f"filter column {column!r} is missing")
        df = df.where(F.lower(F.col(column).cast("string")) == F.lit(str(value).lower()))
    return df


def filter_exact(df: DataFrame, filters: dict[str, object]) -> DataFrame:
    """Exact equality on each (column, value) present in the frame."""
    for column, value in filters.items():
        if column in df.columns:
            df = df.where(F.col(column) == F.lit(value))
    return df


# ------------------------------------------------------------------------ KPIs
def kpi_totals(leads: DataFrame, deals: DataFrame) -> DataFrame:
    """Total leads, total deals, total estimated value, total deal amount."""
    lv = money_sum("Estimated_Value") if "Estimated_Value" in leads.columns else F.lit(0.0)
    da = money_sum("Amount") if "Amount" in deals.columns else F.lit(0.0)
    lagg = leads.agg(F.count(F.lit(1)).alias("Total_Leads"), lv.alias("Total_Estimated_Value"))
    dagg = deals.agg(F.count(F.lit(1)).alias("Total_Deals"), da.alias("Total_Deal_Amount"))
    return _one_row_join(lagg, dagg).select("Total_Leads", "Total_Deals",
                                            "Total_Estimated_Value", "Total_Deal_Amount")


def kpi_forecast_stage(deals: DataFrame) -> DataFrame:
    """D3/D4/D5/D6 in one pass over Deals: sums by the KPI categories, counts,
    average deal size and win rate (null when nothing is closed)."""
    fc = F.col("Forecast_Category") if "Forecast_Category" in deals.columns else F.lit(None).cast("string")
    st = F.col("Deal_Stage") if "Deal_Stage" in deals.columns else F.lit(None).cast("string")
    amt = "Amount"
    won = count_where(st == "Closed Won")
    lost = count_where(st == "Closed Lost")
    return deals.agg(
        F.count(F.lit(1)).alias("Total_Deals"),
        money_sum(amt, fc == "Pipeline").alias("Pipeline_Amount"),
        count_where(fc == "Pipeline").alias("Pipeline_Deals"),
        money_sum(amt, fc == "Commit").alias("Commit_Amount"),
        money_sum(amt, fc == "At Risk").alias("At_Risk_Amount"),
        money_sum(amt, st == "Closed Won").alias("Closed_Won_Amount"),
        won.alias("Closed_Won"),
        lost.alias("Closed_Lost"),
        money_mean(amt).alias("Average_Deal_Size"),
        (F.try_divide(won.cast("double"), (won + lost).cast("double")) * F.lit(100.0)).alias("Win_Rate"),
    )


def total_pipeline(deals: DataFrame) -> DataFrame:
    """D3: total amount of deals in the Pipeline forecast category (0 if none)."""
    if guards.missing(deals, ["Forecast_Category", "Amount"]):
        return _spark(deals).createDataFrame([(0.0,)], "Total_Pipeline_Amount double")
    return deals.agg(money_sum("Amount", F.col("Forecast_Category") == "Pipeline")
                     .alias("Total_Pipeline_Amount"))


def avg_deal_size(deals: DataFrame) -> DataFrame:
    """Mean deal amount (nulls skipped) and the number of deals."""
    if guards.missing(deals, ["Amount"]):
        return guards.empty(_spark(deals), "Average_Deal_Size double, Deal_Count bigint")
    return deals.agg(money_mean("Amount").alias("Average_Deal_Size"),
                     F.count(F.lit(1)).alias("Deal_Count"))


# -------------------------------------------------------------- generic groups
def _grouped(df: DataFrame, dim: str, aggs: list[Column], order: list[Column]) -> DataFrame:
    return (df.where(F.col(dim).isNotNull()).groupBy(dim).agg(*aggs)
            .orderBy(*order, F.col(dim).asc()))


def group_sum(df: DataFrame, value: str, dim: str, out: str = "Value") -> DataFrame:
    """Sum of ``value`` per non-null ``dim``, largest first."""
    if guards.missing(df, [value, dim]):
        return guards.empty(_spark(df), f"`{dim}` string, `{out}` double")
    return _grouped(df, dim, [money_sum(value).alias(out)], [F.col(out).desc()])


def group_average(df: DataFrame, value: str, dim: str, out: str = "Value") -> DataFrame:
    """Mean of ``value`` per non-null ``dim`` (nulls skipped), largest first."""
    if guards.missing(df, [value, dim]):
        return guards.empty(_spark(df), f"`{dim}` string, `{out}` double")
    return _grouped(df, dim, [money_mean(value).alias(out)], [F.col(out).desc_nulls_last()])


def group_count(df: DataFrame, id_col: str, dim: str, out: str = "Value") -> DataFrame:
    """Non-null ``id_col`` count per non-null ``dim``, largest first."""
    if guards.missing(df, [id_col, dim]):
        return guards.empty(_spark(df), f"`{dim}` string, `{out}` bigint")
    return _grouped(df, dim, [F.count(F.col(id_col)).alias(out)], [F.col(out).desc()])


def _count_and_sum(df: DataFrame, dim: str, id_col: str, value: str,
                   count_name: str, sum_name: str, order_by: str) -> DataFrame:
    return _grouped(df, dim, [F.count(F.col(id_col)).alias(count_name),
                              money_sum(value).alias(sum_name)], [F.col(order_by).desc()])


def leads_by_source(leads: DataFrame) -> DataFrame:
    """Leads per source: count of Lead_ID, total estimated value; by count."""
    if guards.missing(leads, ["Lead_Source", "Lead_ID", "Estimated_Value"]):
        return guards.empty(_spark(leads), "Lead_Source string, Lead_Count bigint, Total_Estimated_Value double")
    return _count_and_sum(leads, "Lead_Source", "Lead_ID", "Estimated_Value",
                          "Lead_Count", "Total_Estimated_Value", "Lead_Count")


def deals_by_stage(deals: DataFrame) -> DataFrame:
    """Deals per stage: count of Deal_ID, total amount; by amount."""
    if guards.missing(deals, ["Deal_Stage", "Deal_ID", "Amount"]):
        return guards.empty(_spark(deals), "Deal_Stage string, Deal_Count bigint, Total_Amount double")
    return _count_and_sum(deals, "Deal_Stage", "Deal_ID", "Amount", "Deal_Count", "Total_Amount",
                          "Total_Amount")


def forecast_summary(deals: DataFrame) -> DataFrame:
    """Deals per forecast category: count, total amount; by amount."""
    if guards.missing(deals, ["Forecast_Category", "Deal_ID", "Amount"]):
        return guards.empty(_spark(deals), "Forecast_Category string, Deal_Count bigint, Total_Amount double")
    return _count_and_sum(deals, "Forecast_Category", "Deal_ID", "Amount", "Deal_Count",
                          "Total_Amount", "Total_Amount")


def product_category_revenue(deals: DataFrame) -> DataFrame:
    """Deals per product category: count, total amount; by amount."""
    if guards.missing(deals, ["Product_Category", "Deal_ID", "Amount"]):
        return guards.empty(_spark(deals), "Product_Category string, Deal_Count bigint, Total_Amount double")
    return _count_and_sum(deals, "Product_Category", "Deal_ID", "Amount", "Deal_Count",
                          "Total_Amount", "Total_Amount")


def region_pipeline(leads: DataFrame, deals: DataFrame) -> DataFrame:
    """Open pipeline (B1) by region; Region from Deals, else from Leads."""
    schema = "Region string, Deal_Count bigint, Total_Amount double"
    if guards.missing(deals, ["Deal_ID", "Amount"]):
        return guards.empty(_spark(deals), schema)
    open_deals = open_pipeline(deals)
    if "Region" not in open_deals.columns:
        if not {"Region", "Lead_ID"} <= set(leads.columns) or "Lead_ID" not in deals.columns:
            return guards.empty(_spark(deals), schema)
        open_deals = open_deals.join(leads.select("Lead_ID", "Region"), "Lead_ID", "left")
    return _count_and_sum(open_deals, "Region", "Deal_ID", "Amount", "Deal_Count", "Total_Amount",
                          "Total_Amount")


def sales_rep_performance(leads: DataFrame, deals: DataFrame) -> DataFrame:
    """Lead summary and deal summary by rep, full outer join, missing -> 0.

    The deal side takes Sales_Rep from Deals when it has values, else from
    Leads through Lead_ID (fan-out join C1). Both summaries are aggregates
    partitioned on Sales_Rep, so the full join adds no further shuffle.
    """
    spark = _spark(deals)
    lead_ok = not guards.missing(leads, ["Sales_Rep", "Lead_ID", "Estimated_Value"])
    deal_src = None
    if not guards.missing(deals, ["Deal_ID", "Amount"]):
        if has_values(deals, "Sales_Rep"):
            deal_src = deals
        elif "Lead_ID" in deals.columns and {"Lead_ID", "Sales_Rep"} <= set(leads.columns):
            deal_src = with_lead_dimension(deals, leads, "Sales_Rep")
    schema = ("Sales_Rep string, Lead_Count bigint, Total_Estimated_Value double, "
              "Deal_Count bigint, Total_Deal_Amount double")
    if not lead_ok and deal_src is None:
        return guards.empty(spark, schema)
    parts = []
    if lead_ok:
        parts.append(leads.where(F.col("Sales_Rep").isNotNull()).groupBy("Sales_Rep").agg(
            F.count("Lead_ID").alias("Lead_Count"),
            money_sum("Estimated_Value").alias("Total_Estimated_Value")))
    if deal_src is not None:
        parts.append(deal_src.where(F.col("Sales_Rep").isNotNull()).groupBy("Sales_Rep").agg(
            F.count("Deal_ID").alias("Deal_Count"),
            money_sum("Amount").alias("Total_Deal_Amount")))
    perf = parts[0] if len(parts) == 1 else parts[0].join(parts[1], "Sales_Rep", "full")
    for c, zero in (("Lead_Count", F.lit(0).cast("bigint")), ("Total_Estimated_Value", F.lit(0.0)),
                    ("Deal_Count", F.lit(0).cast("bigint")), ("Total_Deal_Amount", F.lit(0.0))):
        perf = perf.withColumn(c, F.coalesce(F.col(c), zero) if c in perf.columns else zero)
    return perf.select("Sales_Rep", "Lead_Count", "Total_Estimated_Value", "Deal_Count",
                       "Total_Deal_Amount").orderBy(F.col("Total_Deal_Amount").desc(),
                                                    F.col("Total_Estimated_Value").desc(),
                                                    F.col("Sales_Rep").asc())


def win_rate(deals: DataFrame, dim: str | None = None) -> DataFrame:
    """Won, lost and win rate (won / (won + lost) * 100).

    Only closed deals count; with a dimension, only groups with at least one
    closed deal appear (null dimension dropped). Empty if nothing is closed.
    """
    spark = _spark(deals)
    if guards.missing(deals, ["Deal_Stage"] + ([dim] if dim else [])):
        ddl = (f"`{dim}` string, " if dim else "") + "Closed_Won bigint, Closed_Lost bigint, Win_Rate double"
        return guards.empty(spark, ddl)
    closed = deals.where(in_set("Deal_Stage", CLOSED_STAGES))
    won = count_where(F.col("Deal_Stage") == "Closed Won")
    lost = count_where(F.col("Deal_Stage") == "Closed Lost")
    rate = safe_ratio(F.col("Closed_Won"), F.col("Closed_Won") + F.col("Closed_Lost")) * F.lit(100.0)
    if dim:
        out = closed.where(F.col(dim).isNotNull()).groupBy(dim).agg(
            won.alias("Closed_Won"), lost.alias("Closed_Lost"))
        return out.withColumn("Win_Rate", rate).orderBy(F.col("Win_Rate").desc(), F.col(dim).asc())
    out = closed.agg(won.alias("Closed_Won"), lost.alias("Closed_Lost"))
    # the reference returns no row when no deal is closed
    return out.where((F.col("Closed_Won") + F.col("Closed_Lost")) > 0).withColumn("Win_Rate", rate)


def forecast_quality(deals: DataFrame) -> DataFrame:
    """Per product category: total, weak and strong forecast amounts and
    weak ratio (0 when the total is 0); weakest first."""
    schema = ("Product_Category string, Total_Amount double, Weak_Forecast_Amount double, "
              "Strong_Forecast_Amount double, Weak_Forecast_Ratio double")
    if guards.missing(deals, ["Product_Category", "Forecast_Category", "Amount"]):
        return guards.empty(_spark(deals), schema)
    g = deals.where(F.col("Product_Category").isNotNull()).groupBy("Product_Category").agg(
        money_sum("Amount").alias("Total_Amount"),
        money_sum("Amount", in_set("Forecast_Category", WEAK_FORECAST_CATEGORIES)).alias("Weak_Forecast_Amount"),
        money_sum("Amount", in_set("Forecast_Category", STRONG_FORECAST_CATEGORIES)).alias("Strong_Forecast_Amount"),
    )
    return (g.withColumn("Weak_Forecast_Ratio", safe_ratio(F.col("Weak_Forecast_Amount"), F.col("Total_Amount")))
            .orderBy(F.col("Weak_Forecast_Ratio").desc(), F.col("Weak_Forecast_Amount").desc(),
                     F.col("Product_Category").asc()))


def lead_conversion(leads: DataFrame, deals: DataFrame) -> DataFrame:
    """Per lead source: distinct leads, converted rows (lead ids found in
    Deals), total and mean estimated value, conversion rate.

    Converted counts rows and Total_Leads counts distinct ids, as the
    reference does, so the rate may exceed 1 with duplicated leads.
    """
    schema = ("Lead_Source string, Total_Leads bigint, Converted_Leads bigint, Estimated_Value double, "
              "Avg_Estimated_Value double, Conversion_Rate double")
    if guards.missing(leads, ["Lead_ID", "Lead_Source", "Estimated_Value"]) or guards.missing(deals, ["Lead_ID"]):
        return guards.empty(_spark(leads), schema)
    flagged = conversion_flag(leads.select("Lead_ID", "Lead_Source", "Estimated_Value"), deals)
    g = flagged.where(F.col("Lead_Source").isNotNull()).groupBy("Lead_Source").agg(
        F.count_distinct("Lead_ID").alias("Total_Leads"),
        F.count_if(F.col("Converted")).alias("Converted_Leads"),
        money_sum("Estimated_Value").alias("Estimated_Value"),
        money_mean("Estimated_Value").alias("Avg_Estimated_Value"),
    )
    return (g.withColumn("Conversion_Rate", safe_ratio(F.col("Converted_Leads"), F.col("Total_Leads")))
            .select("Lead_Source", "Total_Leads", "Converted_Leads", "Estimated_Value",
                    "Avg_Estimated_Value", "Conversion_Rate")
            .orderBy(F.col("Estimated_Value").desc(), F.col("Conversion_Rate").asc(),
                     F.col("Lead_Source").asc()))


def below_average_conversion(conversion: DataFrame) -> DataFrame:
    """Lead sources whose rate is below the unweighted mean rate of all sources.

    The mean is a one-row aggregate of the (per-source) table joined back on a
    constant key; no un-partitioned window.
    """
    mean = conversion.agg(F.avg("Conversion_Rate").alias("Average_Conversion_Rate"))
    j = _one_row_join(conversion, mean)
    return (j.where(F.col("Conversion_Rate") < F.col("Average_Conversion_Rate"))
            .orderBy(F.col("Estimated_Value").desc(), F.col("Conversion_Rate").asc(),
                     F.col("Lead_Source").asc()))


def compound_by(dataset: DataFrame, dim: str) -> DataFrame:
    """Total revenue, mean deal size and deal count per dimension in one pass."""
    return (dataset.where(F.col(dim).isNotNull()).groupBy(dim).agg(
        money_sum("Amount").alias("Total_Revenue"),
        money_mean("Amount").alias("Average_Deal_Size"),
        F.count("Deal_ID").alias("Deal_Count")))


def stage_by_region(deals_with_region: DataFrame) -> DataFrame:
    """M3: stacked breakdown: amount and count per (Region, Deal_Stage)."""
    d = deals_with_region.where(F.col("Region").isNotNull() & F.col("Deal_Stage").isNotNull())
    return (d.groupBy("Region", "Deal_Stage").agg(F.count("Deal_ID").alias("Deal_Count"),
                                                 money_sum("Amount").alias("Total_Amount"))
            .orderBy("Region", "Deal_Stage"))
