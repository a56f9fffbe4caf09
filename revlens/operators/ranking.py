"""Ranking, top-k and best-row operators.

Top-k is ``orderBy(...).limit(k)``, which Spark plans as
TakeOrderedAndProject: every task keeps its own k best rows and only those
reach the final merge. Every order ends in a unique column so the k rows are
deterministic. Dense ranks over a whole table use ``dense_ranks_by_key``
(no single-partition window).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.functions.columns import money_sum
from revlens.operators import aggregates as agg
from revlens.operators import guards, joins
from revlens.plans.distributed import dense_ranks_by_key


def top_n(df: DataFrame, value: str, key: str, n: int = 5) -> DataFrame:
    """n rows with the largest ``value`` (ties by ``key`` ascending)."""
    return df.orderBy(F.col(value).desc_nulls_last(), F.col(key).asc()).limit(n)


def bottom_n(df: DataFrame, value: str, key: str, n: int = 5) -> DataFrame:
    """n rows with the smallest ``value`` (ties by ``key`` ascending)."""
    return df.orderBy(F.col(value).asc_nulls_last(), F.col(key).asc()).limit(n)


def compound_ranking(dataset: DataFrame, dim: str) -> DataFrame:
    """D22 + E1 + E2: revenue, mean size and count per dimension, their dense
    ranks (largest = 1), the priority score (sum of the three ranks) and the
    priority rank (dense, smallest score = 1)."""
    spark = dataset.sparkSession
    if guards.missing(dataset, [dim, "Deal_ID", "Amount"]):
        return guards.empty(spark, f"`{dim}` string, Total_Revenue double, Average_Deal_Size double, "
                                   "Deal_Count bigint, Revenue_Rank bigint, Average_Deal_Size_Rank bigint, "
                                   "Deal_Count_Rank bigint, Priority_Score bigint, Priority_Rank bigint")
    g = agg.compound_by(dataset, dim)
    g = dense_ranks_by_key(g, dim, [("Total_Revenue", "Revenue_Rank", False), ("Average_Deal_Size", "Average_Deal_Size_Rank", False),
                                    ("Deal_Count", "Deal_Count_Rank", False)])
    g = g.withColumn("Priority_Score", F.col("Revenue_Rank") + F.col("Average_Deal_Size_Rank")
                     + F.col("Deal_Count_Rank"))
    g = dense_ranks_by_key(g, dim, [("Priority_Score", "Priority_Rank", True)])
    return g.select(dim, "Total_Revenue", "Average_Deal_Size", "Deal_Count", "Revenue_Rank",
                    "Average_Deal_Size_Rank", "Deal_Count_Rank", "Priority_Score", "Priority_Rank") \
        .orderBy(F.col("Total_Revenue").desc(), F.col(dim).asc())


def priority_segment(ranking: DataFrame, dim: str) -> DataFrame:
    """The winning segment: smallest priority score, then largest revenue."""
    return ranking.orderBy(F.col("Priority_Score").asc(), F.col("Total_Revenue").desc(),
                           F.col(dim).asc()).limit(1)


def top_source(leads: DataFrame) -> DataFrame:
    """lead source with the largest total estimated value."""
    return top_n(agg.leads_by_source(leads), "Total_Estimated_Value", "Lead_Source", 1)


def top_product(deals_with_category: DataFrame) -> DataFrame:
    """product category with the largest deal amount."""
    return top_n(agg.product_category_revenue(deals_with_category), "Total_Amount", "Product_Category", 1)


def top_stage(deals: DataFrame) -> DataFrame:
    """the stage with the largest amount (count shown with it)."""
    return top_n(agg.deals_by_stage(deals), "Total_Amount", "Deal_Stage", 1)


def top_region(deals: DataFrame, leads: DataFrame | None = None) -> DataFrame:
    """Region with the largest deal amount (no open filter); when Deals
    has no Region, region with the largest lead estimated value."""
    spark = deals.sparkSession
    if "Region" in deals.columns and "Amount" in deals.columns:
        g = agg.group_sum(deals, "Amount", "Region", "Value")
    elif leads is not None and {"Region", "Estimated_Value"} <= set(leads.columns):
        g = agg.group_sum(leads, "Estimated_Value", "Region", "Value")
    else:
        return guards.empty(spark, "Region string, Value double")
    return top_n(g, "Value", "Region", 1)


def top_rep_pipeline(leads: DataFrame, deals: DataFrame) -> DataFrame:
    """Sales rep with the largest open-pipeline amount (B1 + C1)."""
    spark = deals.sparkSession
    if guards.missing(deals, ["Amount"]):
        return guards.empty(spark, "Sales_Rep string, Pipeline_Amount double")
    d = joins.with_lead_dimension(deals, leads, "Sales_Rep")
    if "Sales_Rep" not in d.columns:
        return guards.empty(spark, "Sales_Rep string, Pipeline_Amount double")
    d = agg.open_pipeline(d)
    g = d.where(F.col("Sales_Rep").isNotNull()).groupBy("Sales_Rep").agg(
        money_sum("Amount").alias("Pipeline_Amount"))
    return top_n(g, "Pipeline_Amount", "Sales_Rep", 1)


def top_deals(deals: DataFrame, forecast_category: str, n: int = 10) -> DataFrame:
    """the n largest deals of one forecast category (null amounts last)."""
    spark = deals.sparkSession
    if guards.missing(deals, ["Deal_ID", "Amount", "Forecast_Category"]):
        return guards.empty(spark, "Deal_ID bigint, Amount double")
    d = deals.where(F.col("Forecast_Category") == F.lit(forecast_category))
    return (d.select("Deal_ID", F.col("Amount").cast("double").alias("Amount"))
            .orderBy(F.col("Amount").desc_nulls_last(), F.col("Deal_ID").asc()).limit(n))


def upcoming_closings(deals: DataFrame, n: int = 10) -> DataFrame:
    """next n closings: date ascending, amount descending (no 'today' cut)."""
    spark = deals.sparkSession
    if guards.missing(deals, ["Deal_ID", "Amount", "Closing_Date"]):
        return guards.empty(spark, "Deal_ID bigint, Closing_Date string, Amount double")
    d = deals.where(F.col("Closing_Date").isNotNull())
    return (d.orderBy(F.col("Closing_Date").asc(), F.col("Amount").desc_nulls_last(), F.col("Deal_ID").asc())
            .limit(n)
            .select("Deal_ID", F.date_format("Closing_Date", "yyyy-MM-dd").alias("Closing_Date"),
                    F.col("Amount").cast("double").alias("Amount")))
