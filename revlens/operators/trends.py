"""Month trends.

The month summary has one row per month, so the calendar (a ``sequence``
between the first and last month, exploded) and its left join are small no
matter how many deals there are; the deals themselves only go through one
partial+final aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.functions.columns import iso_date, money_mean, money_sum, month_key, month_label, parse_date_lenient
from revlens.operators import guards

TREND_SCHEMA = "Period_Start string, Closing_Month string, Total_Amount double"


def _as_date(df: DataFrame, date_col: str) -> DataFrame:
    dtype = dict(df.dtypes)[date_col]
    if dtype == "date":
        return df
    if dtype.startswith("timestamp"):
        return df.withColumn(date_col, F.col(date_col).cast("date"))
    return df.withColumn(date_col, parse_date_lenient(date_col))


def monthly_trend(deals: DataFrame, date_col: str = "Closing_Date", value_col: str = "Amount",
                  forecast_category: str | None = None) -> DataFrame:
    """Sum of ``value_col`` per month of ``date_col``, every month between the
    first and last filled (0 for a month without deals), labelled ``Mon YYYY``.

    Unparsable or null dates are dropped first. With ``forecast_category`` only
    deals of that category count (missing column -> empty result).
    """
    spark = deals.sparkSession
    need = [date_col, value_col] + (["Forecast_Category"] if forecast_category else [])
    if guards.missing(deals, need):
        return guards.empty(spark, TREND_SCHEMA)
    d = _as_date(deals, date_col).where(F.col(date_col).isNotNull())
    if forecast_category is not None:
        d = d.where(F.col("Forecast_Category") == F.lit(forecast_category))
    monthly = (d.withColumn("__m", F.trunc(F.col(date_col), "month"))
               .groupBy("__m").agg(money_sum(value_col).alias("Total_Amount")))
    return filled_months(monthly)


def filled_months(monthly: DataFrame) -> DataFrame:
    """A row for every month from the first to the last of ``monthly`` (``__m``, Total_Amount), 0 for a missing one."""
    bounds = monthly.agg(F.min("__m").alias("lo"), F.max("__m").alias("hi"))
    # empty input: sequence(null, null) is null and explode gives no row
    calendar = bounds.select(F.explode(F.sequence("lo", "hi", F.expr("interval 1 month"))).alias("__m"))
    out = calendar.join(monthly, "__m", "left")
    return (out.select(iso_date("__m").alias("Period_Start"), month_label("__m").alias("Closing_Month"),
                       F.coalesce(F.col("Total_Amount"), F.lit(0.0)).alias("Total_Amount"))
            .orderBy("Period_Start"))


def peak_month(trend: DataFrame) -> DataFrame:
    """the month with the largest total (earliest on a tie)."""
    return trend.orderBy(F.col("Total_Amount").desc(), F.col("Period_Start").asc()).limit(1)


def chart_data_month(df: DataFrame, date_col: str, value_col: str, aggregation: str = "sum") -> DataFrame:
    """Aggregate per ``yyyy-MM`` month (no gap filling), chronological."""
    spark = df.sparkSession
    if guards.missing(df, [date_col, value_col]):
        return guards.empty(spark, "Month string, Value double")
    d = _as_date(df, date_col).where(F.col(date_col).isNotNull())
    value = {"sum": money_sum(value_col), "mean": money_mean(value_col),
             "count": F.count(F.col(value_col)).cast("double")}[aggregation]
    return (d.withColumn("Month", month_key(date_col)).groupBy("Month").agg(value.alias("Value"))
            .orderBy("Month"))


def chart_data_category(df: DataFrame, dim: str, value_col: str, aggregation: str = "sum") -> DataFrame:
    """Aggregate per category (null category dropped), largest first."""
    spark = df.sparkSession
    if guards.missing(df, [dim, value_col]):
        return guards.empty(spark, f"`{dim}` string, Value double")
    value = {"sum": money_sum(value_col), "mean": money_mean(value_col),
             "count": F.count(F.col(value_col)).cast("double")}[aggregation]
    return (df.where(F.col(dim).isNotNull()).groupBy(dim).agg(value.alias("Value"))
            .orderBy(F.col("Value").desc(), F.col(dim).asc()))
