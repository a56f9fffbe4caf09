"""A hot join key (a third of all deals) is split by AQE instead of landing in one task."""

from pyspark.sql import functions as F

from revlens.operators import aggregates as agg
from revlens.operators import joins


def _skewed(spark, n=300_000):
    deals = spark.range(n).select(
        F.col("id").alias("Deal_ID"),
        F.when(F.col("id") % 3 == 0, F.lit(None)).when(F.col("id") % 3 == 1, F.lit(7))
        .otherwise(F.col("id") % 5000).cast("bigint").alias("Lead_ID"),
        (F.col("id") % 1000).cast("decimal(18,2)").alias("Amount"))
    leads = spark.range(5000).select(F.col("id").alias("Lead_ID"),
                                     F.concat(F.lit("Rep "), (F.col("id") % 25).cast("string")).alias("Sales_Rep"))
    return deals, leads


def test_hot_key_join_is_split(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold",
                                          "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes",
                                          "spark.sql.adaptive.advisoryPartitionSizeInBytes")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "128KB")
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "128KB")
        deals, leads = _skewed(spark)
        grouped = agg.group_sum(joins.with_lead_dimension(deals, leads, "Sales_Rep"), "Amount", "Sales_Rep")
        total = sum(r["Value"] for r in grouped.collect())
        plan = grouped._jdf.queryExecution().executedPlan().toString()
        assert "skew=true" in plan
        # every deal with a known lead is counted once
        exp = deals.where("Lead_ID IS NOT NULL").agg(F.sum("Amount")).first()[0]
        assert total == float(exp)
        # the left join keeps the null-key third of the deals
        kept = joins.with_lead_dimension(deals, leads, "Sales_Rep")
        assert kept.count() == deals.count()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
