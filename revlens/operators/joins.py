"""Equi-joins of the CRM star.

All joins are equi-joins on one key. Join strategy is left to Catalyst and
AQE: with runtime statistics AQE turns a small lookup side into a broadcast
and splits a skewed partition of the large side (a hot or null ``Lead_ID``)
into several tasks. No ``broadcast()`` hint is placed on lookup sides here,
because Accounts, Products and Leads grow with the data.

Semantics kept from the reference:

* Fan-out joins (C1-C3): Deals LEFT JOIN Leads on Lead_ID with no dedupe, so
  a duplicated lead repeats its deals.
* Deduped lookups (C4, C5): one row per key; the kept row is the smallest
  value of the looked-up columns (a stated order, since file order does not
  exist in Spark). This is one partial+final aggregate, so a hot key costs
  one row per map task.
* Null keys never match (SQL equality). ``null_safe=True`` switches to
  ``<=>`` for strict parity with pandas' null-matches-null merge.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _join(left: DataFrame, right: DataFrame, key: str, how: str, null_safe: bool) -> DataFrame:
    if not null_safe:
        return left.join(right, key, how)
    r = right.withColumnRenamed(key, "__rk")
    out = left.join(r, left[key].eqNullSafe(r["__rk"]), how)
    return out.drop("__rk")


def has_values(df: DataFrame, column: str) -> bool:
    """True if ``column`` exists and has at least one non-null value.

    A probe that stops at the first non-null row (``limit(1)``).
    """
    if column not in df.columns:
        return False
    return len(df.where(F.col(column).isNotNull()).select(column).limit(1).collect()) > 0


def with_lead_dimension(deals: DataFrame, leads: DataFrame, dimension: str,
                        null_safe: bool = False) -> DataFrame:
    """Bring one Leads column onto Deals through Lead_ID (fan-out).

    If Deals already has the column it is used as is; a Deals column with no
    value at all is dropped first and replaced from Leads.
    """
    if dimension in deals.columns:
        if has_values(deals, dimension) or "Lead_ID" not in deals.columns:
            return deals
        deals = deals.drop(dimension)
    if "Lead_ID" not in deals.columns or not {"Lead_ID", dimension} <= set(leads.columns):
        return deals
    return _join(deals, leads.select("Lead_ID", dimension), "Lead_ID", "left", null_safe)


def dedupe_lookup(lookup: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One row per non-null key; one looked-up column keeps its smallest non-null
    value, several keep the smallest (columns...) tuple."""
    cols = [c for c in columns if c != key]
    if len(cols) == 1:
        # one column: the smallest non-null value
        return (lookup.where(F.col(key).isNotNull()).groupBy(key)
                .agg(F.min(F.col(cols[0])).alias(cols[0])))
    best = F.min(F.struct(*[F.col(c) for c in cols])).alias("__best")
    agg = lookup.where(F.col(key).isNotNull()).groupBy(key).agg(best)
    return agg.select(key, *[F.col(f"__best.{c}").alias(c) for c in cols])


def with_lookup(deals: DataFrame, lookup: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Deals LEFT JOIN a key-deduplicated lookup (Accounts, Products, Leads)."""
    keep = [c for c in deals.columns if c not in columns or c == key]
    return deals.select(*keep).join(dedupe_lookup(lookup, key, columns), key, "left")


def conversion_flag(leads: DataFrame, deals: DataFrame, flag: str = "Converted") -> DataFrame:
    """Mark each lead whose Lead_ID appears among the non-null deal Lead_IDs.

    An existence join: the distinct deal keys are an aggregate partitioned on
    Lead_ID, which the join reuses, so only Leads is shuffled.
    """
    keys = (deals.select("Lead_ID").where(F.col("Lead_ID").isNotNull()).distinct()
            .withColumn(flag, F.lit(True)))
    return (leads.join(keys, "Lead_ID", "left")
            .withColumn(flag, F.coalesce(F.col(flag), F.lit(False))))


def orphan_rows(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left rows with a non-null key that has no match on the right."""
    return left.where(F.col(key).isNotNull()).join(right.select(key), key, "left_anti")


def coverage(left: DataFrame, lookups: list[tuple[int, DataFrame, str]]) -> DataFrame:
    """C11 numbers of several lookups of one left frame, one row per number:
    rows on each side, rows checked (non-null left keys), matched, unmatched,
    and whether the lookup side repeats a non-null key.

    The left frame is read once: its keys become (lookup number, key) rows. Each
    right side is reduced to one row per key (a partial+final aggregate, so a
    hot key is one row) and one existence join matches both on (number, key).
    """
    wide = left.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(k).cast("string").alias("k")) for i, _, k in lookups])).alias("e")).select("e.*")
    parts = [r.groupBy(F.col(k).cast("string").alias("k")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(i).alias("i"), "k", "n") for i, r, k in lookups]
    rkeys = reduce(lambda x, y: x.unionByName(y), parts)
    # the key rows and the per-lookup totals of the right sides meet in one aggregate
    per_key = (wide.groupBy("i", "k").agg(F.count(F.lit(1)).alias("l"))
               .join(rkeys, (wide["i"] == rkeys["i"]) & wide["k"].eqNullSafe(rkeys["k"]), "full_outer")
               .select(F.coalesce(wide["i"], rkeys["i"]).alias("i"), F.coalesce(wide["k"], rkeys["k"]).alias("k"),
                       F.coalesce("l", F.lit(0)).alias("l"), F.coalesce("n", F.lit(0)).alias("n")))
    known = F.col("k").isNotNull()
    return per_key.groupBy("i").agg(
        F.sum("l").alias("left_rows"), F.sum("n").alias("right_rows"), F.sum(F.when(known, F.col("l")).otherwise(0)).alias("rows_checked"),
        F.sum(F.when(known & (F.col("n") > 0), F.col("l")).otherwise(0)).alias("matched_rows"),
        F.max(known & (F.col("n") > 1)).alias("lookup_has_duplicates"))
