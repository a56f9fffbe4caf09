"""One-pass aggregates that insights and summary documents are written from.

``build`` reads Deals once: a GROUPING SETS aggregate over product category,
region, stage, forecast category, closing month and lead (some with a flag that
tells their parts apart, so one sum a set is enough) gives every number that
the reports need, combined map-side before its one shuffle. It is written once to the shared folder, partitioned by set, so each later step reads
its own rows only: a row a group, never a copy of Deals. Lead figures (by
source, rep, and region where Deals has none) come from one scan of Leads
joined to the cube's sums by lead, which also tells which leads converted.

``facts`` picks the best row of each set with ``min_by``, in one row. Ordered
lists of deals need whole rows, so ``top_lists`` reads Deals a second time, four
columns of it: a ``row_number`` limit per list, of which Spark keeps at most
``n`` rows a list in each task before the shuffle.

Columns that Leads or Deals lack count as null; ``have`` tells which are there.
"""

from __future__ import annotations

from dataclasses import dataclass
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revlens.functions.columns import MONEY_SUM, in_set, safe_ratio
from revlens.operators import aggregates as agg
from revlens.operators import joins, trends
from revlens.plans.semantic import WEAK_FORECAST_CATEGORIES
from revlens.sources import ingest

DEAL_COLUMNS = {"Deal_ID": "string", "Lead_ID": "string", "Amount": MONEY_SUM, "Deal_Stage": "string", "Forecast_Category": "string",
                "Closing_Date": "date", "Product_Category": "string", "Region": "string", "Sales_Rep": "string"}
LEAD_COLUMNS = {"Lead_ID": "string", "Lead_Source": "string", "Estimated_Value": MONEY_SUM, "Sales_Rep": "string", "Region": "string"}
#: the sets of the cube: a dimension, with the flag that tells its parts apart
DEAL_SETS = {"Product_Category": ("Product_Category", "Forecast_Category"), "Region": ("Region", "opened"), "Deal_Stage": ("Deal_Stage",),
             "Forecast_Category": ("Forecast_Category",), "Closing_Month": ("Closing_Month", "Forecast_Category"), "Sales_Rep": ("Sales_Rep",),
             "Lead_ID": ("Lead_ID", "opened")}


def _complete(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """``df`` with the columns that it lacks as nulls."""
    return df.select("*", *[F.lit(None).cast(t).alias(c) for c, t in columns.items() if c not in df.columns])


def _exact(value: Column | str, where: Column | None = None) -> Column:
    """Exact sum of a money column, 0 for an empty or all-null group."""
    v = (F.col(value) if isinstance(value, str) else value).cast(MONEY_SUM)
    return F.coalesce(F.sum(v if where is None else F.when(where, v)).cast(MONEY_SUM), F.lit(0).cast(MONEY_SUM))


def _sets(df: DataFrame, sets: dict[str, tuple[str, ...]], aggs: list[Column]) -> DataFrame:
    """``aggs`` of each set of columns; ``set`` has its name."""
    columns = list(dict.fromkeys(c for s in sets.values() for c in s))
    name = F.lit(None).cast("string")
    for out, s in sets.items():
        name = F.when(F.col("gid") == sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in s), out).otherwise(name)
    return df.groupingSets([list(s) for s in sets.values()], *columns).agg(*aggs, F.grouping_id().alias("gid")).withColumn("set", name).drop("gid")


@dataclass
class Report:
    cube: DataFrame          # rows of the deal sets, on disk by set
    leads: DataFrame         # rows of the lead sets
    base: DataFrame          # Deals, for ordered lists
    deal_columns: frozenset[str]
    lead_columns: frozenset[str]
    own_rep: bool            # Deals names its own reps
    lead_region: bool        # regions come from Leads
    stored_facts: DataFrame | None = None

    def deals(self, name: str) -> DataFrame:
        return self.cube.where(F.col("set") == name)

    def have(self, *columns: str, leads: tuple[str, ...] = ()) -> bool:
        return set(columns) <= self.deal_columns and set(leads) <= self.lead_columns

    @property
    def rep_known(self) -> bool:
        """There is a lead side or a deal side of sales rep figures."""
        by_lead = self.have("Deal_ID", "Amount", "Lead_ID", leads=("Lead_ID", "Sales_Rep"))
        return self.have(leads=("Sales_Rep", "Lead_ID", "Estimated_Value")) or by_lead or (self.own_rep and self.have("Deal_ID", "Amount"))


def deal_cube(deals: DataFrame, own_rep: bool) -> DataFrame:
    """Rows, deals and amounts by dimension, month and lead, from one scan: one exact sum a set, so few to carry."""
    opened = agg.open_pipeline_condition(deals)
    d = trends._as_date(_complete(deals, DEAL_COLUMNS), "Closing_Date").withColumn("Closing_Month", F.trunc("Closing_Date", "month"))
    d = d.withColumn("opened", F.lit(False) if opened is None or "Amount" not in deals.columns else F.coalesce(opened, F.lit(False)))
    sets = {k: v for k, v in DEAL_SETS.items() if k != "Sales_Rep" or own_rep}
    return _sets(d, sets, [F.count(F.lit(1)).alias("n"), F.count("Deal_ID").alias("deal_count"), F.count("Amount").alias("amount_count"),
                           _exact("Amount").alias("amount")])


def lead_sets(leads: DataFrame, by_lead: DataFrame, region: bool) -> DataFrame:
    """Leads by source and rep (and region), with the sums of their deals; a repeated lead repeats its deals, as a join does."""
    sums = by_lead.where(F.col("Lead_ID").isNotNull()).groupBy(F.col("Lead_ID").alias("_lead")).agg(
        F.sum("deal_count").alias("deal_count"), F.sum("amount").alias("amount"), F.sum(F.when(F.col("opened"), F.col("amount"))).alias("open_amount"),
        F.sum(F.when(F.col("opened"), F.col("n"))).alias("open_rows"))
    full = _complete(leads, LEAD_COLUMNS).select("Lead_ID", "Lead_Source", "Sales_Rep", "Region", "Estimated_Value")
    both = full.join(sums, F.col("Lead_ID") == F.col("_lead"), "left")
    return _sets(both, {c: (c,) for c in ("Lead_Source", "Sales_Rep", *(["Region"] if region else []))}, [
        F.count("Lead_ID").alias("lead_count"), F.count_distinct("Lead_ID").alias("distinct_leads"), _exact("Estimated_Value").alias("value"),
        F.count("_lead").alias("converted"), F.coalesce(F.sum("deal_count"), F.lit(0)).alias("deal_count"), _exact("amount").alias("amount"),
        _exact("open_amount").alias("open_amount"), F.coalesce(F.sum("open_rows"), F.lit(0)).alias("open_rows")])


def build(leads: DataFrame, deals: DataFrame, base: DataFrame | None = None, several: bool = False) -> Report:
    """Aggregate ``deals`` (enriched) and ``leads``, each scanned once.

    ``base``: Deals without lookups, for ordered lists; ``several``: the facts
    are read several times, so their one row is written, too.
    """
    spark = deals.sparkSession
    own_rep = joins.has_values(deals, "Sales_Rep")
    lead_region = "Region" not in deals.columns and "Region" in leads.columns
    folder = ingest.shared_dir(spark, "report")
    cube = ingest.materialize(deal_cube(deals, own_rep), f"{folder}/deals", ["set"])
    by_source = lead_sets(leads, cube.where(F.col("set") == "Lead_ID"), lead_region)
    r = Report(cube, by_source, base if base is not None else deals, frozenset(deals.columns), frozenset(leads.columns), own_rep, lead_region)
    if several:
        r.stored_facts = ingest.materialize(facts(r), f"{folder}/facts")
    return r


def _best(mine: Column, fields: dict[str, Column], order: list[Column], out: str) -> Column:
    """The fields of the first of ``mine``'s rows in an ascending order."""
    value = F.struct(*[c.alias(n) for n, c in fields.items()])
    return F.min_by(F.when(mine, value), F.when(mine, F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]))).alias(out)


def _money(c: str) -> Column:
    return F.col(c).cast("double")


def reps(r: Report) -> DataFrame:
    """Sales reps with deal count and amount where Deals names its own reps; reps that only Leads knows have 0."""
    zero, none = F.lit(0).cast(MONEY_SUM), F.lit(0).cast("bigint")
    known = F.col("Sales_Rep").isNotNull()
    every = r.leads.where((F.col("set") == "Sales_Rep") & known).select("Sales_Rep", none.alias("deal_count"), zero.alias("amount")) \
        .unionByName(r.deals("Sales_Rep").where(known).select("Sales_Rep", "deal_count", "amount"))
    return every.groupBy("Sales_Rep").agg(F.sum("deal_count").alias("deal_count"), F.sum("amount").alias("amount"))


def facts(r: Report) -> DataFrame:
    """One row: the totals, and a struct for the best row of each set (null where there is none)."""
    if r.stored_facts is not None:
        return r.stored_facts
    dims = ("Product_Category", "Region", "Deal_Stage", "Forecast_Category")
    key = F.coalesce(*[F.when(F.col("set") == d, F.col(d).cast("string")) for d in dims])
    part = lambda name, cond: F.sum(F.when(cond, F.col(name)))
    rows = (r.cube.where(F.col("set").isin(*dims)).groupBy("set", key.alias("k")).agg(
        F.sum("n").alias("n"), F.sum("deal_count").alias("c"), F.sum("amount_count").alias("amount_count"), F.sum("amount").cast("double").alias("a"),
        F.coalesce(part("amount", in_set("Forecast_Category", WEAK_FORECAST_CATEGORIES)).cast("double"), F.lit(0.0)).alias("weak"),
        F.coalesce(part("amount", F.col("opened")).cast("double"), F.lit(0.0)).alias("open_amount"), part("n", F.col("opened")).alias("open_rows"),
        F.sum("amount").alias("exact")))
    mine = lambda d: (F.col("set") == d) & F.col("k").isNotNull()
    one_of = lambda d, k, v, zero: F.coalesce(F.max(F.when((F.col("set") == d) & (F.col("k") == k), F.col(v))), F.lit(zero))
    picks = [one_of("Forecast_Category", k, "a", 0.0).alias(out) for k, out in (("Pipeline", "Pipeline_Amount"), ("Commit", "Commit_Amount"), ("At Risk", "At_Risk_Amount"))]
    picks += [one_of("Forecast_Category", "Pipeline", "n", 0).alias("Pipeline_Deals"), one_of("Deal_Stage", "Closed Won", "a", 0.0).alias("Closed_Won_Amount"),
              one_of("Deal_Stage", "Closed Won", "n", 0).alias("Closed_Won"), one_of("Deal_Stage", "Closed Lost", "n", 0).alias("Closed_Lost")]
    # every deal is in one row of the stages, known or not
    stage = F.col("set") == "Deal_Stage"
    picks += [F.coalesce(F.sum(F.when(stage, F.col("n"))), F.lit(0)).alias("Total_Deals"), F.sum(F.when(stage, F.col("amount_count"))).alias("amount_count"),
              F.sum(F.when(stage, F.col("exact"))).cast("double").alias("amount")]
    for d in ("Product_Category", "Region", "Deal_Stage"):
        picks.append(_best(mine(d), {"k": F.col("k"), "a": F.col("a"), "c": F.col("c")}, [-F.col("a"), F.col("k")], f"top_{d}"))
    ratio = safe_ratio(F.col("weak"), F.col("a"))
    picks.append(_best(mine("Product_Category"), {"k": F.col("k"), "w": F.col("weak"), "r": ratio}, [-ratio, -F.col("weak"), F.col("k")], "weakest"))
    picks.append(_best(mine("Region") & (F.col("open_rows") > 0), {"k": F.col("k"), "a": F.col("open_amount")}, [-F.col("open_amount"), F.col("k")], "open_region"))
    one = rows.agg(*picks).withColumns({
        "Average_Deal_Size": F.try_divide(F.col("amount"), F.col("amount_count").cast("double")),
        "Win_Rate": F.try_divide(F.col("Closed_Won").cast("double"), (F.col("Closed_Won") + F.col("Closed_Lost")).cast("double")) * F.lit(100.0)})
    source = (F.col("set") == "Lead_Source") & F.col("Lead_Source").isNotNull()
    rate = safe_ratio(F.col("converted"), F.col("distinct_leads"))
    by_lead = [_best(source, {"k": F.col("Lead_Source").cast("string"), "v": _money("value"), "c": F.col("lead_count")},
                     [-_money("value"), F.col("Lead_Source").cast("string")], "top_source"),
               _best(source, {"k": F.col("Lead_Source").cast("string"), "v": _money("value"), "r": rate},
                     [-_money("value"), rate, F.col("Lead_Source").cast("string")], "conversion")]
    if r.lead_region:
        one = one.drop("open_region")
        by_lead.append(_best((F.col("set") == "Region") & F.col("Region").isNotNull() & (F.col("open_rows") > 0),
                             {"k": F.col("Region").cast("string"), "a": _money("open_amount")}, [-_money("open_amount"), F.col("Region").cast("string")], "open_region"))
    best_rep = lambda known: _best(known & F.col("Sales_Rep").isNotNull(), {"k": F.col("Sales_Rep").cast("string"), "a": _money("amount"), "c": F.col("deal_count")},
                                   [-_money("amount"), F.col("Sales_Rep").cast("string")], "top_rep")
    others = []
    if r.own_rep:
        others.append(reps(r).agg(best_rep(F.lit(True))))
    else:  # deals come through leads: the lead sets have all of it
        by_lead.append(best_rep(F.col("set") == "Sales_Rep"))
    out = one
    for other in (r.leads.agg(*by_lead), *others):
        out = out.withColumn("__k", F.lit(1)).join(F.broadcast(other.withColumn("__k", F.lit(1))), "__k").drop("__k")  # one row each
    return out


def forecast_totals(r: Report) -> DataFrame:
    return r.deals("Forecast_Category").where(F.col("Forecast_Category").isNotNull()).select("Forecast_Category", _money("amount").alias("Total_Amount"))


def pipeline_months(r: Report) -> DataFrame:
    """Pipeline amount of each closing month, gaps filled (``monthly_trend`` from the sets)."""
    monthly = (r.deals("Closing_Month").where(F.col("Closing_Month").isNotNull() & (F.col("Forecast_Category") == "Pipeline"))
               .select(F.col("Closing_Month").alias("__m"), _money("amount").alias("Total_Amount")))
    return trends.filled_months(monthly)


def top_lists(deals: DataFrame, n: int) -> DataFrame:
    """The ``n`` first deals of each list: ``list`` (At Risk, Commit, Upcoming), Deal_ID, Amount double, Closing_Date, ``place``."""
    d = trends._as_date(_complete(deals, DEAL_COLUMNS), "Closing_Date").select("Deal_ID", "Amount", "Forecast_Category", "Closing_Date")
    lists = F.array(*[F.when(F.col("Forecast_Category") == c, F.lit(c)) for c in ("At Risk", "Commit")], F.when(F.col("Closing_Date").isNotNull(), F.lit("Upcoming")))
    each = d.withColumn("list", F.explode(F.array_compact(lists)))
    soonest = F.when(F.col("list") == "Upcoming", F.col("Closing_Date"))
    w = Window.partitionBy("list").orderBy(soonest.asc_nulls_last(), F.col("Amount").desc_nulls_last(), F.col("Deal_ID").asc())
    return (each.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)
            .select("list", "Deal_ID", F.col("Amount").cast("double").alias("Amount"), "Closing_Date", "place"))
