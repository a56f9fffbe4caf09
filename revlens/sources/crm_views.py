"""CRM module views over the TPC-H-style testdata.

The testdata has no CRM tables, so these views give rows in the canonical
CRM schema (Leads, Deals, Accounts, Products, Vendors, Purchase Orders,
Activities). They only rename and derive columns; they do none of the
analytics. The operators in ``revlens.operators`` work on any data of this
schema and take nothing from how these rows were made.

Some derived columns are made null or made to point at no lead, so that the
null rules and the join-coverage checks have something to find.

Scale notes: ``nation`` and ``region`` have a fixed size (25 and 5 rows by
the TPC-H definition), so they are broadcast. The one aggregate here
(first part of each order) is a partial+final aggregate on ``l_orderkey``;
its output is already hash-partitioned on the join key, so joining it to
``orders`` shuffles only ``orders``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.functions.columns import MONEY
from revlens.sources.tables import Catalog

# Customer types of the CRM domain.
CUSTOMER_TYPES = ("EPC", "Distributor", "Installer", "Commercial Client", "Government Client",
                  "Export Customer")
ORPHAN_LEAD_OFFSET = 10_000_000


def _geo(cat: Catalog) -> DataFrame:
    """nation x region, 25 rows by definition: safe to broadcast."""
    n = cat.nation.select("n_nationkey", "n_name", "n_regionkey")
    r = cat.region.select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    return F.broadcast(n.join(F.broadcast(r), "n_regionkey"))


def leads(cat: Catalog) -> DataFrame:
    c = cat.customer.select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    g = _geo(cat).withColumnRenamed("n_nationkey", "c_nationkey")
    j = c.join(g, "c_nationkey", "left")
    key = F.col("c_custkey")
    ctype = F.element_at(F.array(*[F.lit(t) for t in CUSTOMER_TYPES]),
                         (F.pmod(key, F.lit(len(CUSTOMER_TYPES))) + 1).cast("int"))
    return j.select(
        key.alias("Lead_ID"),
        F.col("c_name").alias("Company_Name"),
        F.col("c_mktsegment").alias("Lead_Source"),
        F.col("n_name").alias("Industry"),
        F.col("c_acctbal").cast(MONEY).alias("Estimated_Value"),
        F.when(F.pmod(key, F.lit(23)) == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("Rep "), F.col("c_nationkey").cast("string"))).alias("Sales_Rep"),
        F.when(F.pmod(key, F.lit(17)) == 0, F.lit(None).cast("string"))
         .otherwise(F.col("r_name")).alias("Region"),
        ctype.alias("Customer_Type"),
    )


def deals(cat: Catalog) -> DataFrame:
    o = cat.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
                          "o_orderdate", "o_orderpriority")
    first_part = (cat.lineitem.groupBy("l_orderkey")
                  .agg(F.min("l_partkey").alias("Product_ID"))
                  .withColumnRenamed("l_orderkey", "o_orderkey"))
    j = o.join(first_part, "o_orderkey", "left")
    key = F.col("o_orderkey")
    amount = F.when(F.pmod(key, F.lit(37)) == 0, F.lit(None).cast(MONEY)) \
        .otherwise(F.col("o_totalprice").cast(MONEY))
    lead = (F.when(F.pmod(key, F.lit(29)) == 0, F.lit(None).cast("bigint"))
            .when(F.pmod(key, F.lit(31)) == 0, F.col("o_custkey") + F.lit(ORPHAN_LEAD_OFFSET))
            .otherwise(F.col("o_custkey")))
    stage = (F.when(F.col("o_orderstatus") == "F", F.lit("Closed Won"))
             .when((F.col("o_orderstatus") == "P") & (F.pmod(key, F.lit(2)) == 0), F.lit("Closed Lost"))
             .when(F.col("o_orderstatus") == "P", F.lit("Negotiation"))
             .when(F.col("o_orderstatus") == "O", F.lit("Quotation Sent")))
    prio = F.col("o_orderpriority")
    forecast = (F.when(stage == "Closed Won", F.lit("Closed"))
                .when(stage == "Closed Lost", F.lit("Omitted"))
                .when(prio == "1-URGENT", F.lit("Commit"))
                .when(prio == "2-HIGH", F.lit("Best Case"))
                .when(prio == "4-NOT SPECIFIED", F.lit("At Risk"))
                .otherwise(F.lit("Pipeline")))
    return j.select(
        key.alias("Deal_ID"),
        lead.alias("Lead_ID"),
        F.col("o_custkey").alias("Account_ID"),
        F.col("Product_ID"),
        stage.alias("Deal_Stage"),
        amount.alias("Amount"),
        F.col("o_orderdate").cast("date").alias("Closing_Date"),
        forecast.alias("Forecast_Category"),
        (amount * F.lit(0.15).cast("decimal(3,2)")).cast("decimal(18,4)").alias("Margin"),
    )


def accounts(cat: Catalog) -> DataFrame:
    c = cat.customer.select("c_custkey", "c_name", "c_nationkey")
    g = _geo(cat).withColumnRenamed("n_nationkey", "c_nationkey")
    return c.join(g, "c_nationkey", "left").select(
        F.col("c_custkey").alias("Account_ID"),
        F.col("c_name").alias("Account_Name"),
        F.col("r_name").alias("Region"),
        F.col("n_name").alias("Industry"),
    )


def products(cat: Catalog) -> DataFrame:
    return cat.part.select(
        F.col("p_partkey").alias("Product_ID"),
        F.col("p_name").alias("Product_Name"),
        F.col("p_type").alias("Product_Category"),
    )


def vendors(cat: Catalog) -> DataFrame:
    s = cat.supplier.select("s_suppkey", "s_name", "s_nationkey")
    g = _geo(cat).withColumnRenamed("n_nationkey", "s_nationkey")
    return s.join(g, "s_nationkey", "left").select(
        F.col("s_suppkey").alias("Vendor_ID"),
        F.col("s_name").alias("Vendor_Name"),
        F.col("r_name").alias("Region"),
    )


def purchase_orders(cat: Catalog) -> DataFrame:
    li = cat.lineitem.select("l_orderkey", "l_suppkey", "l_extendedprice", "l_linestatus")
    return li.select(
        F.col("l_orderkey").alias("Purchase_Order_ID"),
        F.col("l_suppkey").alias("Vendor_ID"),
        F.col("l_extendedprice").cast(MONEY).alias("Amount"),
        F.col("l_linestatus").alias("Status"),
    )


def activities(cat: Catalog) -> DataFrame:
    ev = cat.events.select("event_id", "user_id", "event_type", "ts")
    return ev.select(
        F.col("event_id").alias("Activity_ID"),
        F.concat(F.lit("User "), F.col("user_id").cast("string")).alias("Owner"),
        F.col("event_type").alias("Status"),
        F.col("ts").cast("date").alias("Due_Date"),
    )


VIEW_BUILDERS = {
    "Leads": leads,
    "Deals": deals,
    "Accounts": accounts,
    "Products": products,
    "Vendors": vendors,
    "Purchase Orders": purchase_orders,
    "Activities": activities,
}


def crm_modules(cat: Catalog, names=None) -> dict[str, DataFrame]:
    """Lazy frames for the named CRM modules (all by default)."""
    names = names or list(VIEW_BUILDERS)
    return {n: VIEW_BUILDERS[n](cat) for n in names}
