"""SQL text of the CRM stand-in views, for the DuckDB oracle.

Written as SQL on its own (not generated from the Spark code), so that the
oracle is an independent check of the DataFrame implementation. Each oracle
query is ``WITH <these views> <query>``; DuckDB ignores unreferenced views.
"""

LEADS = """
leads AS (
  SELECT c.c_custkey AS Lead_ID,
         c.c_name AS Company_Name,
         c.c_mktsegment AS Lead_Source,
         n.n_name AS Industry,
         CAST(c.c_acctbal AS DECIMAL(18,2)) AS Estimated_Value,
         CASE WHEN c.c_custkey % 23 = 0 THEN NULL
              ELSE 'Rep ' || CAST(c.c_nationkey AS VARCHAR) END AS Sales_Rep,
         CASE WHEN c.c_custkey % 17 = 0 THEN NULL ELSE r.r_name END AS Region,
         CASE c.c_custkey % 6 WHEN 0 THEN 'EPC' WHEN 1 THEN 'Distributor' WHEN 2 THEN 'Installer'
              WHEN 3 THEN 'Commercial Client' WHEN 4 THEN 'Government Client'
              ELSE 'Export Customer' END AS Customer_Type
  FROM customer c
  LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
  LEFT JOIN region r ON n.n_regionkey = r.r_regionkey
)"""

DEALS = """
deals_base AS (
  SELECT o.o_orderkey AS Deal_ID,
         CASE WHEN o.o_orderkey % 29 = 0 THEN NULL
              WHEN o.o_orderkey % 31 = 0 THEN o.o_custkey + 10000000
              ELSE o.o_custkey END AS Lead_ID,
         o.o_custkey AS Account_ID,
         fp.Product_ID,
         CASE WHEN o.o_orderstatus = 'F' THEN 'Closed Won'
              WHEN o.o_orderstatus = 'P' AND o.o_orderkey % 2 = 0 THEN 'Closed Lost'
              WHEN o.o_orderstatus = 'P' THEN 'Negotiation'
              WHEN o.o_orderstatus = 'O' THEN 'Quotation Sent' END AS Deal_Stage,
         CASE WHEN o.o_orderkey % 37 = 0 THEN NULL
              ELSE CAST(o.o_totalprice AS DECIMAL(18,2)) END AS Amount,
         CAST(o.o_orderdate AS DATE) AS Closing_Date,
         o.o_orderpriority AS prio
  FROM orders o
  LEFT JOIN (SELECT l_orderkey, MIN(l_partkey) AS Product_ID FROM lineitem GROUP BY l_orderkey) fp
         ON fp.l_orderkey = o.o_orderkey
),
deals AS (
  SELECT Deal_ID, Lead_ID, Account_ID, Product_ID, Deal_Stage, Amount, Closing_Date,
         CASE WHEN Deal_Stage = 'Closed Won' THEN 'Closed'
              WHEN Deal_Stage = 'Closed Lost' THEN 'Omitted'
              WHEN prio = '1-URGENT' THEN 'Commit'
              WHEN prio = '2-HIGH' THEN 'Best Case'
              WHEN prio = '4-NOT SPECIFIED' THEN 'At Risk'
              ELSE 'Pipeline' END AS Forecast_Category,
         CAST(Amount * CAST(0.15 AS DECIMAL(3,2)) AS DECIMAL(18,4)) AS Margin
  FROM deals_base
)"""

ACCOUNTS = """
accounts AS (
  SELECT c.c_custkey AS Account_ID, c.c_name AS Account_Name, r.r_name AS Region,
         n.n_name AS Industry
  FROM customer c
  LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
  LEFT JOIN region r ON n.n_regionkey = r.r_regionkey
)"""

PRODUCTS = """
products AS (
  SELECT p_partkey AS Product_ID, p_name AS Product_Name, p_type AS Product_Category FROM part
)"""

VENDORS = """
vendors AS (
  SELECT s.s_suppkey AS Vendor_ID, s.s_name AS Vendor_Name, r.r_name AS Region
  FROM supplier s
  LEFT JOIN nation n ON s.s_nationkey = n.n_nationkey
  LEFT JOIN region r ON n.n_regionkey = r.r_regionkey
)"""

PURCHASE_ORDERS = """
purchase_orders AS (
  SELECT l_orderkey AS Purchase_Order_ID, l_suppkey AS Vendor_ID,
         CAST(l_extendedprice AS DECIMAL(18,2)) AS Amount, l_linestatus AS Status
  FROM lineitem
)"""

ACTIVITIES = """
activities AS (
  SELECT event_id AS Activity_ID, 'User ' || CAST(user_id AS VARCHAR) AS Owner,
         event_type AS Status, CAST(ts AS DATE) AS Due_Date
  FROM events
)"""

ALL_VIEWS = ",".join([LEADS, DEALS, ACCOUNTS, PRODUCTS, VENDORS, PURCHASE_ORDERS, ACTIVITIES])


def with_views(body: str) -> str:
    body = body.strip()
    if body[:5].upper() == "WITH ":
        # merge the query's own CTEs after the views
        first, rest = ("WITH RECURSIVE ", body[15:]) if body.startswith("WITH RECURSIVE ") else ("WITH ", body[5:])
        return first + ALL_VIEWS.strip() + ",\n" + rest
    return "WITH " + ALL_VIEWS.strip() + "\n" + body
