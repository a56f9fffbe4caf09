"""DuckDB oracle SQL, one statement per registered query.

Written by hand as SQL, separately from the DataFrame code. Conventions that
make both engines produce bit-identical values:

* money is summed as DECIMAL and cast to DOUBLE afterwards;
* means are CAST(SUM(x) AS DOUBLE) / COUNT(x);
* ratios divide doubles and map a zero denominator to 0.0;
* dates are returned as text.
"""

from __future__ import annotations

from revlens.plans.oracle_views import with_views

SQL: dict[str, str] = {}
BODIES: dict[str, str] = {}  # without the views, to be used in others


def sql(name: str, body: str) -> None:
    if name in SQL:
        raise ValueError(f"duplicate oracle {name}")
    SQL[name] = with_views(body)
    BODIES[name] = body


def MSUM(x: str, where: str | None = None) -> str:
    v = f"CASE WHEN {where} THEN {x} END" if where else x
    return f"CAST(COALESCE(SUM(CAST({v} AS DECIMAL(38,6))), 0) AS DOUBLE)"


def MMEAN(x: str) -> str:
    return f"(CAST(SUM(CAST({x} AS DECIMAL(38,6))) AS DOUBLE) / NULLIF(CAST(COUNT({x}) AS DOUBLE), 0))"


def RATIO(num: str, den: str) -> str:
    return f"COALESCE(CAST({num} AS DOUBLE) / NULLIF(CAST({den} AS DOUBLE), 0), 0.0)"


OPEN = ("(COALESCE(Forecast_Category IN ('Pipeline','Best Case','Commit','At Risk'), FALSE) "
        "OR COALESCE(Deal_Stage IN ('New Inquiry','Technical Discussion','Quotation Sent','Negotiation',"
        "'PO Received','Proposal'), FALSE)) "
        "AND NOT COALESCE(Deal_Stage IN ('Closed Won','Closed Lost'), FALSE)")

DEALS_REGION_FROM_LEADS = "deals d LEFT JOIN leads l ON d.Lead_ID = l.Lead_ID"
PRODUCTS_DEDUP = ("(SELECT Product_ID, MIN(Product_Category) AS Product_Category FROM products "
                  "WHERE Product_ID IS NOT NULL GROUP BY Product_ID)")

sql("deals_by_stage", f"""
SELECT Deal_Stage, COUNT(Deal_ID) AS Deal_Count, {MSUM('Amount')} AS Total_Amount
FROM deals WHERE Deal_Stage IS NOT NULL GROUP BY Deal_Stage""")

sql("leads_by_source", f"""
SELECT Lead_Source, COUNT(Lead_ID) AS Lead_Count, {MSUM('Estimated_Value')} AS Total_Estimated_Value
FROM leads WHERE Lead_Source IS NOT NULL GROUP BY Lead_Source""")

sql("forecast_summary", f"""
SELECT Forecast_Category, COUNT(Deal_ID) AS Deal_Count, {MSUM('Amount')} AS Total_Amount
FROM deals WHERE Forecast_Category IS NOT NULL GROUP BY Forecast_Category""")

sql("product_category_revenue", f"""
SELECT p.Product_Category, COUNT(d.Deal_ID) AS Deal_Count, {MSUM('d.Amount')} AS Total_Amount
FROM deals d LEFT JOIN {PRODUCTS_DEDUP} p ON d.Product_ID = p.Product_ID
WHERE p.Product_Category IS NOT NULL GROUP BY p.Product_Category""")

sql("region_pipeline", f"""
SELECT l.Region, COUNT(d.Deal_ID) AS Deal_Count, {MSUM('d.Amount')} AS Total_Amount
FROM (SELECT * FROM deals WHERE {OPEN}) d LEFT JOIN leads l ON d.Lead_ID = l.Lead_ID
WHERE l.Region IS NOT NULL GROUP BY l.Region""")

sql("sales_rep_performance", f"""
SELECT COALESCE(a.Sales_Rep, b.Sales_Rep) AS Sales_Rep,
       COALESCE(a.Lead_Count, 0) AS Lead_Count,
       COALESCE(a.Total_Estimated_Value, 0.0) AS Total_Estimated_Value,
       COALESCE(b.Deal_Count, 0) AS Deal_Count,
       COALESCE(b.Total_Deal_Amount, 0.0) AS Total_Deal_Amount
FROM (SELECT Sales_Rep, COUNT(Lead_ID) AS Lead_Count, {MSUM('Estimated_Value')} AS Total_Estimated_Value
      FROM leads WHERE Sales_Rep IS NOT NULL GROUP BY Sales_Rep) a
FULL OUTER JOIN
     (SELECT l.Sales_Rep, COUNT(d.Deal_ID) AS Deal_Count, {MSUM('d.Amount')} AS Total_Deal_Amount
      FROM deals d LEFT JOIN leads l ON d.Lead_ID = l.Lead_ID
      WHERE l.Sales_Rep IS NOT NULL GROUP BY l.Sales_Rep) b
ON a.Sales_Rep = b.Sales_Rep""")

sql("kpi_totals", f"""
SELECT (SELECT COUNT(*) FROM leads) AS Total_Leads,
       (SELECT COUNT(*) FROM deals) AS Total_Deals,
       (SELECT {MSUM('Estimated_Value')} FROM leads) AS Total_Estimated_Value,
       (SELECT {MSUM('Amount')} FROM deals) AS Total_Deal_Amount""")

sql("kpi_forecast_stage", f"""
SELECT COUNT(*) AS Total_Deals,
       {MSUM('Amount', "Forecast_Category = 'Pipeline'")} AS Pipeline_Amount,
       COUNT(*) FILTER (WHERE Forecast_Category = 'Pipeline') AS Pipeline_Deals,
       {MSUM('Amount', "Forecast_Category = 'Commit'")} AS Commit_Amount,
       {MSUM('Amount', "Forecast_Category = 'At Risk'")} AS At_Risk_Amount,
       {MSUM('Amount', "Deal_Stage = 'Closed Won'")} AS Closed_Won_Amount,
       COUNT(*) FILTER (WHERE Deal_Stage = 'Closed Won') AS Closed_Won,
       COUNT(*) FILTER (WHERE Deal_Stage = 'Closed Lost') AS Closed_Lost,
       {MMEAN('Amount')} AS Average_Deal_Size,
       CAST(COUNT(*) FILTER (WHERE Deal_Stage = 'Closed Won') AS DOUBLE)
         / NULLIF(CAST(COUNT(*) FILTER (WHERE Deal_Stage IN ('Closed Won','Closed Lost')) AS DOUBLE), 0)
         * 100.0 AS Win_Rate
FROM deals""")

sql("total_pipeline", f"""
SELECT {MSUM('Amount', "Forecast_Category = 'Pipeline'")} AS Total_Pipeline_Amount FROM deals""")

sql("avg_deal_size", f"""
SELECT {MMEAN('Amount')} AS Average_Deal_Size, COUNT(*) AS Deal_Count FROM deals""")

sql("win_rate_total", f"""
SELECT Closed_Won, Closed_Lost, {RATIO('Closed_Won', 'Closed_Won + Closed_Lost')} * 100.0 AS Win_Rate
FROM (SELECT COUNT(*) FILTER (WHERE Deal_Stage = 'Closed Won') AS Closed_Won,
             COUNT(*) FILTER (WHERE Deal_Stage = 'Closed Lost') AS Closed_Lost
      FROM deals WHERE Deal_Stage IN ('Closed Won','Closed Lost'))
WHERE Closed_Won + Closed_Lost > 0""")

sql("open_pipeline", f"""
SELECT Deal_ID, Lead_ID, Deal_Stage, Forecast_Category, CAST(Amount AS DOUBLE) AS Amount
FROM deals WHERE {OPEN}""")

sql("forecast_filter", """
SELECT Deal_ID, Forecast_Category, CAST(Amount AS DOUBLE) AS Amount
FROM deals WHERE Forecast_Category = 'Commit'""")

sql("stage_filter", """
SELECT Deal_ID, Deal_Stage, CAST(Amount AS DOUBLE) AS Amount
FROM deals WHERE Deal_Stage = 'Negotiation'""")

sql("filter_ci", f"""
SELECT d.Deal_Stage, {MSUM('d.Amount')} AS Total_Amount
FROM {DEALS_REGION_FROM_LEADS}
WHERE lower(l.Region) = 'asia' AND lower(d.Forecast_Category) = 'best case' AND d.Deal_Stage IS NOT NULL
GROUP BY d.Deal_Stage""")

sql("forecast_quality", f"""
SELECT Product_Category, Total_Amount, Weak_Forecast_Amount, Strong_Forecast_Amount,
       {RATIO('Weak_Forecast_Amount', 'Total_Amount')} AS Weak_Forecast_Ratio
FROM (SELECT p.Product_Category,
             {MSUM('d.Amount')} AS Total_Amount,
             {MSUM('d.Amount', "d.Forecast_Category IN ('At Risk','Omitted','Pipeline')")} AS Weak_Forecast_Amount,
             {MSUM('d.Amount', "d.Forecast_Category IN ('Commit','Closed','Best Case')")} AS Strong_Forecast_Amount
      FROM deals d LEFT JOIN {PRODUCTS_DEDUP} p ON d.Product_ID = p.Product_ID
      WHERE p.Product_Category IS NOT NULL GROUP BY p.Product_Category)""")

_CONVERSION = f"""
SELECT Lead_Source, Total_Leads, Converted_Leads, Estimated_Value, Avg_Estimated_Value,
       {RATIO('Converted_Leads', 'Total_Leads')} AS Conversion_Rate
FROM (SELECT l.Lead_Source,
             COUNT(DISTINCT l.Lead_ID) AS Total_Leads,
             COUNT(*) FILTER (WHERE l.Lead_ID IN (SELECT Lead_ID FROM deals WHERE Lead_ID IS NOT NULL))
               AS Converted_Leads,
             {MSUM('l.Estimated_Value')} AS Estimated_Value,
             {MMEAN('l.Estimated_Value')} AS Avg_Estimated_Value
      FROM leads l WHERE l.Lead_Source IS NOT NULL GROUP BY l.Lead_Source)"""

sql("lead_conversion", _CONVERSION)

sql("below_avg_conversion", f"""
SELECT c.*, a.Average_Conversion_Rate FROM ({_CONVERSION}) c,
  (SELECT AVG(Conversion_Rate) AS Average_Conversion_Rate FROM ({_CONVERSION})) a
WHERE c.Conversion_Rate < a.Average_Conversion_Rate""")

sql("deals_with_rep", f"""
SELECT d.Deal_ID, d.Lead_ID, l.Sales_Rep FROM {DEALS_REGION_FROM_LEADS}""")

sql("deals_with_region", f"""
SELECT d.Deal_ID, d.Lead_ID, l.Region FROM {DEALS_REGION_FROM_LEADS}""")

sql("deals_with_dim", f"""
SELECT l.Lead_Source, COUNT(d.Deal_ID) AS Deal_Count
FROM {DEALS_REGION_FROM_LEADS} WHERE l.Lead_Source IS NOT NULL GROUP BY l.Lead_Source""")

sql("orphan_deals", """
SELECT d.Deal_ID, d.Lead_ID FROM deals d
WHERE d.Lead_ID IS NOT NULL AND NOT EXISTS (SELECT 1 FROM leads l WHERE l.Lead_ID = d.Lead_ID)""")

sql("stage_by_region", f"""
SELECT l.Region, d.Deal_Stage, COUNT(d.Deal_ID) AS Deal_Count, {MSUM('d.Amount')} AS Total_Amount
FROM {DEALS_REGION_FROM_LEADS}
WHERE l.Region IS NOT NULL AND d.Deal_Stage IS NOT NULL GROUP BY l.Region, d.Deal_Stage""")


# ----------------------------------------------------------------- trends
def _trend(where: str) -> str:
    return f"""
WITH mon AS (SELECT date_trunc('month', Closing_Date) AS m, {MSUM('Amount')} AS Total_Amount
             FROM deals WHERE Closing_Date IS NOT NULL {where} GROUP BY 1),
cal AS (SELECT unnest(generate_series((SELECT min(m) FROM mon), (SELECT max(m) FROM mon),
                                      INTERVAL 1 MONTH)) AS m)
SELECT strftime(cal.m, '%Y-%m-%d') AS Period_Start, strftime(cal.m, '%b %Y') AS Closing_Month,
       COALESCE(mon.Total_Amount, 0.0) AS Total_Amount
FROM cal LEFT JOIN mon ON cal.m = mon.m"""


sql("monthly_trend", _trend(""))
sql("monthly_pipeline_trend", _trend("AND Forecast_Category = 'Pipeline'"))
sql("peak_month", "SELECT * FROM (" + _trend("AND Forecast_Category = 'Pipeline'").replace(
    "WITH mon", "SELECT * FROM (WITH mon", 1) + ") ORDER BY Total_Amount DESC, Period_Start ASC LIMIT 1)")

sql("chart_data_month", f"""
SELECT strftime(Closing_Date, '%Y-%m') AS Month, {MSUM('Amount')} AS Value
FROM deals WHERE Closing_Date IS NOT NULL GROUP BY 1""")

sql("chart_data_category", f"""
SELECT Deal_Stage, {MMEAN('Amount')} AS Value FROM deals WHERE Deal_Stage IS NOT NULL GROUP BY 1""")


# ------------------------------------------------------ metric x dimension
def _lookup(table: str, key: str, column: str) -> str:
    return (f"LEFT JOIN (SELECT {key}, MIN({column}) AS {column} FROM {table} "
            f"WHERE {key} IS NOT NULL GROUP BY {key}) x ON d.{key} = x.{key}")


DIM_SOURCE = {
    "Region": (_lookup("accounts", "Account_ID", "Region"), "x.Region"),
    "Account_Name": (_lookup("accounts", "Account_ID", "Account_Name"), "x.Account_Name"),
    "Customer_Type": (_lookup("leads", "Lead_ID", "Customer_Type"), "x.Customer_Type"),
    "Product_Name": (_lookup("products", "Product_ID", "Product_Name"), "x.Product_Name"),
    "Product_Category": (_lookup("products", "Product_ID", "Product_Category"), "x.Product_Category"),
    "Sales_Rep": ("LEFT JOIN leads x ON d.Lead_ID = x.Lead_ID", "x.Sales_Rep"),
    "Lead_Source": ("LEFT JOIN leads x ON d.Lead_ID = x.Lead_ID", "x.Lead_Source"),
    "Deal_Stage": ("", "d.Deal_Stage"),
    "Forecast_Category": ("", "d.Forecast_Category"),
}


def metric_sql(metric: str, dim: str, extra_where: str = "") -> str:
    join, dexpr = DIM_SOURCE[dim]
    where = f"{dexpr} IS NOT NULL {extra_where}"
    if metric == "pipeline" and dim != "Forecast_Category":
        where += " AND d.Forecast_Category = 'Pipeline'"
    if metric == "win_rate":
        return f"""
SELECT {dim}, Closed_Won, Closed_Lost, {RATIO('Closed_Won', 'Closed_Won + Closed_Lost')} * 100.0 AS Win_Rate
FROM (SELECT {dexpr} AS {dim},
             COUNT(*) FILTER (WHERE d.Deal_Stage = 'Closed Won') AS Closed_Won,
             COUNT(*) FILTER (WHERE d.Deal_Stage = 'Closed Lost') AS Closed_Lost
      FROM deals d {join}
      WHERE {where} AND d.Deal_Stage IN ('Closed Won','Closed Lost') GROUP BY 1)"""
    value = {
        "revenue": f"{MSUM('d.Amount')} AS Total_Amount",
        "pipeline": f"{MSUM('d.Amount')} AS Total_Amount",
        "deal_count": "COUNT(d.Deal_ID) AS Deal_Count",
        "average_deal_size": f"{MMEAN('d.Amount')} AS Average_Deal_Size",
        "margin": f"{MSUM('d.Margin')} AS Total_Margin",
    }[metric]
    return f"SELECT {dexpr} AS {dim}, {value} FROM deals d {join} WHERE {where} GROUP BY 1"


def _register_matrix():
    from revlens.plans.metrics import metric_keys
    for key, metric, dim in metric_keys():
        sql(key, metric_sql(metric, dim))


_register_matrix()


def _share(inner: str, value: str) -> str:
    return f"""
SELECT g.*, CASE WHEN t.total > 0 THEN CAST(g.{value} AS DOUBLE) / t.total * 100.0 END AS Share_Percentage
FROM ({inner}) g,
     (SELECT CAST(SUM(CAST({value} AS DECIMAL(38,6))) AS DOUBLE) AS total FROM ({inner})) t"""


sql("share_by_region", _share(metric_sql("revenue", "Region"), "Total_Amount"))
sql("composition_share", _share(metric_sql("deal_count", "Forecast_Category"), "Deal_Count"))
sql("top_n_regions", f"SELECT * FROM ({metric_sql('revenue', 'Region')}) "
                     "ORDER BY Total_Amount DESC, Region ASC LIMIT 3")
sql("bottom_n_categories", f"SELECT * FROM ({metric_sql('revenue', 'Product_Category')}) "
                           "ORDER BY Total_Amount ASC, Product_Category ASC LIMIT 3")
sql("top_accounts_share", f"SELECT * FROM ({_share(metric_sql('revenue', 'Account_Name'), 'Total_Amount')}) "
                          "ORDER BY Total_Amount DESC, Account_Name ASC LIMIT 10")
sql("margin_by_category_filtered", metric_sql("margin", "Product_Category",
                                              "AND lower(d.Deal_Stage) = 'closed won'"))

sql("win_rate_by_lead_region", f"""
SELECT Region, Closed_Won, Closed_Lost, {RATIO('Closed_Won', 'Closed_Won + Closed_Lost')} * 100.0 AS Win_Rate
FROM (SELECT l.Region,
             COUNT(*) FILTER (WHERE d.Deal_Stage = 'Closed Won') AS Closed_Won,
             COUNT(*) FILTER (WHERE d.Deal_Stage = 'Closed Lost') AS Closed_Lost
      FROM {DEALS_REGION_FROM_LEADS}
      WHERE l.Region IS NOT NULL AND d.Deal_Stage IN ('Closed Won','Closed Lost') GROUP BY 1)""")


# ----------------------------------------------------------------- ranking
def _compound(dim: str) -> str:
    join, dexpr = DIM_SOURCE[dim]
    grouped = (f"SELECT {dexpr} AS {dim}, {MSUM('d.Amount')} AS Total_Revenue, "
               f"{MMEAN('d.Amount')} AS Average_Deal_Size, COUNT(d.Deal_ID) AS Deal_Count "
               f"FROM deals d {join} WHERE {dexpr} IS NOT NULL GROUP BY 1")
    ranked = (f"SELECT *, DENSE_RANK() OVER (ORDER BY Total_Revenue DESC) AS Revenue_Rank, "
              f"DENSE_RANK() OVER (ORDER BY Average_Deal_Size DESC) AS Average_Deal_Size_Rank, "
              f"DENSE_RANK() OVER (ORDER BY Deal_Count DESC) AS Deal_Count_Rank FROM ({grouped})")
    scored = f"SELECT *, Revenue_Rank + Average_Deal_Size_Rank + Deal_Count_Rank AS Priority_Score FROM ({ranked})"
    return (f"SELECT {dim}, Total_Revenue, Average_Deal_Size, Deal_Count, Revenue_Rank, Average_Deal_Size_Rank, "
            f"Deal_Count_Rank, Priority_Score, DENSE_RANK() OVER (ORDER BY Priority_Score ASC) AS Priority_Rank "
            f"FROM ({scored})")


sql("compound_customer_type", _compound("Customer_Type"))
sql("compound_account", _compound("Account_Name"))
sql("priority_segment", f"SELECT * FROM ({_compound('Customer_Type')}) "
                        "ORDER BY Priority_Score ASC, Total_Revenue DESC, Customer_Type ASC LIMIT 1")

sql("top_source", f"""
SELECT Lead_Source, COUNT(Lead_ID) AS Lead_Count, {MSUM('Estimated_Value')} AS Total_Estimated_Value
FROM leads WHERE Lead_Source IS NOT NULL GROUP BY Lead_Source
ORDER BY Total_Estimated_Value DESC, Lead_Source ASC LIMIT 1""")

sql("top_rep_pipeline", f"""
SELECT l.Sales_Rep, {MSUM('d.Amount')} AS Pipeline_Amount
FROM (SELECT * FROM deals WHERE {OPEN}) d LEFT JOIN leads l ON d.Lead_ID = l.Lead_ID
WHERE l.Sales_Rep IS NOT NULL GROUP BY 1 ORDER BY Pipeline_Amount DESC, Sales_Rep ASC LIMIT 1""")

sql("top_product", f"""
SELECT p.Product_Category, COUNT(d.Deal_ID) AS Deal_Count, {MSUM('d.Amount')} AS Total_Amount
FROM deals d LEFT JOIN {PRODUCTS_DEDUP} p ON d.Product_ID = p.Product_ID
WHERE p.Product_Category IS NOT NULL GROUP BY 1 ORDER BY Total_Amount DESC, Product_Category ASC LIMIT 1""")

sql("top_region", f"""
SELECT Region, {MSUM('Estimated_Value')} AS Value FROM leads WHERE Region IS NOT NULL
GROUP BY 1 ORDER BY Value DESC, Region ASC LIMIT 1""")

sql("top_stage", f"""
SELECT Deal_Stage, COUNT(Deal_ID) AS Deal_Count, {MSUM('Amount')} AS Total_Amount
FROM deals WHERE Deal_Stage IS NOT NULL GROUP BY 1 ORDER BY Total_Amount DESC, Deal_Stage ASC LIMIT 1""")


def _top_deals(cat: str) -> str:
    return (f"SELECT Deal_ID, CAST(Amount AS DOUBLE) AS Amount FROM deals WHERE Forecast_Category = '{cat}' "
            "ORDER BY Amount DESC NULLS LAST, Deal_ID ASC LIMIT 10")


sql("top_at_risk_deals", _top_deals("At Risk"))
sql("top_commit_deals", _top_deals("Commit"))
sql("upcoming_closings", """
SELECT Deal_ID, strftime(Closing_Date, '%Y-%m-%d') AS Closing_Date, CAST(Amount AS DOUBLE) AS Amount
FROM deals WHERE Closing_Date IS NOT NULL
ORDER BY deals.Closing_Date ASC, Amount DESC NULLS LAST, Deal_ID ASC LIMIT 10""")


# ------------------------------------------------------------------ health
from revlens.sources.registry import DATE_COLUMNS, MODULES, PREFERRED_RELATIONSHIPS  # noqa: E402

# Columns of the stand-in views, in view order (fixed by oracle_views).
VIEW_COLUMNS = {
    "Leads": ("leads", ["Lead_ID", "Company_Name", "Lead_Source", "Industry", "Estimated_Value", "Sales_Rep",
                        "Region", "Customer_Type"]),
    "Deals": ("deals", ["Deal_ID", "Lead_ID", "Account_ID", "Product_ID", "Deal_Stage", "Amount", "Closing_Date",
                        "Forecast_Category", "Margin"]),
    "Accounts": ("accounts", ["Account_ID", "Account_Name", "Region", "Industry"]),
    "Products": ("products", ["Product_ID", "Product_Name", "Product_Category"]),
    "Vendors": ("vendors", ["Vendor_ID", "Vendor_Name", "Region"]),
    "Purchase Orders": ("purchase_orders", ["Purchase_Order_ID", "Vendor_ID", "Amount", "Status"]),
    "Activities": ("activities", ["Activity_ID", "Owner", "Status", "Due_Date"]),
}


def _registered(mod: str) -> list[str]:
    d = MODULES[mod]
    cols = VIEW_COLUMNS[mod][1]
    return [c for c in (*d.required, *d.optional) if c in cols]


def _profile_sql() -> str:
    parts = []
    for mod, (view, cols) in VIEW_COLUMNS.items():
        d = MODULES[mod]
        pcols = _registered(mod) + [c for c in DATE_COLUMNS if c in cols and c not in _registered(mod)]
        for i, c in enumerate(pcols):
            is_id = c == d.id_column
            dup = f"COUNT({c}) - COUNT(DISTINCT {c})" if is_id else "CAST(NULL AS BIGINT)"
            parts.append(
                f"SELECT '{mod}' AS Module, '{c}' AS Column_Name, {i} AS Position, COUNT(*) AS Row_Count, "
                f"COUNT(*) - COUNT({c}) AS Null_Count, "
                f"CAST(COUNT(*) - COUNT({c}) AS DOUBLE) / NULLIF(CAST(COUNT(*) AS DOUBLE), 0) AS Null_Ratio, "
                f"{'TRUE' if is_id else 'FALSE'} AS Is_Id, {dup} AS Duplicate_Count, "
                f"{'TRUE' if c in DATE_COLUMNS else 'FALSE'} AS Is_Date FROM {view}")
    return "\nUNION ALL\n".join(parts)


sql("quality_profile", _profile_sql())


def _module_warning_items(mod: str) -> list[str]:
    """SQL expressions (NULL when absent) for the module's warnings, in order."""
    view, cols = VIEW_COLUMNS[mod]
    d = MODULES[mod]
    items = []
    if d.id_column in cols:
        items.append(f"CASE WHEN COUNT({d.id_column}) - COUNT(DISTINCT {d.id_column}) > 0 THEN "
                     f"'{mod} has ' || CAST(COUNT({d.id_column}) - COUNT(DISTINCT {d.id_column}) AS VARCHAR) "
                     f"|| ' duplicate value(s) in {d.id_column}.' END")
    for c in _registered(mod):
        ratio = f"(CAST(COUNT(*) - COUNT({c}) AS DOUBLE) / NULLIF(CAST(COUNT(*) AS DOUBLE), 0))"
        items.append(f"CASE WHEN {ratio} >= 0.6 THEN '{mod}.{c} is ' || printf('%.0f', {ratio} * 100) "
                     f"|| '% empty.' END")
    for c in DATE_COLUMNS:
        if c in cols:
            items.append(f"CASE WHEN COUNT(*) - COUNT({c}) > 0 THEN '{mod}.{c} has ' || "
                         f"CAST(COUNT(*) - COUNT({c}) AS VARCHAR) || ' blank or unparseable date value(s).' END")
    return items


def _module_health_rows() -> str:
    parts = []
    for order, (mod, (view, cols)) in enumerate(VIEW_COLUMNS.items()):
        d = MODULES[mod]
        missing = sorted(set(d.required) - set(cols))
        items = _module_warning_items(mod)
        text = f"CASE WHEN COUNT(*) = 0 THEN '{mod} has no rows.' ELSE concat_ws(' | ', {', '.join(items)}) END"
        count = ("CASE WHEN COUNT(*) = 0 THEN 1 ELSE " + " + ".join(f"CAST(({i}) IS NOT NULL AS INTEGER)"
                                                                  for i in items) + " END") if items else "0"
        req_status = "Complete" if not missing else "Missing: " + ", ".join(missing)
        parts.append(
            f"SELECT {order} AS Module_Order, '{mod}' AS Module, COUNT(*) AS Rows, "
            f"'{', '.join(d.required)}' AS Required_Columns, '{req_status}' AS Required_Status, "
            f"CAST({count} AS INTEGER) AS Warning_Count, {text} AS Warnings FROM {view}")
    return "\nUNION ALL\n".join(parts)


_MH = f"""(SELECT *, CASE WHEN Required_Status <> 'Complete' OR Rows = 0 THEN 'Warning'
                     WHEN Warning_Count > 0 THEN 'Partial' ELSE 'Healthy' END AS Status
          FROM ({_module_health_rows()}))"""

sql("module_health", f"""
SELECT Module, Rows, Required_Columns, Required_Status, Status, Warning_Count, Warnings FROM {_MH}""")


def _join_rows() -> str:
    parts = []
    for order, (left, right, key) in enumerate(PREFERRED_RELATIONSHIPS):
        rel = f"'{left} ↔ {right}'"
        if left not in VIEW_COLUMNS or right not in VIEW_COLUMNS:
            msg = "One or both modules are not loaded."
            parts.append(f"SELECT {order} AS Relationship_Order, '{left}' AS Left_Module, '{right}' AS Right_Module, "
                         f"{rel} AS Relationship, '{key}' AS Join_Key, FALSE AS Available, '{msg}' AS Reason, "
                         f"CAST(NULL AS BIGINT) AS Rows_Checked, CAST(NULL AS BIGINT) AS Matched, "
                         f"CAST(NULL AS BIGINT) AS Unmatched, 'Not available' AS Status, '{msg}' AS Details")
            continue
        lv, rv = VIEW_COLUMNS[left][0], VIEW_COLUMNS[right][0]
        stats = (f"(SELECT (SELECT COUNT(*) FROM {lv}) AS lrows, (SELECT COUNT(*) FROM {rv}) AS rrows, "
                 f"(SELECT COUNT({key}) FROM {lv}) AS checked, "
                 f"(SELECT COUNT(*) FROM {lv} WHERE {key} IN (SELECT {key} FROM {rv} WHERE {key} IS NOT NULL)) AS matched, "
                 f"EXISTS (SELECT 1 FROM {rv} WHERE {key} IS NOT NULL GROUP BY {key} HAVING COUNT(*) > 1) AS dup)")
        avail = "(lrows > 0 AND rrows > 0 AND NOT dup)"
        reason = (f"CASE WHEN lrows = 0 OR rrows = 0 THEN 'Join key `{key}` exists but one module is empty.' "
                  f"WHEN dup THEN 'Join key `{key}` has duplicates on the lookup side.' "
                  f"ELSE 'Join key `{key}` is available.' END")
        status = ("CASE WHEN dup THEN 'Warning' WHEN checked = 0 THEN 'Warning' "
                  "WHEN checked - matched > 0 THEN 'Partial' ELSE 'Healthy' END")
        details = (f"CASE WHEN dup THEN 'Lookup-side {key} has duplicates.' "
                   f"WHEN checked = 0 THEN 'No non-empty {key} values are available to check.' "
                   f"WHEN checked - matched > 0 THEN CAST(checked - matched AS VARCHAR) || ' row(s) do not resolve to {right}.' "
                   f"ELSE 'All checked {key} values resolve to {right}.' END")
        parts.append(f"SELECT {order} AS Relationship_Order, '{left}' AS Left_Module, '{right}' AS Right_Module, "
                     f"{rel} AS Relationship, '{key}' AS Join_Key, {avail} AS Available, {reason} AS Reason, "
                     f"checked AS Rows_Checked, matched AS Matched, checked - matched AS Unmatched, "
                     f"CASE WHEN ({status}) = 'Healthy' AND NOT {avail} THEN 'Warning' ELSE {status} END AS Status, "
                     f"CASE WHEN ({status}) = 'Healthy' AND NOT {avail} THEN {reason} ELSE {details} END AS Details "
                     f"FROM {stats}")
    return "(" + "\nUNION ALL\n".join(parts) + ")"


_JH = _join_rows()

sql("join_coverage", f"""
SELECT Relationship, Join_Key, Rows_Checked, Matched, Unmatched, Status, Details FROM {_JH}""")
sql("relationships", f"SELECT Left_Module, Right_Module, Join_Key, Available, Reason FROM {_JH}")
sql("join_key_validation", f"""
SELECT Left_Module, Right_Module, Join_Key, Available, Reason FROM {_JH}
WHERE Left_Module = 'Deals' AND Right_Module = 'Accounts'""")

_AV = lambda l, r: (f"COALESCE((SELECT Available FROM {_JH} WHERE Left_Module = '{l}' "  # noqa: E731
                    f"AND Right_Module = '{r}'), FALSE)")
sql("capabilities", f"""
SELECT * FROM (VALUES
 ('Revenue', TRUE, 'Enabled', 'Available from Deals.'),
 ('Pipeline', TRUE, 'Enabled', 'Forecast_Category is required in Deals.'),
 ('Forecast', TRUE, 'Enabled', 'Forecast_Category missing from Deals.')) t(Capability, Available, Readiness, Details)
UNION ALL SELECT 'Customer Analysis', a, CASE WHEN a THEN 'Enabled' ELSE 'Disabled' END,
   'Needs Customer_Type in Leads or an Accounts join.'
   FROM (SELECT ({_AV('Deals', 'Leads')} OR {_AV('Deals', 'Accounts')}) AS a)
UNION ALL SELECT 'Product Analysis', a, CASE WHEN a THEN 'Enabled' ELSE 'Disabled' END,
   'Needs Product_Category in Deals or a valid Products join.' FROM (SELECT {_AV('Deals', 'Products')} AS a)
UNION ALL SELECT 'Regional Analysis', TRUE, 'Enabled', 'Needs Region in Deals, Leads, or Accounts.'
UNION ALL SELECT 'Lead Conversion', a, CASE WHEN a THEN 'Enabled' ELSE 'Disabled' END,
   'Lead_ID relationship between Deals and Leads is required.' FROM (SELECT {_AV('Deals', 'Leads')} AS a)""")


def _warning_union() -> str:
    parts = []
    for order, (mod, (view, cols)) in enumerate(VIEW_COLUMNS.items()):
        for p, item in enumerate(_module_warning_items(mod)):
            parts.append(f"SELECT {order} * 100000 + {p} AS o, {item} AS Warning FROM {view}")
    parts.append(f"SELECT (1000 + Relationship_Order) * 100000 AS o, "
                 f"Left_Module || ' ↔ ' || Right_Module || ': ' || Details AS Warning FROM {_JH} "
                 f"WHERE Status IN ('Partial', 'Warning')")
    return "\nUNION ALL\n".join(parts)


_WL = f"""(SELECT ROW_NUMBER() OVER (ORDER BY o) AS Position, Warning
          FROM (SELECT Warning, MIN(o) AS o FROM ({_warning_union()}) WHERE Warning IS NOT NULL GROUP BY Warning))"""
sql("warning_list", f"SELECT Position, Warning FROM {_WL}")

sql("health_summary", f"""
SELECT (SELECT COUNT(*) FROM {_MH}) AS Module_Count, (SELECT CAST(SUM(Rows) AS BIGINT) FROM {_MH}) AS Total_Rows,
       (SELECT COUNT(*) FROM (VALUES (1),(1),(1),(1),(1),(1),(1)) v(x)) AS Enabled_Capabilities,
       (SELECT COUNT(*) FROM {_WL}) AS Warning_Count""")


def _validation_rows() -> str:
    parts = []
    for mod, (view, cols) in VIEW_COLUMNS.items():
        d = MODULES[mod]
        missing = sorted(set(d.required) - set(cols))
        idc = d.id_column
        dup = (f"(COUNT(*) - COUNT({idc}) > 1 OR COUNT({idc}) > COUNT(DISTINCT {idc}))" if idc in cols else "FALSE")
        miss_txt = f"'{mod} is missing required columns: {', '.join(missing)}.'" if missing else "NULL"
        parts.append(f"SELECT '{mod}' AS Module, COUNT(*) AS Rows, concat_ws(' | ', "
                     f"CASE WHEN COUNT(*) = 0 THEN '{mod} is empty.' END, {miss_txt}, "
                     f"CASE WHEN {dup} THEN '{mod} contains duplicate IDs in {idc}.' END) AS Warnings, "
                     f"'{', '.join(missing)}' AS Missing_Required FROM {view}")
    return "\nUNION ALL\n".join(parts)


sql("module_validation", _validation_rows())

# ------------------------------------------------------------------ ingest
sql("ingest_deals_by_stage", f"""SELECT Deal_Stage, COUNT(Deal_ID) AS Deal_Count, {MSUM('Amount')} AS Total_Amount
FROM deals WHERE Deal_Stage IS NOT NULL GROUP BY Deal_Stage""")
sql("ingest_region_pipeline", f"""
SELECT l.Region, COUNT(d.Deal_ID) AS Deal_Count, {MSUM('d.Amount')} AS Total_Amount
FROM (SELECT * FROM deals WHERE {OPEN}) d LEFT JOIN leads l ON d.Lead_ID = l.Lead_ID
WHERE l.Region IS NOT NULL GROUP BY l.Region""")
sql("ingest_conversion", _CONVERSION)
sql("export_csv", f"""
SELECT Deal_Stage, COUNT(Deal_ID) AS Deal_Count, {MSUM('Amount')} AS Total_Amount
FROM deals WHERE Deal_Stage IS NOT NULL GROUP BY Deal_Stage""")
_DIAGNOSED = ("Deal_ID", "Lead_ID", "Account_ID", "Product_ID", "Deal_Stage", "Amount", "Closing_Date", "Forecast_Category", "Margin")


def _diagnosed(c: str) -> str:
    v = f"strftime({c}, '%Y-%m-%d')" if c == "Closing_Date" else f"CAST(CAST({c} AS DOUBLE) AS VARCHAR)" if c in ("Amount", "Margin") else f"CAST({c} AS VARCHAR)"
    return f"'\"{c}\":\"' || COALESCE({v}, '') || '\"'"


sql("module_diagnostics", f"""
SELECT 'Deals' AS Module, 'deals.csv' AS File_Name, n.n AS Row_Count, CAST(LEAST(n.n, 3) AS INTEGER) AS Sample_Count,
       '{','.join(_DIAGNOSED)}' AS Normalized_Columns, '' AS Missing_Required, CAST(s.p AS INTEGER) AS Sample_Position, s.t AS Sample_Row
FROM (SELECT COUNT(*) AS n FROM deals) n LEFT JOIN (
  SELECT t, ROW_NUMBER() OVER (ORDER BY t) - 1 AS p FROM (SELECT '{{' || {" || ',' || ".join(_diagnosed(c) for c in _DIAGNOSED)} || '}}' AS t FROM deals) ORDER BY t LIMIT 3) s ON TRUE""")


def _load_rows() -> str:
    def rows(module: str, file: str, table: str, columns: list[tuple[str, str, str | None]], unknown: tuple[str, ...] = ()) -> list[str]:
        return [f"SELECT '{module}' AS Module, '{file}' AS File_Name, {i} AS Position, '{o}' AS Original_Column, '{c}' AS Canonical_Column, {str(o != c).upper()} AS Renamed, "
                f"{str(o not in unknown).upper()} AS Known, COUNT(CASE WHEN {c if c != 'Line Of Work' else 'Industry'} IS NOT NULL{f' OR {bad}' if bad else ''} THEN 1 END) AS Filled, "
                f"COUNT(CASE WHEN {bad or 'FALSE'} THEN 1 END) AS Rejected, COUNT(*) AS Rows FROM {table}" for i, (o, c, bad) in enumerate(columns, 1)]
    deals = [("Deal Id", "Deal_ID", None), ("Lead_ID", "Lead_ID", None), ("Account ID", "Account_ID", None), ("Product ID", "Product_ID", None), ("Stage", "Deal_Stage", None),
             ("Deal Amount", "Amount", "Deal_ID % 41 = 0"), ("Close Date", "Closing_Date", "Deal_ID % 43 = 0"), ("Forecast", "Forecast_Category", None), ("Margin", "Margin", None)]
    leads = [("Lead Id", "Lead_ID", None), ("Company", "Company_Name", None), ("Lead Source", "Lead_Source", None), ("Line Of Work", "Line Of Work", None),
             ("Estimated Value", "Estimated_Value", "Lead_ID % 7 = 0"), ("Lead Owner", "Sales_Rep", None), ("Region", "Region", None), ("Customer Segment", "Customer_Type", None)]
    return " UNION ALL ".join(rows("Deals", "deals_export.csv", "deals", deals) + rows("Leads", "leads.csv", "leads", leads, ("Line Of Work",)))


sql("load_report", _load_rows())
sql("strict_deals", """
SELECT CAST(Deal_ID AS VARCHAR) AS Deal_ID, CAST(Lead_ID AS VARCHAR) AS Lead_ID, 'Company, No. ' || CAST(Account_ID AS VARCHAR) AS Company_Name, Deal_Stage,
       CAST(Amount AS DOUBLE) AS Amount, strftime(Closing_Date, '%Y-%m-%d') AS Closing_Date, Forecast_Category FROM deals""")
sql("strict_leads", """
SELECT CAST(Lead_ID AS VARCHAR) AS Lead_ID, Company_Name, Lead_Source, Industry, CAST(Estimated_Value AS DOUBLE) AS Estimated_Value,
       CASE WHEN Sales_Rep IS NULL THEN 'New' ELSE 'Assigned' END AS Status,
       strftime(DATE '2023-01-01' + CAST(Lead_ID % 365 AS INTEGER), '%Y-%m-%d') AS Created_Date, Sales_Rep FROM leads""")
sql("normalize_labels", r"""
SELECT Lead_ID,
       trim(regexp_replace(regexp_replace(lower(Industry), '[_\-]', ' ', 'g'), '\s+', ' ', 'g')) AS Industry_Label,
       trim(regexp_replace(regexp_replace(lower(Customer_Type), '[_\-]', ' ', 'g'), '\s+', ' ', 'g'))
         AS Customer_Type_Label
FROM leads""")


# ------------------------------------------------------ insights and documents
def COMPACT(x: str) -> str:
    return (f"(CASE WHEN ({x}) IS NULL OR isnan({x}) THEN 'N/A' "
            f"WHEN abs({x}) >= 1000000 THEN 'AED ' || format('{{:.2f}}', ({x}) / CAST(1000000 AS DOUBLE)) || 'M' "
            f"WHEN abs({x}) >= 1000 THEN 'AED ' || format('{{:.2f}}', ({x}) / CAST(1000 AS DOUBLE)) || 'K' "
            f"ELSE 'AED ' || format('{{:,.0f}}', {x}) END)")


_DX = f"""dx AS (
  SELECT d.*, a.Region, p.Product_Category FROM deals d
  LEFT JOIN (SELECT Account_ID, MIN(Region) AS Region FROM accounts WHERE Account_ID IS NOT NULL
             GROUP BY Account_ID) a ON d.Account_ID = a.Account_ID
  LEFT JOIN {PRODUCTS_DEDUP} p ON d.Product_ID = p.Product_ID),
k AS (
  SELECT COUNT(*) AS n,
         {MSUM('Amount', "Forecast_Category = 'Pipeline'")} AS pipe,
         COUNT(*) FILTER (WHERE Forecast_Category = 'Pipeline') AS npipe,
         {MSUM('Amount', "Forecast_Category = 'Commit'")} AS cmt,
         {MSUM('Amount', "Forecast_Category = 'At Risk'")} AS risk,
         {MSUM('Amount', "Deal_Stage = 'Closed Won'")} AS wonamt,
         COUNT(*) FILTER (WHERE Deal_Stage = 'Closed Won') AS won,
         COUNT(*) FILTER (WHERE Deal_Stage = 'Closed Lost') AS lost,
         {MMEAN('Amount')} AS avgamt
  FROM dx),
kw AS (SELECT *, CAST(won AS DOUBLE) / NULLIF(CAST(won + lost AS DOUBLE), 0) * 100.0 AS wr FROM k),
rep AS (
  SELECT COALESCE(a.Sales_Rep, b.Sales_Rep) AS Sales_Rep, COALESCE(b.Deal_Count, 0) AS Deal_Count,
         COALESCE(b.Total_Deal_Amount, 0.0) AS Total_Deal_Amount,
         COALESCE(a.Total_Estimated_Value, 0.0) AS Total_Estimated_Value
  FROM (SELECT Sales_Rep, {MSUM('Estimated_Value')} AS Total_Estimated_Value FROM leads
        WHERE Sales_Rep IS NOT NULL GROUP BY 1) a
  FULL OUTER JOIN (SELECT l.Sales_Rep, COUNT(d.Deal_ID) AS Deal_Count, {MSUM('d.Amount')} AS Total_Deal_Amount
                   FROM dx d LEFT JOIN leads l ON d.Lead_ID = l.Lead_ID WHERE l.Sales_Rep IS NOT NULL GROUP BY 1) b
  ON a.Sales_Rep = b.Sales_Rep
  ORDER BY Total_Deal_Amount DESC, Total_Estimated_Value DESC, Sales_Rep ASC LIMIT 1),
prod AS (SELECT Product_Category, {MSUM('Amount')} AS Total_Amount FROM dx WHERE Product_Category IS NOT NULL
         GROUP BY 1 ORDER BY Total_Amount DESC, Product_Category ASC LIMIT 1),
src AS (SELECT Lead_Source, COUNT(Lead_ID) AS Lead_Count, {MSUM('Estimated_Value')} AS Total_Estimated_Value
        FROM leads WHERE Lead_Source IS NOT NULL GROUP BY 1
        ORDER BY Total_Estimated_Value DESC, Lead_Source ASC LIMIT 1),
reg AS (SELECT Region, {MSUM('Amount')} AS Total_Amount FROM dx WHERE Region IS NOT NULL GROUP BY 1
        ORDER BY Total_Amount DESC, Region ASC LIMIT 1),
stg AS (SELECT Deal_Stage, COUNT(Deal_ID) AS Deal_Count, {MSUM('Amount')} AS Total_Amount FROM dx
        WHERE Deal_Stage IS NOT NULL GROUP BY 1 ORDER BY Total_Amount DESC, Deal_Stage ASC LIMIT 1),
focus AS (SELECT * FROM (SELECT o, label, v, act FROM kw, (VALUES
            (0, 'at-risk pipeline', 'Review at-risk deals with account owners.'),
            (1, 'open pipeline', 'Prioritize follow-ups on open pipeline deals.'),
            (2, 'committed forecast', 'Confirm fulfillment plans for committed deals.'),
            (3, 'closed won revenue', 'Ensure invoicing and delivery for won deals.')) t(o, label, act),
          LATERAL (SELECT CASE o WHEN 0 THEN risk WHEN 1 THEN pipe WHEN 2 THEN cmt ELSE wonamt END AS v))
          WHERE v > 0 ORDER BY v DESC, o ASC LIMIT 1)"""

_INSIGHTS = f"""
WITH {_DX}
SELECT 0 AS Insight_Order, 'Total Open Pipeline Value' AS title, {COMPACT('pipe')} AS metric,
       CAST(npipe AS VARCHAR) || ' deal(s) are tagged as Pipeline with a combined amount of ' || {COMPACT('pipe')} || '.'
         AS explanation,
       CASE WHEN pipe > 0 THEN 'Review open pipeline deals and confirm next steps with sales reps.'
            ELSE 'No pipeline-tagged deals are currently recorded.' END AS recommended_action FROM kw
UNION ALL SELECT 1, 'Committed Forecast Value', {COMPACT('cmt')},
       'Deals in the Commit forecast category total ' || {COMPACT('cmt')} || '.',
       CASE WHEN cmt > 0 THEN 'Validate delivery capacity and stock for committed deals.'
            ELSE 'No committed forecast deals are currently recorded.' END FROM kw
UNION ALL SELECT 2, 'Closed Won Revenue', {COMPACT('wonamt')},
       'Closed Won deals contribute ' || {COMPACT('wonamt')} || ' in recorded revenue.',
       CASE WHEN wonamt > 0 THEN 'Track fulfillment and invoicing for won deals.'
            ELSE 'No Closed Won revenue is recorded yet.' END FROM kw
UNION ALL SELECT 3, 'At-Risk Pipeline Value', {COMPACT('risk')},
       'Deals marked At Risk total ' || {COMPACT('risk')} || '.',
       CASE WHEN risk > 0 THEN 'Prioritize follow-up on at-risk deals before forecast slips.'
            ELSE 'No at-risk deals are currently flagged.' END FROM kw
UNION ALL SELECT 4, 'Average Deal Size', {COMPACT('avgamt')},
       'The average deal amount across ' || CAST(n AS VARCHAR) || ' deal(s) is ' || {COMPACT('avgamt')} || '.',
       'Use average deal size to benchmark new quotations.' FROM kw
UNION ALL SELECT 5, 'Win Rate', format('{{:.1f}}', wr) || '%',
       CAST(won AS VARCHAR) || ' deal(s) were Closed Won and ' || CAST(lost AS VARCHAR) || ' deal(s) were Closed Lost.',
       CASE WHEN wr < 50 THEN 'Review lost deals to identify recurring blockers.'
            ELSE 'Maintain current sales practices that are converting deals.' END FROM kw
UNION ALL SELECT 6, 'Top Sales Rep by Deal Amount', {COMPACT('Total_Deal_Amount')},
       Sales_Rep || ' has the highest total deal amount at ' || {COMPACT('Total_Deal_Amount')} || ' across '
         || CAST(Deal_Count AS VARCHAR) || ' deal(s).',
       'Review ' || Sales_Rep || '''s pipeline to replicate successful deal patterns.' FROM rep
UNION ALL SELECT 7, 'Top Product Category', {COMPACT('Total_Amount')},
       Product_Category || ' leads product revenue with ' || {COMPACT('Total_Amount')} || ' in deal amount.',
       'Ensure inventory and pricing support demand for ' || Product_Category || '.' FROM prod
UNION ALL SELECT 8, 'Top Lead Source by Estimated Value', {COMPACT('Total_Estimated_Value')},
       Lead_Source || ' generated ' || CAST(Lead_Count AS VARCHAR) || ' lead(s) with estimated value of '
         || {COMPACT('Total_Estimated_Value')} || '.',
       'Invest more in ' || Lead_Source || ' if lead quality remains strong.' FROM src
UNION ALL SELECT 9, 'Top Region by Deal Amount', {COMPACT('Total_Amount')},
       Region || ' has the highest deal amount at ' || {COMPACT('Total_Amount')} || '.',
       'Align sales coverage and logistics for ' || Region || '.' FROM reg
UNION ALL SELECT 10, 'Deals by Stage Summary', Deal_Stage || ' (' || CAST(Deal_Count AS VARCHAR) || ' deals)',
       'The largest stage by amount is ' || Deal_Stage || ' with ' || {COMPACT('Total_Amount')} || ' across '
         || CAST(Deal_Count AS VARCHAR) || ' deal(s).',
       'Focus coaching on advancing deals out of ' || Deal_Stage || '.' FROM stg
UNION ALL SELECT 11, 'Management Focus Recommendation', {COMPACT('v')},
       'The largest current value area is ' || label || ' at ' || {COMPACT('v')} || '.', act FROM focus"""

sql("auto_insights", _INSIGHTS)

sql("management_focus", f"""
WITH {_DX}
SELECT {COMPACT('v')} AS metric, 'The largest current value area is ' || label || ' at ' || {COMPACT('v')} || '.'
       AS explanation, act AS recommended_action FROM focus""")


# ------------------------------------------------------------- retrieval
sql("vector_top_k", """
WITH q AS (SELECT label AS query_id, arg_min(embedding, vec_id) AS qv FROM embeddings GROUP BY label),
dist AS (
  SELECT q.query_id, e.vec_id, e.label,
         list_reduce(list_transform(list_zip(e.embedding, q.qv),
                     lambda p: (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)) * (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE))),
                     lambda a, b: a + b) AS distance
  FROM embeddings e, q)
SELECT query_id, rank, vec_id, label, distance FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY distance ASC NULLS LAST, vec_id ASC) AS rank FROM dist)
WHERE rank <= 5""")

sql("vector_neighbours", """
WITH q AS (SELECT vec_id AS query_id, embedding AS qv FROM embeddings WHERE vec_id % 50 = 0),
dist AS (
  SELECT q.query_id, e.vec_id,
         list_reduce(list_transform(list_zip(e.embedding, q.qv),
                     lambda p: (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)) * (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE))),
                     lambda a, b: a + b) AS distance
  FROM embeddings e, q)
SELECT query_id, rank, vec_id, distance FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY distance ASC NULLS LAST, vec_id ASC) AS rank FROM dist)
WHERE rank <= 5""")


# ------------------------------------------------------------------ charts
sql("chart_data_pipeline_by_rep", f"""
SELECT l.Sales_Rep, {MSUM('d.Amount')} AS Value
FROM deals d LEFT JOIN leads l ON d.Lead_ID = l.Lead_ID
WHERE d.Forecast_Category = 'Pipeline' AND l.Sales_Rep IS NOT NULL GROUP BY 1""")

sql("chart_data_monthly_pipeline", f"""
SELECT strftime(date_trunc('month', Closing_Date), '%Y-%m') AS Closing_Date, {MSUM('Amount')} AS Value
FROM deals WHERE Forecast_Category = 'Pipeline' AND Closing_Date IS NOT NULL GROUP BY 1""")

sql("chart_data_leads_by_source", """
SELECT Lead_Source, CAST(COUNT(Lead_ID) AS DOUBLE) AS Value FROM leads WHERE Lead_Source IS NOT NULL GROUP BY 1""")

sql("chart_explanation", f"""
SELECT 'Pipeline by Sales Rep' AS title,
       Sales_Rep || ' is currently the leading segment at ' || {COMPACT('Value')} || '.' AS explanation,
       'Review what is driving performance in ' || Sales_Rep || ' and decide whether to replicate it elsewhere.'
         AS recommended_action
FROM (SELECT l.Sales_Rep, {MSUM('d.Amount')} AS Value
      FROM deals d LEFT JOIN leads l ON d.Lead_ID = l.Lead_ID
      WHERE d.Forecast_Category = 'Pipeline' AND l.Sales_Rep IS NOT NULL GROUP BY 1
      ORDER BY Value DESC, Sales_Rep ASC LIMIT 1)""")

sql("chart_explanation_monthly", f"""
SELECT 'Pipeline by Month of Closing Date' AS title,
       'The monthly trend peaks in ' || m || ' at ' || {COMPACT('Value')} || '.' AS explanation,
       'Review what is driving performance in ' || m || ' and decide whether to replicate it elsewhere.'
         AS recommended_action
FROM (SELECT strftime(date_trunc('month', Closing_Date), '%Y-%m') AS m, {MSUM('Amount')} AS Value
      FROM deals WHERE Forecast_Category = 'Pipeline' AND Closing_Date IS NOT NULL GROUP BY 1
      ORDER BY Value DESC, m ASC LIMIT 1)""")

sql("safe_preview", """
SELECT Deal_Stage, CAST(Amount AS DOUBLE) AS Amount, strftime(Closing_Date, '%Y-%m-%d') AS Closing_Date,
       Forecast_Category, CAST(Margin AS DOUBLE) AS Margin FROM deals""")

sql("date_labels", """
SELECT Deal_ID, strftime(Closing_Date, '%b %Y') AS Month_Label, strftime(Closing_Date, '%Y-%m') AS Month_Key,
       strftime(Closing_Date, '%d %b %Y') AS Day_Label FROM deals""")

def _answer(title: str, question: str, source: str, answer: str, action: str, kind: tuple[str, str, str], body: str | None, order: str,
            cells: list[tuple[str, str]], notes: list[tuple[str, str]], main: str | None = None, period: str | None = None, chart: str | None = None,
            x: str = "NULL", y: str = "NULL") -> str:
    """Context rows of one answer; ``n`` is the number of preview rows, ``answer``, ``main``, ``x``, ``y`` and the notes are SQL."""
    top = f"SELECT *, ROW_NUMBER() OVER (ORDER BY {order}) AS p FROM ({body}) ORDER BY p LIMIT 5" if body else "SELECT 1 AS p WHERE FALSE"
    text = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'"
    fields = [("original_user_question", text(question)), ("answer_source", text(source)), ("computed_answer", answer), ("recommended_action", text(action)),
              ("currency", "'AED'"), ("metric_type", text(kind[0])), ("business_object", text(kind[1])), ("main_entity", text(kind[2])), ("main_value", main or answer),
              ("time_period", text(period)), ("chart_type", text(chart)), ("chart_title", text(title)), ("x_axis", x), ("y_axis", y)]
    rows = [f"SELECT 'context' AS Part, {i} AS Position, '{f}' AS Field, CAST({v} AS VARCHAR) AS Value FROM c" for i, (f, v) in enumerate(fields, 1)]
    rows += [f"SELECT 'preview', CAST(p AS INTEGER), '{f}', {v} FROM top" for f, v in cells]
    rows += [f"SELECT 'observation', {i}, NULL, {v} FROM c WHERE {cond}" for i, (cond, v) in enumerate(notes, 1)]
    rows.append("SELECT 'limitation', 1, NULL, 'No supporting table preview is available for this result.' FROM c WHERE n = 0")
    return (f"(WITH top AS ({top}), c AS (SELECT COUNT(*) AS n FROM top) SELECT {text(title)} AS Title, Part, Position, Field, Value FROM ("
            + " UNION ALL ".join(rows) + "))")


def _answers() -> str:
    num = lambda c: (c, f"format('{{:.4f}}', {c})")
    whole = lambda c: (c, f"CAST({c} AS VARCHAR)")
    trend = BODIES["monthly_pipeline_trend"]
    peak = f"(SELECT {{f}} FROM ({trend}) ORDER BY Total_Amount DESC, Period_Start LIMIT 1)"
    parts = [
        _answer("Monthly Pipeline Trend", "How does the pipeline develop?", "metric calculation", "'The pipeline by closing month.'", "Review months without deals.",
                ("monthly_pipeline_trend", "pipeline trend", "closing month"), trend, "Period_Start", [whole("Closing_Month"), num("Total_Amount")],
                [("TRUE", "'Monthly trend is grouped by Closing_Date month.'"), ("TRUE", "'Missing months are filled with AED 0.'"),
                 ("n > 0", "'Highest month is ' || " + peak.format(f="Closing_Month") + " || '.'")],
                "CASE WHEN n = 0 THEN 'The pipeline by closing month.' ELSE " + peak.format(f="Closing_Month || ' at AED ' || format('{:,.0f}', Total_Amount)") + " END",
                "monthly", "line_chart", "'Closing Month'", "'Total Amount (AED)'"),
        _answer("Weak Forecasts", "Which category has the weakest forecast?", "forecast quality analysis", "'Categories by weak share.'", "",
                ("forecast_quality", "forecast quality", "product category"), BODIES["forecast_quality"], "Weak_Forecast_Ratio DESC, Weak_Forecast_Amount DESC, Product_Category",
                [whole("Product_Category"), num("Weak_Forecast_Amount"), num("Strong_Forecast_Amount"), num("Weak_Forecast_Ratio")],
                [("TRUE", "'Weak forecast = At Risk + Omitted + Pipeline.'"), ("TRUE", "'Strong forecast = Commit + Closed + Best Case.'")]),
        _answer("Lead Source Conversion", "Which sources convert?", "metric calculation", "'Sources by value.'", "", ("lead_source_conversion", "lead conversion", "lead source"),
                _CONVERSION, "Estimated_Value DESC, Conversion_Rate, Lead_Source",
                [whole("Lead_Source"), whole("Total_Leads"), whole("Converted_Leads"), num("Conversion_Rate"), num("Estimated_Value")],
                [("TRUE", "'Conversion uses Lead_ID match between leads and deals.'"),
                 ("n > 0", "'Lead sources are sorted by Estimated Value descending, then Conversion Rate ascending.'")]),
        _answer("Where Deals Are", "Where are the deals?", "metric calculation", "''", "", ("deal_stage_breakdown", "deal stage performance", "deal stage"),
                BODIES["deals_by_stage"], "Total_Amount DESC, Deal_Stage", [whole("Deal_Stage"), whole("Deal_Count"), num("Total_Amount")],
                [("TRUE", "'Deal stages are grouped from the Deal_Stage field.'")], chart="bar", y="'Value'"),
        _answer("Sales Rep Performance", "Who sells most?", "metric calculation", "''", "", ("sales_rep_performance", "sales performance", "sales rep"),
                BODIES["sales_rep_performance"], "Total_Deal_Amount DESC, Total_Estimated_Value DESC, Sales_Rep", [whole("Sales_Rep"), num("Total_Deal_Amount"), whole("Deal_Count")],
                [("TRUE", "'Sales rep performance is grouped by Sales_Rep and summed by Amount.'")]),
        _answer("Total Pipeline Value", "How large is the pipeline?", "metric calculation", f"(SELECT {COMPACT('Total_Pipeline_Amount')} FROM ({BODIES['total_pipeline']}))", "",
                ("total_pipeline_value", "pipeline value", "pipeline"), None, "", [], [("TRUE", "'Pipeline totals come from the Amount column.'")], chart="no_chart"),
        _answer("Revenue by Region", "What is revenue by region?", "metric calculation", "''", "", ("general_revenue_insight", "revenue operations", "Revenue by Region"),
                metric_sql("revenue", "Region"), "Total_Amount DESC, Region", [whole("Region"), num("Total_Amount")], [], chart="bar", x="'Region'", y="'Total Amount'"),
        _answer("Sources below Average", "Which sources are below average?", "metric calculation", "'None.'", "",
                ("general_revenue_insight", "revenue operations", "Sources below Average"), None, "", [], [], chart="line", x="'Lead Source'", y="'Conversion Rate'"),
    ]
    return " UNION ALL ".join(f"SELECT * FROM {p}" for p in parts)


sql("answer_rows", _answers())


# --------------------------------------------------------- question log (K)
from revlens.plans import oracle_text  # noqa: E402

oracle_text.register(sql)


# ------------------------------------------------------------- documents
def FIXED1(x: str) -> str:
    return f"format('{{:.1f}}', {x})"


def _doc_row(order: int, doc_id: str, text: str, source_type: str, module: str, topic: str, frm: str) -> str:
    return (f"SELECT {doc_id} AS id, {text} AS text, '{source_type}' AS source_type, '{module}' AS module, "
            f"{topic} AS topic, 'system' AS created_by, CAST({order} AS BIGINT) AS Doc_Order FROM {frm}")


def _summary_docs_parts() -> tuple[str, list[str]]:
    conv = f"(SELECT * FROM ({_CONVERSION}) ORDER BY Estimated_Value DESC, Conversion_Rate ASC, Lead_Source ASC LIMIT 1)"
    weak = "Forecast_Category IN ('At Risk','Omitted','Pipeline')"
    pipe_trend = _trend("AND Forecast_Category = 'Pipeline'").replace('FROM deals', 'FROM dx')
    fq = (f"(SELECT Product_Category, w, {RATIO('w', 'tot')} AS r FROM "
          f"(SELECT Product_Category, {MSUM('Amount', weak)} AS w, "
          f"{MSUM('Amount')} AS tot FROM dx WHERE Product_Category IS NOT NULL GROUP BY 1) "
          f"ORDER BY r DESC, w DESC, Product_Category ASC LIMIT 1)")
    fc = (f"(SELECT string_agg(Forecast_Category || ' is ' || {COMPACT('Total_Amount')}, '; ' "
          f"ORDER BY Total_Amount DESC, Forecast_Category ASC) AS t, COUNT(*) AS n FROM "
          f"(SELECT Forecast_Category, {MSUM('Amount')} AS Total_Amount FROM dx WHERE Forecast_Category IS NOT NULL "
          f"GROUP BY 1 ORDER BY Total_Amount DESC, Forecast_Category ASC LIMIT 6))")
    prod = (f"(SELECT Product_Category, {MSUM('Amount')} AS Total_Amount FROM dx WHERE Product_Category IS NOT NULL "
            f"GROUP BY 1 ORDER BY Total_Amount DESC, Product_Category ASC LIMIT 1)")
    regp = (f"(SELECT Region, {MSUM('Amount')} AS Total_Amount FROM dx WHERE {OPEN} AND Region IS NOT NULL "
            f"GROUP BY 1 ORDER BY Total_Amount DESC, Region ASC LIMIT 1)")
    peak = (f"(SELECT * FROM ({pipe_trend}) "
            f"ORDER BY Total_Amount DESC, Period_Start ASC LIMIT 1)")

    def top_deals(cat: str) -> str:
        return (f"(SELECT string_agg(CAST(Deal_ID AS VARCHAR) || ' at ' || {COMPACT('a')}, '; ' "
                f"ORDER BY a DESC NULLS LAST, Deal_ID ASC) AS t, COUNT(*) AS n FROM "
                f"(SELECT Deal_ID, CAST(Amount AS DOUBLE) AS a FROM dx WHERE Forecast_Category = '{cat}' "
                f"ORDER BY a DESC NULLS LAST, Deal_ID ASC LIMIT 10))")
    upcoming = (f"(SELECT string_agg(CAST(Deal_ID AS VARCHAR) || ' closing on ' || strftime(Closing_Date, '%d %b %Y') "
                f"|| ' at ' || {COMPACT('a')}, '; ' ORDER BY Closing_Date ASC, a DESC NULLS LAST, Deal_ID ASC) AS t, "
                f"COUNT(*) AS n FROM (SELECT Deal_ID, Closing_Date, CAST(Amount AS DOUBLE) AS a FROM dx "
                f"WHERE Closing_Date IS NOT NULL ORDER BY Closing_Date ASC, a DESC NULLS LAST, Deal_ID ASC LIMIT 10))")
    ins = _INSIGHTS.strip()[len("WITH "):].split("\nSELECT 0 AS Insight_Order", 1)
    ins_body = "SELECT 0 AS Insight_Order" + ins[1]
    rows = [
        _doc_row(0, "'summary_top_lead_source'",
                 f"'Best lead source by estimated value: ' || Lead_Source || ' at ' "
                 f"|| {COMPACT('Total_Estimated_Value')} || '.'",
                 "business_summary", "summaries", "'lead_source'", "src"),
        _doc_row(1, "'summary_forecast'",
                 "'Amount by forecast category: ' || t || '.'",
                 "business_summary", "summaries", "'forecast'", f"{fc} WHERE n > 0"),
        _doc_row(2, "'summary_sales_rep'",
                 f"'Largest deal amount by sales rep: ' || Sales_Rep || ' with ' || "
                 f"{COMPACT('Total_Deal_Amount')} || '.'",
                 "business_summary", "summaries", "'sales_rep'", "rep"),
        _doc_row(3, "'summary_top_product'",
                 f"'Largest product category by revenue: ' || Product_Category || ' at ' || {COMPACT('Total_Amount')} "
                 f"|| '.'",
                 "business_summary", "summaries", "'product_category'", prod),
        _doc_row(4, "'summary_region_pipeline'",
                 f"'Largest region by open pipeline: ' || Region || ' at ' || "
                 f"{COMPACT('Total_Amount')} || '.'",
                 "business_summary", "summaries", "'region_pipeline'", regp),
        _doc_row(5, "'summary_lead_conversion'",
                 f"'First lead source by conversion: ' || Lead_Source || ' has ' || {COMPACT('Estimated_Value')} || "
                 f"' of estimated value and converts ' || {FIXED1('Conversion_Rate * 100.0')} || "
                 f"'% of its leads.'",
                 "business_summary", "summaries", "'lead_conversion'", conv),
        _doc_row(6, "'summary_forecast_quality'",
                 f"'Weakest forecast by product category: ' || Product_Category || ' with ' "
                 f"|| {COMPACT('w')} || ' in weak categories, ' || {FIXED1('r * 100.0')} || "
                 f"'% of its total.'",
                 "business_summary", "summaries", "'forecast_quality'", fq),
        _doc_row(7, "'summary_monthly_pipeline_trend'",
                 f"'Month with the most pipeline: ' || Closing_Month || ' at ' "
                 f"|| {COMPACT('Total_Amount')} || '. Months without deals count as zero.'",
                 "business_summary", "summaries", "'monthly_pipeline_trend'", peak),
        ("SELECT 'auto_insight_' || CAST(DENSE_RANK() OVER (ORDER BY Insight_Order) - 1 AS VARCHAR) AS id, "
         "'Auto Insight: ' || title || '. Metric: ' || metric || '. Explanation: ' || explanation || "
         "' Recommended action: ' || recommended_action AS text, 'auto_insight' AS source_type, "
         "'auto_insights' AS module, title AS topic, 'system' AS created_by, "
         "CAST(100 + Insight_Order AS BIGINT) AS Doc_Order FROM ins"),
        _doc_row(200, "'summary_high_risk_deals'", "'Top high-value At Risk deals: ' || t", "deal_summary", "risk",
                 "'at_risk_deals'", f"{top_deals('At Risk')} WHERE n > 0"),
        _doc_row(201, "'summary_commit_deals'", "'Top Commit deals: ' || t", "deal_summary", "forecast",
                 "'commit_deals'", f"{top_deals('Commit')} WHERE n > 0"),
        _doc_row(202, "'summary_upcoming_closings'", "'Top upcoming closing deals: ' || t", "deal_summary",
                 "closing_date", "'upcoming_closings'", f"{upcoming} WHERE n > 0"),
    ]
    return f"{ins[0]}, ins AS ({ins_body})", rows


def _summary_docs_sql() -> str:
    ctes, rows = _summary_docs_parts()
    return f"WITH {ctes}\n" + "\nUNION ALL\n".join(rows)


sql("summary_documents", _summary_docs_sql())


def _static_docs_sql() -> str:
    from revlens.operators import documents as D

    def q(v: str) -> str:
        return "'" + v.replace("'", "''") + "'"
    rows = []
    for doc_id, source_type, topic, text in D.SCHEMA_DOCUMENTS:
        rows.append((doc_id, text, source_type, "schema", topic))
    for cat, d in D.FORECAST_CATEGORY_DEFINITIONS.items():
        rows.append((f"forecast_{cat.lower().replace(' ', '_')}", f"{cat}: {d}", "forecast_definition", "forecast", cat))
    for st, d in D.DEAL_STAGE_DEFINITIONS.items():
        rows.append((f"deal_stage_{st.lower().replace(' ', '_')}", f"{st}: {d}", "deal_stage_definition",
                     "deal_stage", st))
    for mt, d in D.METRIC_DEFINITIONS.items():
        rows.append((f"metric_{mt.lower().replace(' ', '_')}", f"{mt}: {d}", "metric_definition", "metrics", mt))
    vals = ", ".join(f"({q(a)}, {q(b)}, {q(c)}, {q(d_)}, {q(e)})" for a, b, c, d_, e in rows)
    return (f"SELECT id, text, source_type, module, topic, 'system' AS created_by, CAST(-1 AS BIGINT) AS Doc_Order "
            f"FROM (VALUES {vals}) t(id, text, source_type, module, topic)")


def _rag_sql() -> str:
    ctes, rows = _summary_docs_parts()
    return f"WITH {ctes}\n{_static_docs_sql()}\nUNION ALL\n" + "\nUNION ALL\n".join(rows)


sql("rag_documents", _rag_sql())


sql("scan_deals", """
SELECT Deal_ID, Lead_ID, Deal_Stage, CAST(Amount AS DOUBLE) AS Amount,
       strftime(Closing_Date, '%Y-%m-%d') AS Closing_Date, Forecast_Category, CAST(Margin AS DOUBLE) AS Margin
FROM deals""")
sql("scan_leads", """
SELECT Lead_ID, Lead_Source, CAST(Estimated_Value AS DOUBLE) AS Estimated_Value, Sales_Rep, Region, Customer_Type
FROM leads""")


sql("context_text", """
WITH q AS (SELECT label AS query_id, arg_min(embedding, vec_id) AS qv FROM embeddings GROUP BY label),
dist AS (
  SELECT q.query_id, e.vec_id, e.label,
         list_reduce(list_transform(list_zip(e.embedding, q.qv),
                     lambda p: (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)) * (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE))),
                     lambda a, b: a + b) AS distance
  FROM embeddings e, q),
top AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY distance ASC NULLS LAST, vec_id ASC)
                       AS rank FROM dist) WHERE rank <= 5)
SELECT query_id, string_agg('[Context ' || CAST(rank AS VARCHAR) || '] (embedding | label ' || CAST(label AS VARCHAR)
                            || ') vector ' || CAST(vec_id AS VARCHAR), chr(10) ORDER BY rank) AS context
FROM top GROUP BY query_id""")


sql("number_formats", f"""
WITH g AS (SELECT Deal_Stage, {MSUM('Amount')} AS v FROM deals WHERE Deal_Stage IS NOT NULL GROUP BY 1),
t AS (SELECT CAST(SUM(CAST(v AS DECIMAL(38,6))) AS DOUBLE) AS tot FROM g)
SELECT Deal_Stage, {COMPACT('v')} AS Compact, 'AED ' || format('{{:,.0f}}', v) AS Full,
       format('{{:,.1f}}', v / tot * 100.0) || '%' AS Share_Text
FROM g, t""")


sql("canonicalize_headers", """
SELECT CAST(Deal_ID AS VARCHAR) AS Deal_ID, CAST(Lead_ID AS VARCHAR) AS Lead_ID, Deal_Stage,
       CAST(Amount AS DOUBLE) AS Amount, strftime(Closing_Date, '%Y-%m-%d') AS Closing_Date, Forecast_Category
FROM deals""")
sql("coerce_types", """
SELECT CAST(Lead_ID AS VARCHAR) AS Lead_ID, Sales_Rep, Customer_Type,
       CAST(Estimated_Value AS DOUBLE) AS Estimated_Value FROM leads""")
sql("filter_exact", """
SELECT Deal_ID, Forecast_Category, Deal_Stage, CAST(Amount AS DOUBLE) AS Amount FROM deals
WHERE Forecast_Category = 'Pipeline' AND Deal_Stage = 'Negotiation'""")


def _token_overlap_sql() -> str:
    from revlens.functions import vocab as V
    stop = ", ".join("'" + w + "'" for w in sorted(V.TOKEN_STOP_WORDS))

    def toks(x: str) -> str:
        return (f"list_distinct(list_filter(regexp_extract_all(lower({x}), '[a-z0-9]+'), "
                f"lambda t: length(t) > 1 AND NOT list_contains([{stop}], t)))")
    prior = oracle_text.PRIOR
    ctx = toks("COALESCE(prior_result, '')")
    shared = f"list_sort(list_intersect({toks('text')}, {ctx}))"
    return (f"SELECT conv_id, turn, CAST(len(s) AS INTEGER) AS shared_tokens, array_to_string(s, ' ') AS shared "
            f"FROM (SELECT conv_id, turn, {shared} AS s FROM {prior})")


sql("token_overlap", _token_overlap_sql())


sql("deals_by_stage_1998", f"""
SELECT Deal_Stage, COUNT(Deal_ID) AS Deal_Count, {MSUM('Amount')} AS Total_Amount
FROM deals WHERE Deal_Stage IS NOT NULL AND year(Closing_Date) = 1998 GROUP BY Deal_Stage""")


def _signature_sql() -> str:
    views = {
        "Leads": ("leads", "Lead_ID Company_Name Lead_Source Industry Estimated_Value Sales_Rep Region Customer_Type"),
        "Deals": ("deals", "Deal_ID Lead_ID Account_ID Product_ID Deal_Stage Amount Closing_Date Forecast_Category Margin"),
        "Accounts": ("accounts", "Account_ID Account_Name Region Industry"),
        "Products": ("products", "Product_ID Product_Name Product_Category"),
        "Vendors": ("vendors", "Vendor_ID Vendor_Name Region"),
        "Purchase Orders": ("purchase_orders", "Purchase_Order_ID Vendor_ID Amount Status"),
        "Activities": ("activities", "Activity_ID Owner Status Due_Date"),
    }

    def text(c: str, kind: str) -> str:
        if kind == "date":
            c = f"strftime({c}, '%Y-%m-%d')"
        return f"COALESCE(CAST({c} AS VARCHAR), '\\N')"
    parts = []
    for module, (view, names) in views.items():
        columns = names.split()
        row = " || chr(31) || ".join(text(c, "date" if c.endswith("_Date") else "") for c in columns)
        digits = f"CAST(CAST('0x' || substr(md5({row}), 1, 15) AS BIGINT) AS DECIMAL(38,0))"
        parts.append(f"SELECT '{module}' AS Module, '{','.join(columns)}' AS Columns, COUNT(*) AS Rows, "
                     f"CAST(COALESCE(SUM({digits}), 0) AS VARCHAR) AS Signature FROM {view}")
    return "\nUNION ALL\n".join(parts)


sql("table_signature", _signature_sql())


def _parts_sql(digits: int, rows: str) -> str:
    columns = "Deal_ID Lead_ID Account_ID Product_ID Deal_Stage Amount Closing_Date Forecast_Category Margin".split()
    row = " || chr(31) || ".join("COALESCE(" + (f"strftime({c}, '%Y-%m-%d')" if c == "Closing_Date" else f"CAST({c} AS VARCHAR)") + ", '\\N')" for c in columns)
    return (f"SELECT COALESCE(substr(md5(CAST(Deal_ID AS VARCHAR)), 1, {digits}), '-') AS Part, COUNT(*) AS Rows, "
            f"CAST(SUM(CAST(CAST('0x' || substr(md5({row}), 1, 15) AS BIGINT) AS DECIMAL(38,0))) AS VARCHAR) AS Signature FROM {rows} GROUP BY 1")


sql("signature_parts", _parts_sql(2, "deals"))
sql("changed_parts", """
WITH d AS (SELECT substr(md5(CAST(Deal_ID AS VARCHAR)), 1, 3) AS Part, Deal_ID % 101 = 0 AS gone, Deal_ID % 97 = 0 AND Amount IS NOT NULL AS raised FROM deals)
SELECT Part, COUNT(*) AS Old_Rows, COUNT(CASE WHEN NOT gone THEN 1 END) AS New_Rows FROM d GROUP BY Part HAVING bool_or(gone OR raised)""")


def _detected_sql() -> str:
    files = [("deals_export.csv", "Deals", "deals", "name", 36, 9, 9), ("Lead-Export.csv", "Leads", "leads", "name", 17, 8, 7),
             ("file_2.csv", "Accounts", "accounts", "columns", 13, 4, 3), ("file_3.csv", "Products", "products", "columns", 12, 3, 3),
             ("file_4.csv", "Vendors", "vendors", "columns", 12, 3, 3), ("file_5.csv", "Purchase Orders", "purchase_orders", "columns", 13, 4, 4),
             ("file_6.csv", "Activities", "activities", "columns", 12, 4, 3)]
    cut = "COUNT(CASE WHEN Lead_ID % 5 = 0 THEN 1 END)"
    return "\nUNION ALL\n".join(
        f"SELECT '{f}' AS File_Name, '{m}' AS Module, '{by}' AS Found_By, CAST({score} AS BIGINT) AS Column_Score, CAST({n} AS INTEGER) AS Header_Columns, "
        f"CAST({known} AS BIGINT) AS Known_Columns, COUNT(*) + {cut if m == 'Leads' else '0'} AS Lines, {f'CAST(2 * {cut} AS BIGINT)' if m == 'Leads' else 'CAST(0 AS BIGINT)'} AS Open_Lines, "
        f"{'FALSE' if m == 'Leads' else 'TRUE'} AS Splittable FROM {view}" for f, m, view, by, score, n, known in files)


sql("detect_modules", _detected_sql())

sql("corpus_upsert", """
WITH old AS (SELECT vec_id AS id, embedding, CAST(NULL AS BIGINT) AS version, 0 AS newer FROM embeddings),
upd AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x * 2 AS FLOAT)) AS embedding,
               CASE WHEN vec_id % 3 = 0 THEN NULL ELSE vec_id % 5 END AS version, 1 AS newer
        FROM embeddings WHERE embedding IS NOT NULL AND vec_id % 2 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY version IS NOT NULL DESC, version DESC, newer DESC, embedding DESC) AS rk
           FROM (SELECT * FROM old UNION ALL SELECT * FROM upd))
SELECT id, CAST(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) AS DOUBLE) AS total, len(embedding) AS dimensions, version
FROM ranked WHERE rk = 1""")

sql("corpus_merge", """
WITH old AS (SELECT vec_id AS id, embedding, CAST(NULL AS BIGINT) AS version, 0 AS newer FROM embeddings),
upd AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x * 2 AS FLOAT)) AS embedding,
               CASE WHEN vec_id % 3 = 0 THEN NULL ELSE vec_id % 5 END AS version, 1 AS newer
        FROM embeddings WHERE embedding IS NOT NULL AND vec_id % 100 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY version IS NOT NULL DESC, version DESC, newer DESC, embedding DESC) AS rk
           FROM (SELECT * FROM old UNION ALL SELECT * FROM upd))
SELECT id, CAST(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) AS DOUBLE) AS total, len(embedding) AS dimensions, version
FROM ranked WHERE rk = 1""")
