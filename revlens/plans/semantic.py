"""Semantic layer: domain constants, metric specs and dimension synonyms.

The constants below are fixed values that must equal the reference's for the
results to agree; they are stated plainly and in their natural order.
"""

from __future__ import annotations

from dataclasses import dataclass

# ---------------------------------------------------------------------------
# Fixed values (domain constants).
# ---------------------------------------------------------------------------
OPEN_FORECAST_CATEGORIES = ("Pipeline", "Best Case", "Commit", "At Risk")
OPEN_STAGES = ("New Inquiry", "Technical Discussion", "Quotation Sent", "Negotiation",
               "PO Received", "Proposal")
CLOSED_STAGES = ("Closed Won", "Closed Lost")
WEAK_FORECAST_CATEGORIES = ("At Risk", "Omitted", "Pipeline")
STRONG_FORECAST_CATEGORIES = ("Commit", "Closed", "Best Case")
NULL_WARNING_THRESHOLD = 0.6
PREVIEW_ROWS = 5
DIAGNOSTIC_SAMPLE_ROWS = 3
DEAL_LIST_ROWS = 10
DEFAULT_TOP_K = 5


@dataclass(frozen=True)
class MetricSpec:
    """One business metric: how it aggregates and over which dimensions.

    ``output`` is the name of the value column in grouped results.
    """

    name: str
    synonyms: tuple[str, ...]
    datasets: tuple[str, ...]
    required_columns: tuple[str, ...]
    aggregation: str
    valid_dimensions: tuple[str, ...]
    output: str


# Metric vocabulary, in the reference's order.
METRICS: dict[str, MetricSpec] = {
    "total_pipeline_value": MetricSpec(
        "total_pipeline_value", ("total pipeline value", "open pipeline", "pipeline total"),
        ("deals",), ("Amount", "Forecast_Category"), "sum", (), "Total_Amount"),
    "revenue": MetricSpec(
        "revenue", ("revenue", "sales", "amount", "deal value", "value"),
        ("deals",), ("Amount",), "sum",
        ("Region", "Product_Category", "Product_Name", "Sales_Rep", "Deal_Stage",
         "Forecast_Category", "Lead_Source", "Account_Name", "Customer_Type"),
        "Total_Amount"),
    "pipeline": MetricSpec(
        "pipeline", ("pipeline", "pipeline value", "opportunity value"),
        ("deals",), ("Amount", "Forecast_Category"), "sum",
        ("Sales_Rep", "Region", "Forecast_Category", "Product_Category", "Product_Name",
         "Account_Name"),
        "Total_Amount"),
    "deal_count": MetricSpec(
        "deal_count", ("deal count", "deals", "number of deals"),
        ("deals",), ("Deal_ID",), "count",
        ("Deal_Stage", "Region", "Sales_Rep", "Forecast_Category", "Product_Category",
         "Product_Name", "Account_Name"),
        "Deal_Count"),
    "average_deal_size": MetricSpec(
        "average_deal_size", ("average deal size", "avg deal size", "average amount"),
        ("deals",), ("Amount", "Deal_ID"), "mean",
        ("Region", "Product_Category", "Product_Name", "Sales_Rep", "Deal_Stage",
         "Account_Name", "Customer_Type"),
        "Average_Deal_Size"),
    "sales_rep_performance": MetricSpec(
        "sales_rep_performance",
        ("sales rep performance", "sales rep", "salesperson", "salesman", "owner"),
        ("deals", "leads"), ("Amount",), "sum", ("Sales_Rep",), "Total_Amount"),
    "forecast_quality": MetricSpec(
        "forecast_quality", ("forecast quality", "weak forecast", "at-risk forecast", "weak pipeline"),
        ("deals",), ("Product_Category", "Forecast_Category", "Amount"), "ratio",
        ("Product_Category",), "Weak_Forecast_Ratio"),
    "lead_source_conversion": MetricSpec(
        "lead_source_conversion", ("lead conversion", "source conversion", "low conversion"),
        ("leads", "deals"), ("Lead_ID", "Lead_Source", "Estimated_Value"), "comparison",
        ("Lead_Source",), "Conversion_Rate"),
    "monthly_pipeline_trend": MetricSpec(
        "monthly_pipeline_trend",
        ("monthly pipeline trend", "pipeline by month", "revenue trend by month",
         "revenue trend by closing date"),
        ("deals",), ("Closing_Date", "Amount"), "sum", ("Closing_Date",), "Total_Amount"),
    "win_rate": MetricSpec(
        "win_rate", ("win rate", "conversion to closed won"),
        ("deals",), ("Deal_Stage",), "ratio", ("Lead_Source", "Sales_Rep", "Region"), "Win_Rate"),
    "margin": MetricSpec(
        "margin", ("margin", "profit margin"),
        ("deals",), ("Margin",), "sum", ("Product_Category", "Region", "Sales_Rep"), "Total_Margin"),
}

# Dimension vocabulary, in the reference's order.
DIMENSION_SYNONYMS: dict[str, tuple[str, ...]] = {
    "Region": ("region", "regional", "area", "market", "location"),
    "Product_Category": ("product category", "product categories", "product", "item", "category"),
    "Product_Name": ("product name", "item name", "sku"),
    "Sales_Rep": ("sales rep", "salesperson", "salesman", "owner", "rep"),
    "Deal_Stage": ("deal stage", "stage", "status"),
    "Lead_Source": ("lead source", "source"),
    "Forecast_Category": ("forecast category", "forecast", "forecast bucket"),
    "Closing_Date": ("closing date", "close date", "month"),
    "Account_Name": ("account name", "customer name", "account", "customer"),
    "Customer_Type": ("customer type", "customer segment", "segment"),
}

# Dimensions that come from Leads through Lead_ID when Deals lacks them.
LEAD_DIMENSIONS = ("Region", "Sales_Rep", "Lead_Source")
# Dimensions that come from Accounts (Account_ID) or Products (Product_ID).
ACCOUNT_DIMENSIONS = ("Account_Name", "Customer_Type", "Region")
PRODUCT_DIMENSIONS = ("Product_Name", "Product_Category")


def metric_synonym_map() -> dict[str, str]:
    out: dict[str, str] = {}
    for name, spec in METRICS.items():
        for s in spec.synonyms:
            out[s] = name
    return out


def dimension_synonym_map() -> dict[str, str]:
    out: dict[str, str] = {}
    for name, syns in DIMENSION_SYNONYMS.items():
        for s in syns:
            out[s] = name
    return out
