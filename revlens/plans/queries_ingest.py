"""Ingestion queries: CRM views exported as CSV with raw CRM-style headers,
then loaded back through the lenient ingest path (A1, A5-A8, A10, A11, A15, A19).

The export step only prepares input in the shape a CRM export has (raw
headers, text values); the loading, header mapping, type coercion, module
detection and the analytics all run through the library on that input.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from revlens.functions.columns import norm_label
from revlens.operators import aggregates as agg
from revlens.sources import catalog, ingest
from revlens.plans.registry import Modules, register

# Raw header names as a CRM export writes them (stand-in input).
DEALS_RAW_HEADERS = {"Deal_ID": "Deal Id", "Lead_ID": "Lead_ID", "Account_ID": "Account ID",
                     "Product_ID": "Product ID", "Deal_Stage": "Stage", "Amount": "Deal Amount",
                     "Closing_Date": "Close Date", "Forecast_Category": "Forecast", "Margin": "Margin"}
LEADS_RAW_HEADERS = {"Lead_ID": "Lead Id", "Company_Name": "Company", "Lead_Source": "Lead Source",
                     "Industry": "Industry", "Estimated_Value": "Estimated Value", "Sales_Rep": "Lead Owner",
                     "Region": "Region", "Customer_Type": "Customer Segment"}


def _export_raw(df, headers: dict, path: str) -> str:
    raw = df.select(*[F.col(c).cast("string").alias(headers[c]) for c in df.columns])
    return ingest.export_csv(raw, path)


def _ingested(spark, sf_dir, which=("Deals", "Leads")):
    """Export the named CRM views as raw CSV and load them back (only those)."""
    m = Modules(spark, sf_dir)
    base = ingest.shared_dir(spark, "ingest")
    paths = []
    if "Deals" in which:
        paths.append(_export_raw(m.deals, DEALS_RAW_HEADERS, f"{base}/deals_export.csv"))
    if "Leads" in which:
        paths.append(_export_raw(m.leads, LEADS_RAW_HEADERS, f"{base}/leads.csv"))
    modules, warnings, unknown = ingest.load_modules(spark, paths)
    return {k: ingest.to_money(v) for k, v in modules.items()}, warnings, unknown


@register("ingest_deals_by_stage")
def q_ingest_deals_by_stage(spark, sf_dir):
    mods, _, _ = _ingested(spark, sf_dir, ("Deals",))
    return agg.deals_by_stage(mods.get("Deals"))


@register("ingest_region_pipeline")
def q_ingest_region_pipeline(spark, sf_dir):
    mods, _, _ = _ingested(spark, sf_dir)
    return agg.region_pipeline(mods["Leads"], mods["Deals"])


@register("ingest_conversion")
def q_ingest_conversion(spark, sf_dir):
    mods, _, _ = _ingested(spark, sf_dir)
    return agg.lead_conversion(mods["Leads"], mods["Deals"])


@register("export_csv")
def q_export_csv(spark, sf_dir):
    """Export a result as CSV and read it back with the result's schema."""
    result = agg.deals_by_stage(Modules(spark, sf_dir).deals)
    path = ingest.export_csv(result, ingest.shared_dir(spark, "export") + "/deals_by_stage.csv")
    return spark.read.schema(result.schema).option("header", True).csv(path)


@register("module_diagnostics")
def q_module_diagnostics(spark, sf_dir):
    m = Modules(spark, sf_dir)
    base = ingest.shared_dir(spark, "diag")
    path = _export_raw(m.deals, DEALS_RAW_HEADERS, f"{base}/deals.csv")
    r = ingest.load_module_file(spark, path)
    d = ingest.module_diagnostics(r)
    held = d.select("Module", "File_Name", "Row_Count", F.size("Sample_Rows").alias("Sample_Count"),
                    F.array_join("Normalized_Columns", ",").alias("Normalized_Columns"), F.array_join("Missing_Required", ",").alias("Missing_Required"), "Sample_Rows")
    return held.select("*", F.posexplode_outer("Sample_Rows").alias("Sample_Position", "Sample_Row")).drop("Sample_Rows")


@register("load_report")
def q_load_report(spark, sf_dir):
    """Resolved headers of two raw exports, with values that cannot be read; one header is in no alias table."""
    m = Modules(spark, sf_dir)
    base = ingest.shared_dir(spark, "report")
    deals = m.deals.withColumns({"Amount": F.when(F.col("Deal_ID") % 41 == 0, "n/a").otherwise(F.col("Amount").cast("string")),
                                 "Closing_Date": F.when(F.col("Deal_ID") % 43 == 0, "soon").otherwise(F.col("Closing_Date").cast("string"))})
    leads = m.leads.withColumn("Estimated_Value", F.when(F.col("Lead_ID") % 7 == 0, "unknown").otherwise(F.col("Estimated_Value").cast("string")))
    paths = [_export_raw(deals, DEALS_RAW_HEADERS, f"{base}/deals_export.csv"), _export_raw(leads, LEADS_RAW_HEADERS | {"Industry": "Line Of Work"}, f"{base}/leads.csv")]
    return ingest.load_report([ingest.load_module_file(spark, p) for p in paths])


@register("strict_deals")
def q_strict_deals(spark, sf_dir):
    """A1, A3, A4: a Deals file of the strict contract (all seven columns), read back with ANSI casts."""
    d = Modules(spark, sf_dir).deals
    file = d.select("Deal_ID", "Lead_ID", F.concat(F.lit("Company, No. "), F.col("Account_ID").cast("string")).alias("Company_Name"), "Deal_Stage", "Amount", "Closing_Date",
                    "Forecast_Category")
    path = ingest.export_csv(file, ingest.shared_dir(spark, "strict") + "/deals.csv")
    out = ingest.clean_strict(ingest.read_csv_strings(spark, path), "deals", "deals.csv")
    return out.withColumn("Closing_Date", F.date_format("Closing_Date", "yyyy-MM-dd"))


@register("strict_leads")
def q_strict_leads(spark, sf_dir):
    """A1, A3, A4: a Leads file of the strict contract (all eight columns), read back with ANSI casts."""
    lead = Modules(spark, sf_dir).leads
    file = lead.select("Lead_ID", "Company_Name", "Lead_Source", "Industry", "Estimated_Value", F.when(F.col("Sales_Rep").isNull(), "New").otherwise("Assigned").alias("Status"),
                       F.date_add(F.lit("2023-01-01").cast("date"), (F.col("Lead_ID") % 365).cast("int")).alias("Created_Date"), "Sales_Rep")
    path = ingest.export_csv(file, ingest.shared_dir(spark, "strict") + "/leads.csv")
    out = ingest.clean_strict(ingest.read_csv_strings(spark, path), "leads", "leads.csv")
    return out.withColumn("Created_Date", F.date_format("Created_Date", "yyyy-MM-dd"))


@register("table_signature")
def q_table_signature(spark, sf_dir):
    return ingest.table_signature(Modules(spark, sf_dir).all())


@register("changed_parts")
def q_changed_parts(spark, sf_dir):
    """The parts of Deals that a later state changes: each 97th amount is raised, each 101st deal is gone."""
    deals = Modules(spark, sf_dir).deals
    later = deals.where(F.col("Deal_ID") % 101 != 0).withColumn("Amount", F.when(F.col("Deal_ID") % 97 == 0, F.col("Amount") + 1).otherwise(F.col("Amount")))
    return ingest.changed_parts(ingest.signature_parts(deals, "Deal_ID", 3), ingest.signature_parts(later, "Deal_ID", 3))


@register("signature_parts")
def q_signature_parts(spark, sf_dir):
    return ingest.signature_parts(Modules(spark, sf_dir).deals, "Deal_ID")


@register("detect_modules")
def q_detect_modules(spark, sf_dir):
    """Exports of all modules found by one scan: two by their names, the others, in files without telling names, by
    their headers; some lead sources hold a line break and a quote."""
    m = Modules(spark, sf_dir)
    base = ingest.shared_dir(spark, "catalog")
    broken = F.when(F.col("Lead_ID") % 5 == 0, F.concat(F.lit('x "'), F.lit("\n"), F.col("Lead_ID").cast("string"))).otherwise(F.col("Lead_Source"))
    paths = [_export_raw(m.deals, DEALS_RAW_HEADERS, f"{base}/deals_export.csv"),
             _export_raw(m.leads.withColumn("Lead_Source", broken), LEADS_RAW_HEADERS, f"{base}/Lead-Export.csv")]
    paths += [ingest.export_csv(df, f"{base}/file_{i}.csv") for i, (name, df) in enumerate(m.all().items()) if name not in ("Deals", "Leads")]
    return catalog.detect_modules(catalog.file_catalog(spark, paths)).drop("File_Path")


@register("normalize_labels")
def q_normalize_labels(spark, sf_dir):
    leads = Modules(spark, sf_dir).leads
    return leads.select("Lead_ID", norm_label("Industry").alias("Industry_Label"),
                        norm_label("Customer_Type").alias("Customer_Type_Label"))


def _round_trip(spark, df, name, schema, required):
    path = ingest.export_csv(df, ingest.shared_dir(spark, "scan") + f"/{name}.csv")
    return ingest.scan_csv_strict(spark, path, schema, required, name)


@register("scan_deals")
def q_scan_deals(spark, sf_dir):
    """A1: Deals exported as CSV, read back strictly with the canonical schema."""
    d = _round_trip(spark, Modules(spark, sf_dir).deals, "deals", ingest.DEALS_SCHEMA, ("Deal_ID", "Lead_ID", "Amount"))
    return d.select("Deal_ID", "Lead_ID", "Deal_Stage", F.col("Amount").cast("double").alias("Amount"),
                    F.date_format("Closing_Date", "yyyy-MM-dd").alias("Closing_Date"), "Forecast_Category",
                    F.col("Margin").cast("double").alias("Margin"))


@register("scan_leads")
def q_scan_leads(spark, sf_dir):
    """A1: Leads exported as CSV, read back strictly with the canonical schema."""
    d = _round_trip(spark, Modules(spark, sf_dir).leads, "leads", ingest.LEADS_SCHEMA, ("Lead_ID",))
    return d.select("Lead_ID", "Lead_Source", F.col("Estimated_Value").cast("double").alias("Estimated_Value"),
                    "Sales_Rep", "Region", "Customer_Type")


@register("canonicalize_headers")
def q_canonicalize_headers(spark, sf_dir):
    """Deals exported with raw CRM headers, loaded back with canonical
    names and leniently coerced types (Amount double, Closing_Date date)."""
    mods, _, _ = _ingested(spark, sf_dir, ("Deals",))
    d = mods["Deals"]
    return d.select("Deal_ID", "Lead_ID", "Deal_Stage", F.col("Amount").cast("double").alias("Amount"),
                    F.date_format("Closing_Date", "yyyy-MM-dd").alias("Closing_Date"), "Forecast_Category")


@register("coerce_types")
def q_coerce_types(spark, sf_dir):
    """Leads exported as text, Estimated_Value coerced leniently to a number."""
    mods, _, _ = _ingested(spark, sf_dir, ("Leads",))
    d = mods["Leads"]
    return d.select("Lead_ID", "Sales_Rep", "Customer_Type",
                    F.col("Estimated_Value").cast("double").alias("Estimated_Value"))


@register("deals_by_stage_1998")
def q_deals_by_stage_1998(spark, sf_dir):
    """Deals materialised as Parquet partitioned by closing year; stage totals
    for deals closing in 1998 read only that year's partition."""
    deals = Modules(spark, sf_dir).deals.withColumn("Closing_Year", F.year("Closing_Date"))
    stored = ingest.materialize(deals, ingest.shared_dir(spark, "deals") + "/deals", ["Closing_Year"])
    return agg.deals_by_stage(stored.where(F.col("Closing_Year") == 1998))
