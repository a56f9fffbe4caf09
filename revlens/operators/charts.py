"""Dynamic chart specs, chart data and chart explanations.

``with_chart_spec`` turns a question column into a spec struct with ordered phrase
rules (column expressions, so a question log of any size is annotated in one
job). ``chart_data`` runs one spec (a small dict on the driver) as an
aggregate; ``chart_explanation`` summarises its leading row as text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.functions.columns import format_compact, money_mean, money_sum
from revlens.functions.text import strip_lower
from revlens.operators import aggregates
from revlens.operators import guards, joins

# Chart vocabularies, in their natural (first-match) order.
VALUE_PHRASE_TO_COLUMN = {
    "revenue": "Amount", "amount": "Amount", "deal value": "Amount", "pipeline value": "Amount",
    "opportunity value": "Amount", "pipeline": "Amount", "estimated value": "Estimated_Value",
    "lead value": "Estimated_Value", "deal size": "Amount",
}
CATEGORY_PHRASES = {
    "region": ("Region", "Region"), "location": ("Region", "Region"), "market": ("Region", "Region"),
    "product category": ("Product_Interest", "Product_Category"), "product": ("Product_Interest", "Product_Category"),
    "source": ("Lead_Source", None), "lead source": ("Lead_Source", None),
    "sales rep": ("Sales_Rep", "Sales_Rep"), "owner": ("Sales_Rep", "Sales_Rep"),
    "salesperson": ("Sales_Rep", "Sales_Rep"), "stage": (None, "Deal_Stage"), "deal stage": (None, "Deal_Stage"),
    "forecast": (None, "Forecast_Category"), "forecast category": (None, "Forecast_Category"),
    "industry": ("Industry", None), "segment": ("Industry", None), "customer type": ("Customer_Type", None),
}
DATE_PHRASES = {
    "closing date": ("deals", "Closing_Date"), "close date": ("deals", "Closing_Date"),
    "month": ("deals", "Closing_Date"), "created date": ("leads", "Created_Date"), "lead date": ("leads", "Created_Date"),
}
AGGREGATION_KEYWORDS = {
    "mean": "mean", "average": "mean", "avg": "mean", "count": "count", "number of": "count", "how many": "count",
    "total": "sum", "sum": "sum",
}
LEADS_DATASET_TOKENS = ("leads", "lead source", "estimated value", "lead value", "created date", "industry",
                        "customer type")
DEALS_DATASET_TOKENS = ("deals", "revenue", "amount", "pipeline", "stage", "forecast", "closed won", "closing date",
                        "close date", "deal size")


def _lit(v) -> str:
    if v is None:
        return "CAST(NULL AS STRING)"
    assert "'" not in v
    return "'" + v + "'"


def _first_hit(col: str, phrases) -> str:
    """SQL: the first phrase (in order) contained in ``col``, else null."""
    arr = ", ".join(_lit(p) for p in phrases)
    return f"try_element_at(filter(array({arr}), p -> instr({col}, p) > 0), 1)"


def _lookup(mapping: dict, key: str) -> str:
    """SQL: ``mapping[key]`` as a literal map lookup (null key -> null)."""
    pairs = ", ".join(f"{_lit(k)}, {_lit(v)}" for k, v in mapping.items())
    return f"CASE WHEN {key} IS NULL THEN CAST(NULL AS STRING) ELSE try_element_at(map({pairs}), {key}) END"


def with_chart_spec(df: DataFrame, text_col: str = "text", out: str = "chart_spec") -> DataFrame:
    """K4: add a struct column (dataset, x_column, y_column, aggregation,
    chart_type, title, time_grain, pipeline_filter, supported) for each question.

    Staged SQL expressions: each intermediate (first matching phrase, dataset,
    x, y, aggregation) is a column computed once.
    """
    q = "`__cq`"
    leads_map = {p: lc for p, (lc, dc) in CATEGORY_PHRASES.items()}
    deals_map = {p: dc for p, (lc, dc) in CATEGORY_PHRASES.items()}
    ds0 = (f"CASE WHEN {q} RLIKE {_lit(_alt(LEADS_DATASET_TOKENS))} THEN 'leads' "
           f"WHEN {q} RLIKE {_lit(_alt(DEALS_DATASET_TOKENS))} THEN 'deals' "
           f"WHEN instr({q}, 'source') > 0 THEN 'leads' ELSE 'deals' END")
    d = df.withColumn("__cq", strip_lower(F.col(text_col).cast("string")))
    d = d.withColumns({"__ds0": F.expr(ds0), "__cat": F.expr(_first_hit(q, CATEGORY_PHRASES)),
                       "__date": F.expr(_first_hit(q, DATE_PHRASES)),
                       "__aggk": F.expr(_first_hit(q, AGGREGATION_KEYWORDS))})
    x_cat = (f"CASE WHEN __ds0 = 'leads' THEN {_lookup(leads_map, '__cat')} "
             f"ELSE {_lookup(deals_map, '__cat')} END")
    d = d.withColumn("__xcat", F.expr(x_cat))
    use_date = "(__xcat IS NULL AND __date IS NOT NULL)"
    date_ds = _lookup({p: ds for p, (ds, c) in DATE_PHRASES.items()}, "__date")
    date_col = _lookup({p: c for p, (ds, c) in DATE_PHRASES.items()}, "__date")
    d = d.withColumns({
        "__ds": F.expr(f"CASE WHEN {use_date} THEN {date_ds} ELSE __ds0 END"),
        "__x": F.expr(f"CASE WHEN {use_date} THEN {date_col} ELSE __xcat END"),
        "__grain": F.expr(f"CASE WHEN {use_date} AND instr({q}, 'month') > 0 THEN 'month' END"),
    })
    vals = ", ".join(f"named_struct('p', {_lit(p)}, 'c', {_lit(c)})" for p, c in VALUE_PHRASE_TO_COLUMN.items())
    y0 = (f"coalesce(try_element_at(filter(array({vals}), s -> instr({q}, s.p) > 0 "
          f"AND NOT (__ds = 'leads' AND s.c = 'Amount')), 1).c, "
          f"CASE WHEN instr({q}, 'leads by') > 0 AND __ds = 'leads' THEN 'Lead_ID' "
          f"WHEN instr({q}, 'deals by') > 0 AND __ds = 'deals' THEN 'Deal_ID' END)")
    d = d.withColumn("__y0", F.expr(y0))
    agg = (f"coalesce({_lookup(AGGREGATION_KEYWORDS, '__aggk')}, "
           f"CASE WHEN __y0 IN ('Amount', 'Estimated_Value') THEN 'sum' ELSE 'count' END)")
    d = d.withColumn("__agg", F.expr(agg))
    d = d.withColumn("__y", F.expr("CASE WHEN __agg = 'count' THEN (CASE WHEN __ds = 'leads' THEN 'Lead_ID' "
                                   "ELSE 'Deal_ID' END) ELSE __y0 END"))
    d = d.withColumn("__pipe", F.expr(f"instr({q}, 'pipeline') > 0 AND __ds = 'deals'"))
    x_label = ("CASE WHEN __grain = 'month' THEN concat('Month of ', replace(__x, '_', ' ')) "
               "ELSE replace(__x, '_', ' ') END")
    base = ("CASE WHEN __agg = 'count' THEN (CASE WHEN __ds = 'leads' THEN 'Lead Count' ELSE 'Deal Count' END) "
            "WHEN __agg = 'mean' THEN (CASE WHEN __y = 'Amount' THEN 'Average Deal Size' "
            "ELSE concat('Average ', replace(__y, '_', ' ')) END) "
            "WHEN __y = 'Amount' THEN (CASE WHEN __pipe THEN 'Pipeline' ELSE 'Revenue' END) "
            "WHEN __y = 'Estimated_Value' THEN 'Estimated Lead Value' ELSE replace(__y, '_', ' ') END")
    spec = (f"named_struct('dataset', __ds, 'x_column', __x, 'y_column', __y, 'aggregation', __agg, "
            f"'chart_type', CASE WHEN __grain = 'month' THEN 'line' ELSE 'bar' END, "
            f"'title', concat({base}, ' by ', {x_label}), 'time_grain', __grain, 'pipeline_filter', __pipe, "
            f"'supported', {q} <> '' AND __x IS NOT NULL AND __y IS NOT NULL)")
    d = d.withColumn(out, F.expr(spec))
    return d.drop("__cq", "__ds0", "__cat", "__date", "__aggk", "__xcat", "__ds", "__x", "__grain", "__y0",
                  "__agg", "__y", "__pipe")


def _alt(phrases) -> str:
    return "|".join(r"\\Q" + p + r"\\E" for p in phrases)


def spec_for_question(spark, question: str) -> dict | None:
    """K4 for one question: the spec as a dict (one small row to the driver),
    or None when the question names no supported grouping or measure."""
    row = with_chart_spec(spark.createDataFrame([(question,)], "text string")).select("chart_spec.*").first()
    return row.asDict() if row is not None and row["supported"] else None


def chart_data(spec: dict, leads: DataFrame, deals: DataFrame) -> DataFrame:
    """Aggregate one spec. Deals get Sales_Rep from Leads when
    they lack it (C12); filters are exact equality (B6). Month charts are
    ``yyyy-MM`` in chronological order (not gap-filled); others largest first."""
    spark = deals.sparkSession
    x, y, agg = spec["x_column"], spec["y_column"], spec["aggregation"]
    df = leads if spec["dataset"] == "leads" else deals
    if spec["dataset"] == "deals" and x == "Sales_Rep" and "Sales_Rep" not in deals.columns:
        df = joins.with_lead_dimension(deals, leads, "Sales_Rep")
    filters = {"Forecast_Category": "Pipeline"} if spec.get("pipeline_filter") else {}
    if guards.missing(df, [x, y, *filters]):
        return guards.empty(spark, f"`{x}` string, Value double")
    df = aggregates.filter_exact(df, filters)
    value = {"sum": money_sum(y), "mean": money_mean(y), "count": F.count(F.col(y)).cast("double")}[agg]
    if spec.get("time_grain") == "month":
        key = F.date_format(F.trunc(F.col(x).cast("date"), "month"), "yyyy-MM")
        out = df.where(key.isNotNull()).groupBy(key.alias(x)).agg(value.alias("Value"))
        return out.orderBy(F.col(x).asc())
    out = df.where(F.col(x).isNotNull()).groupBy(F.col(x).cast("string").alias(x)).agg(value.alias("Value"))
    return out.orderBy(F.col("Value").desc(), F.col(x).asc())


def chart_explanation(spec: dict, data: DataFrame) -> DataFrame:
    """M4: explanation and action from the leading row (largest value; for a
    month chart, the peak month, earliest on a tie)."""
    x = spec["x_column"]
    currency = spec["y_column"] in ("Amount", "Estimated_Value")
    top = data.orderBy(F.col("Value").desc(), F.col(x).asc()).limit(1)
    v = F.col("Value")
    num = format_compact(v) if currency else F.format_number(v, 1)
    if spec.get("time_grain") == "month":
        expl = F.concat(F.lit("The monthly trend peaks in "), F.col(x), F.lit(" at "), num, F.lit("."))
    elif spec["aggregation"] == "count":
        unit = "lead" if spec["dataset"] == "leads" else "deal"
        expl = F.concat(F.col(x), F.lit(" has the highest count at "), F.format_number(v, 0),
                        F.lit(f" {unit}(s)."))
    else:
        expl = F.concat(F.col(x), F.lit(" is currently the leading segment at "), num, F.lit("."))
    action = F.concat(F.lit("Review what is driving performance in "), F.col(x),
                      F.lit(" and decide whether to replicate it elsewhere."))
    return top.select(F.lit(spec["title"]).alias("title"), expl.alias("explanation"),
                      action.alias("recommended_action"))


def safe_preview(df: DataFrame, n_columns: int = 5) -> DataFrame:
    """Drop columns whose name contains ``id`` or ``company``, keep the first five others."""
    keep = [c for c in df.columns if "id" not in c.lower() and "company" not in c.lower()]
    return df.select(*keep[:n_columns])
