"""Answer context rows (J8, F8): preview, peak row, observations and limitations of a result.

``KINDS`` tells by title, source or columns which kind a result is of, which
columns of it may be shown, and what is to be said about it; ``context_rows``
gives its context as rows, ``answer_rows`` those of several results.
``answer_context`` is the short form for a label and a value.

A result table is reduced to at most ``PREVIEW_ROWS`` ordered rows by a top-k
before anything is gathered, so the context row never holds more than five
preview lines whatever the size of the result.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from revlens.functions.columns import format_compact, format_fixed
from revlens.plans.semantic import PREVIEW_ROWS


def answer_context(data: DataFrame, title: str, x: str, y: str) -> DataFrame:
    """One row: title, axes, preview text (first rows by value, largest first),
    row count and the observation ``Highest value is X at Y``."""
    y_text = (F.col(y).cast("string") if ("Rate" in y or "Count" in y) else format_compact(F.col(y)))
    top = data.orderBy(F.col(y).desc_nulls_last(), F.col(x).asc()).limit(PREVIEW_ROWS) \
        .select(F.col(x).cast("string").alias("x"), F.col(y).alias("v"), y_text.alias("t"))
    ordered = F.sort_array(F.collect_list(F.struct(F.coalesce(-F.col("v"), F.lit(float("inf"))).alias("k"),
                                                   F.col("x"), F.col("t"))), asc=True)
    prev = top.agg(ordered.alias("__o"), F.count(F.lit(1)).alias("Preview_Rows"))
    prev = prev.select("*", F.array_join(F.transform("__o", lambda s: F.concat(s["x"], F.lit(": "), s["t"])),
                                         "; ").alias("Preview"), F.try_element_at("__o", F.lit(1)).alias("__p"))
    return prev.select(F.lit(title).alias("Title"), F.lit(x).alias("X_Axis"), F.lit(y).alias("Y_Axis"),
                       "Preview", "Preview_Rows",
                       F.concat(F.lit("Highest value is "), F.col("__p.x"), F.lit(" at "), F.col("__p.t"),
                                F.lit(".")).alias("Observation"))


# ---------------------------------------------------------------- structured context
@dataclass(frozen=True)
class Kind:
    """How results of one kind are told: which they are, and what may be shown of them."""

    metric_type: str
    business_object: str
    main_entity: str | None = None           # None: the result's title
    columns: tuple[str, ...] | None = None   # preview columns; None: the first five that name no id or company; (): no preview
    observations: tuple[str, ...] = ()
    with_rows: tuple[str, ...] = ()          # observations where there are rows
    time_period: str | None = None
    chart_type: str | None = None
    axes: tuple[str, str] | None = None
    peak: tuple[str, str] | None = None      # (label, value): the main value is the largest value's row
    title: tuple[str, ...] = ()              # words that a title of this kind has, all of them
    source: str | None = None                # or the answer source
    chart_key: str | None = None             # or the chart key
    column: str | None = None                # or a column of its rows

    def fits(self, r: Result) -> bool:
        words = self.title and all(w in r.title.lower() for w in self.title)
        return bool(words or (self.source and r.source == self.source) or (self.chart_key and r.chart_key == self.chart_key)
                    or (self.column and r.data is not None and self.column in r.data.columns))


@dataclass(frozen=True)
class Result:
    """An answer: its title and texts, and its rows (``order``: first to last)."""

    title: str
    question: str
    data: DataFrame | None = None
    order: tuple[Column, ...] = ()
    source: str = "metric calculation"
    answer: str | DataFrame = ""             # text, or a frame of one row and one text column
    action: str = ""
    answer_type: str = "table"
    chart_key: str | None = None
    chart_type: str | None = None
    axes: tuple[str, str] | None = None      # column names of a chart specification


#: result kinds in the order in which they are tried (fixed values: names, columns and texts that users of the answers see)
KINDS = (
    Kind("monthly_pipeline_trend", "pipeline trend", "closing month", ("Closing_Month", "Total_Amount"),
         ("Monthly trend is grouped by Closing_Date month.", "Missing months are filled with AED 0."), (), "monthly", "line_chart",
         ("Closing Month", "Total Amount (AED)"), ("Closing_Month", "Total_Amount"), ("monthly pipeline trend",), chart_key="monthly_pipeline_trend"),
    Kind("forecast_quality", "forecast quality", "product category", ("Product_Category", "Weak_Forecast_Amount", "Strong_Forecast_Amount", "Weak_Forecast_Ratio"),
         ("Weak forecast = At Risk + Omitted + Pipeline.", "Strong forecast = Commit + Closed + Best Case."), title=("forecast quality",), source="forecast quality analysis"),
    Kind("lead_source_conversion", "lead conversion", "lead source", ("Lead_Source", "Total_Leads", "Converted_Leads", "Conversion_Rate", "Estimated_Value"),
         ("Conversion uses Lead_ID match between leads and deals.",),
         ("Lead sources are sorted by Estimated Value descending, then Conversion Rate ascending.",), title=("lead source", "conversion"), source="lead conversion analysis"),
    Kind("deal_stage_breakdown", "deal stage performance", "deal stage", ("Deal_Stage", "Deal_Count", "Total_Amount"),
         ("Deal stages are grouped from the Deal_Stage field.",), title=("stage",), column="Deal_Stage"),
    Kind("sales_rep_performance", "sales performance", "sales rep", ("Sales_Rep", "Total_Deal_Amount", "Deal_Count"),
         ("Sales rep performance is grouped by Sales_Rep and summed by Amount.",), title=("sales rep",)),
    Kind("total_pipeline_value", "pipeline value", "pipeline", (), ("Pipeline totals come from the Amount column.",), title=("total pipeline value",)),
)
GENERAL = Kind("general_revenue_insight", "revenue operations")
NO_PREVIEW = "No supporting table preview is available for this result."
CONTEXT_SCHEMA = "Title string, Part string, Position int, Field string, Value string"


def kind_of(r: Result) -> Kind:
    return next((k for k in KINDS if k.fits(r)), GENERAL)


def _shown(c: str, kind: str) -> Column:
    """A preview value as text: whole numbers plain, others with four decimals."""
    if kind.startswith(("double", "float", "decimal")):
        return format_fixed(c, 4)
    return F.col(f"`{c}`").cast("string")


def context_rows(spark: SparkSession, r: Result) -> DataFrame:
    """The context of one answer as rows (Title, Part, Position, Field, Value).

    Parts: ``context`` (one row a field), ``preview`` (a row a field of the first
    ``PREVIEW_ROWS`` rows in the result's order), ``observation`` and
    ``limitation``. The rows of the result are cut by a top-k before anything is
    gathered, and by a top-1 for the peak; nothing is computed on the driver.
    """
    kind = kind_of(r)
    title, empty = F.lit(r.title), F.lit(None).cast("string")
    if kind.columns is None:
        names = [] if r.data is None else [c for c in r.data.columns if "id" not in c.lower() and "company" not in c.lower()][:PREVIEW_ROWS]
    else:
        names = [] if r.data is None else [c for c in kind.columns if c in r.data.columns]
    answer = r.answer if isinstance(r.answer, DataFrame) else spark.range(1).select(F.lit(r.answer).alias("a"))
    one = answer.select(F.col(f"`{answer.columns[0]}`").cast("string").alias("answer"))
    key = F.lit(1).alias("__k")
    peak = kind.peak if kind.peak and r.data is not None and set(kind.peak) <= set(r.data.columns) else None
    if peak:
        label, value = peak
        best = (r.data.orderBy(F.col(value).desc_nulls_last(), *r.order).limit(1)
                .select(F.col(label).cast("string").alias("label"), F.col(value).cast("double").alias("value")))
        one = one.select("answer", key).join(F.broadcast(best.select("label", "value", key)), "__k", "left")
    else:
        one = one.select("answer", empty.alias("label"), F.lit(None).cast("double").alias("value"))
    if names:
        order = r.order or tuple(F.col(f"`{c}`").asc() for c in names)
        rows = r.data.orderBy(*order).limit(PREVIEW_ROWS).withColumn("p", F.row_number().over(Window.orderBy(*order)))  # PREVIEW_ROWS rows
        rows = rows.select("p", *[_shown(c, dict(r.data.dtypes)[c]).alias(f"v{i}") for i, c in enumerate(names)])
        held = rows.agg(F.sort_array(F.collect_list(F.struct("p", F.array(*[f"v{i}" for i in range(len(names))]).alias("v")))).alias("rows"))
        one = one.select("*", key).drop("__k").withColumn("__k", F.lit(1)).join(F.broadcast(held.select("rows", key)), "__k")
    else:
        one = one.withColumn("rows", F.array().cast("array<struct<p:int,v:array<string>>>"))
    some = F.size("rows") > 0
    main = F.when(F.col("label").isNotNull(), F.concat(F.col("label"), F.lit(" at AED "), F.format_number("value", 0))).otherwise(F.col("answer"))
    chart = kind.chart_type or {"metric": "no_chart", "chart": r.chart_type or "chart", "dynamic_chart": r.chart_type or "chart"}.get(r.answer_type)
    axes = kind.axes or ((names[0].replace("_", " "), names[1].replace("_", " ")) if kind is GENERAL and len(names) > 1 else None)
    x, y = axes or (None, None)
    spec = tuple(c.replace("_", " ") for c in r.axes) if r.axes else (None, None)
    bars = chart in ("line", "line_chart", "bar")
    # axes that are read off rows are only known where there are rows
    x_axis = F.lit(x or spec[0]) if kind.axes or not axes else F.when(some, F.lit(x)).otherwise(F.lit(spec[0]))
    y_rest = F.lit(spec[1] or ("Value" if bars else None))
    y_axis = F.lit(y) if kind.axes else F.when(some, F.lit(y)).otherwise(y_rest) if axes else y_rest
    fields = [("original_user_question", F.lit(r.question)), ("answer_source", F.lit(r.source)), ("computed_answer", F.col("answer")),
              ("recommended_action", F.lit(r.action)), ("currency", F.lit("AED")), ("metric_type", F.lit(kind.metric_type)),
              ("business_object", F.lit(kind.business_object)), ("main_entity", F.lit(kind.main_entity or r.title)), ("main_value", main),
              ("time_period", F.lit(kind.time_period)), ("chart_type", F.lit(chart)), ("chart_title", F.lit(r.title)), ("x_axis", x_axis), ("y_axis", y_axis)]

    def row(part: str, position: int, field: Column, value: Column) -> Column:
        return F.struct(F.lit(part).alias("Part"), F.lit(position).alias("Position"), field.alias("Field"), value.cast("string").alias("Value"))
    fixed = [row("context", i, F.lit(name), v) for i, (name, v) in enumerate(fields, 1)]
    notes = [(F.lit(True), F.lit(o)) for o in kind.observations] + [(some, F.lit(o)) for o in kind.with_rows]
    if peak:
        notes.append((F.col("label").isNotNull(), F.concat(F.lit("Highest month is "), F.col("label"), F.lit("."))))
    fixed += [F.when(there, row("observation", i, empty, text)) for i, (there, text) in enumerate(notes, 1)]
    fixed.append(F.when(~some, row("limitation", 1, empty, F.lit(NO_PREVIEW))))
    cells = F.flatten(F.transform("rows", lambda x: F.array(*[F.struct(F.lit("preview").alias("Part"), x["p"].alias("Position"), F.lit(c).alias("Field"), x["v"][i].alias("Value"))
                                                             for i, c in enumerate(names)]))) if names else None
    every = F.array_compact(F.array(*fixed))
    out = one.select(F.explode(F.concat(every, cells) if cells is not None else every).alias("r"))
    return out.select(title.alias("Title"), "r.Part", "r.Position", "r.Field", "r.Value")


def answer_rows(spark: SparkSession, results: list[Result]) -> DataFrame:
    """The contexts of several answers in one job."""
    return reduce(lambda a, b: a.unionByName(b), [context_rows(spark, r) for r in results])
