"""Auto insights and management focus.

Deals and Leads are scanned once each, for the aggregates of ``report``. Its
one-row ``facts`` become the insight rows by exploding an array of structs, so
no value passes through the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.functions.columns import format_compact, format_fixed
from revlens.operators import aggregates as agg
from revlens.operators.report import Report, build, facts

INSIGHT_COLUMNS = ("Insight_Order", "title", "metric", "explanation", "recommended_action")


def _s(c: Column) -> Column:
    return c.cast("string")


def management_focus_columns(at_risk: Column, pipeline: Column, commit: Column, won: Column):
    """The largest of four amounts that is > 0; the first listed wins a tie.

    Returns (metric, explanation, action) columns.
    """
    items = [("at-risk pipeline", at_risk, "Review at-risk deals with account owners."),
             ("open pipeline", pipeline, "Prioritize follow-ups on open pipeline deals."),
             ("committed forecast", commit, "Confirm fulfillment plans for committed deals."),
             ("closed won revenue", won, "Ensure invoicing and delivery for won deals.")]
    structs = [F.when(v > 0, F.struct(v.alias("v"), F.lit(-i).alias("o"), F.lit(label).alias("label"),
                                      F.lit(action).alias("action")))
               for i, (label, v, action) in enumerate(items)]
    best = F.array_max(F.filter(F.array(*structs), lambda x: x.isNotNull()))
    metric = F.when(best.isNull(), F.lit("N/A")).otherwise(format_compact(best["v"]))
    expl = F.when(best.isNull(), F.lit("No deal values are available for management prioritization.")) \
        .otherwise(F.concat(F.lit("The largest current value area is "), best["label"], F.lit(" at "),
                            format_compact(best["v"]), F.lit(".")))
    action = F.when(best.isNull(), F.lit("Load deal data to generate management focus recommendations.")) \
        .otherwise(best["action"])
    return metric, expl, action


def overview(facts: DataFrame) -> DataFrame:
    """The report's facts under the names that the insight rows use."""
    cols = [F.col(c) for c in ("Total_Deals", "Pipeline_Amount", "Pipeline_Deals", "Commit_Amount", "At_Risk_Amount", "Closed_Won_Amount",
                               "Closed_Won", "Closed_Lost", "Average_Deal_Size", "Win_Rate")]
    for p, d in (("prod_", "Product_Category"), ("reg_", "Region"), ("stage_", "Deal_Stage")):
        cols += [F.col(f"top_{d}.k").alias(f"{p}{d}"), F.col(f"top_{d}.a").alias(f"{p}Total_Amount"), F.col(f"top_{d}.c").alias(f"{p}Deal_Count")]
    cols += [F.col("top_rep.k").alias("rep_Sales_Rep"), F.col("top_rep.a").alias("rep_Total_Deal_Amount"), F.col("top_rep.c").alias("rep_Deal_Count"),
             F.col("top_source.k").alias("src_Lead_Source"), F.col("top_source.v").alias("src_Total_Estimated_Value"), F.col("top_source.c").alias("src_Lead_Count")]
    return facts.select(*cols)


_ARRAYS: dict[tuple, Column] = {}


def _insight_array(has_prod: bool, has_region: bool, has_stage: bool) -> Column:
    """The array of insight-row structs over the one-row base frame. It only
    names columns, so it is compiled once per JVM and column layout."""
    from pyspark import SparkContext
    key = (id(SparkContext._active_spark_context), has_prod, has_region, has_stage)
    if key not in _ARRAYS:
        _ARRAYS[key] = _build_insight_array(has_prod, has_region, has_stage)
    return _ARRAYS[key]


def _build_insight_array(has_prod: bool, has_region: bool, has_stage: bool) -> Column:
    n = F.col("Total_Deals")
    pipe, commit, risk, won = (F.col("Pipeline_Amount"), F.col("Commit_Amount"), F.col("At_Risk_Amount"),
                               F.col("Closed_Won_Amount"))
    C = format_compact
    rows: list[tuple[Column | None, list[Column]]] = []

    def row(cond, title, metric, expl, action):
        rows.append((cond, [F.lit(title), metric, expl, action]))

    row(None, "Total Open Pipeline Value", C(pipe),
        F.concat(_s(F.col("Pipeline_Deals")), F.lit(" deal(s) are tagged as Pipeline with a combined amount of "),
                 C(pipe), F.lit(".")),
        F.when(pipe > 0, F.lit("Review open pipeline deals and confirm next steps with sales reps."))
        .otherwise(F.lit("No pipeline-tagged deals are currently recorded.")))
    row(None, "Committed Forecast Value", C(commit),
        F.concat(F.lit("Deals in the Commit forecast category total "), C(commit), F.lit(".")),
        F.when(commit > 0, F.lit("Validate delivery capacity and stock for committed deals."))
        .otherwise(F.lit("No committed forecast deals are currently recorded.")))
    row(None, "Closed Won Revenue", C(won),
        F.concat(F.lit("Closed Won deals contribute "), C(won), F.lit(" in recorded revenue.")),
        F.when(won > 0, F.lit("Track fulfillment and invoicing for won deals."))
        .otherwise(F.lit("No Closed Won revenue is recorded yet.")))
    row(None, "At-Risk Pipeline Value", C(risk),
        F.concat(F.lit("Deals marked At Risk total "), C(risk), F.lit(".")),
        F.when(risk > 0, F.lit("Prioritize follow-up on at-risk deals before forecast slips."))
        .otherwise(F.lit("No at-risk deals are currently flagged.")))
    avg = F.col("Average_Deal_Size")
    empty = n == 0
    row(None, "Average Deal Size", F.when(empty, F.lit("N/A")).otherwise(C(avg)),
        F.when(empty, F.lit("No deals are available to calculate an average deal size."))
        .otherwise(F.concat(F.lit("The average deal amount across "), _s(n), F.lit(" deal(s) is "), C(avg),
                            F.lit("."))),
        F.when(empty, F.lit("Add deal records to enable deal size analysis."))
        .otherwise(F.lit("Use average deal size to benchmark new quotations.")))
    wr = F.col("Win_Rate")
    row(None, "Win Rate",
        F.when(wr.isNull(), F.lit("N/A")).otherwise(F.concat(format_fixed(wr, 1), F.lit("%"))),
        F.when(wr.isNull(), F.lit("Win rate cannot be calculated because no Closed Won or Closed Lost deals exist."))
        .otherwise(F.concat(_s(F.col("Closed_Won")), F.lit(" deal(s) were Closed Won and "),
                            _s(F.col("Closed_Lost")), F.lit(" deal(s) were Closed Lost."))),
        F.when(wr.isNull(), F.lit("Close more deals to establish a win rate baseline."))
        .when(wr < 50, F.lit("Review lost deals to identify recurring blockers."))
        .otherwise(F.lit("Maintain current sales practices that are converting deals.")))
    rname, ramt, rcnt = F.col("rep_Sales_Rep"), F.col("rep_Total_Deal_Amount"), F.col("rep_Deal_Count")
    no_rep = rname.isNull()
    row(None, "Top Sales Rep by Deal Amount",
        F.when(empty | no_rep, F.lit("N/A")).otherwise(C(ramt)),
        F.when(empty, F.lit("No deals are available to rank sales reps."))
        .when(no_rep, F.lit("No sales rep performance data is available to rank reps."))
        .otherwise(F.concat(rname, F.lit(" has the highest total deal amount at "), C(ramt), F.lit(" across "),
                            _s(rcnt), F.lit(" deal(s)."))),
        F.when(empty, F.lit("Add deal records to compare sales rep performance."))
        .when(no_rep, F.lit("Add lead ownership data to compare sales reps."))
        .otherwise(F.concat(F.lit("Review "), rname, F.lit("'s pipeline to replicate successful deal patterns."))))
    if has_prod:
        p, pa = F.col("prod_Product_Category"), F.col("prod_Total_Amount")
        row(p.isNotNull() & ~empty, "Top Product Category", C(pa),
            F.concat(p, F.lit(" leads product revenue with "), C(pa), F.lit(" in deal amount.")),
            F.concat(F.lit("Ensure inventory and pricing support demand for "), p, F.lit(".")))
    s, sv, sc = F.col("src_Lead_Source"), F.col("src_Total_Estimated_Value"), F.col("src_Lead_Count")
    row(s.isNotNull(), "Top Lead Source by Estimated Value", C(sv),
        F.concat(s, F.lit(" generated "), _s(sc), F.lit(" lead(s) with estimated value of "), C(sv), F.lit(".")),
        F.concat(F.lit("Invest more in "), s, F.lit(" if lead quality remains strong.")))
    if has_region:
        g, ga = F.col("reg_Region"), F.col("reg_Total_Amount")
        row(g.isNotNull() & ~empty, "Top Region by Deal Amount", C(ga),
            F.concat(g, F.lit(" has the highest deal amount at "), C(ga), F.lit(".")),
            F.concat(F.lit("Align sales coverage and logistics for "), g, F.lit(".")))
    if has_stage:
        st, sa, sn = F.col("stage_Deal_Stage"), F.col("stage_Total_Amount"), F.col("stage_Deal_Count")
        no_stage = empty | st.isNull()
        row(None, "Deals by Stage Summary",
            F.when(no_stage, F.lit("N/A")).otherwise(F.concat(st, F.lit(" ("), _s(sn), F.lit(" deals)"))),
            F.when(no_stage, F.lit("No deal stage data is available."))
            .otherwise(F.concat(F.lit("The largest stage by amount is "), st, F.lit(" with "), C(sa),
                                F.lit(" across "), _s(sn), F.lit(" deal(s)."))),
            F.when(no_stage, F.lit("Add deals to review stage distribution."))
            .otherwise(F.concat(F.lit("Focus coaching on advancing deals out of "), st, F.lit("."))))
    else:
        row(None, "Deals by Stage Summary", F.lit("N/A"), F.lit("No deal stage data is available."),
            F.lit("Add deals to review stage distribution."))
    fm, fe, fa = management_focus_columns(risk, pipe, commit, won)
    row(None, "Management Focus Recommendation", fm, fe, fa)

    structs = []
    for i, (cond, (title, metric, expl, action)) in enumerate(rows):
        keep = F.lit(True) if cond is None else F.coalesce(cond, F.lit(False))
        structs.append(F.struct(F.lit(i).alias("Insight_Order"), title.alias("title"), metric.alias("metric"),
                                expl.alias("explanation"), action.alias("recommended_action"),
                                keep.alias("__keep")))
    return F.array(*structs)


def auto_insights(leads: DataFrame, deals: DataFrame, report: Report | None = None) -> DataFrame:
    """9 to 12 insight rows in fixed order.

    Optional rows: Top Product Category (Deals has Product_Category), Top Lead
    Source (Leads not empty; ranked by estimated value), Top Region (Deals has
    Region). The top lead source is taken by value, not by count. All numbers
    come from the report's one-pass aggregates (built here unless given).
    """
    report = report or build(leads, deals)
    base = overview(facts(report))
    if not report.rep_known:
        base = base.withColumn("rep_Sales_Rep", F.lit(None).cast("string"))
    if not report.have(leads=("Lead_Source", "Lead_ID", "Estimated_Value")):
        base = base.withColumn("src_Lead_Source", F.lit(None).cast("string"))
    out = base.select(F.explode(_insight_array(*(report.have(c) for c in ("Product_Category", "Region", "Deal_Stage")))).alias("r")).select("r.*")
    out = out.where("__keep").drop("__keep")
    # Export shape, missing text -> ""
    return out.na.fill("", ["title", "metric", "explanation", "recommended_action"])


def management_focus(deals: DataFrame) -> DataFrame:
    """J2 as its own one-row table."""
    kpi = agg.kpi_forecast_stage(deals)
    m, e, a = management_focus_columns(F.col("At_Risk_Amount"), F.col("Pipeline_Amount"), F.col("Commit_Amount"),
                                       F.col("Closed_Won_Amount"))
    return kpi.select(m.alias("metric"), e.alias("explanation"), a.alias("recommended_action"))
