"""Question-log annotation.

The reference parses one question at a time. Here a whole log of questions
(any size) is annotated as one Spark job: every rule is compiled from the
ordered phrase lists in ``revlens.functions.vocab`` into built-in column
expressions, staged over a few ``withColumns`` so codegen stays small.
No Python UDF and no per-question loop.

Follow-up context (K2, K7) is "the last value before this turn in the same
conversation", computed by ``last_non_null_before``: windows over blocks of
turns plus a per-block carry, so a huge conversation is never one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.functions import vocab as V
from revlens.functions.text import (first_int, has, has_any, longest_phrase, matches_any, normalize, ordered_hits,
                                    starts_any, strip_lower, tokens)
from revlens.plans.distributed import last_non_null_before, materialized, order_cuts
from revlens.plans.semantic import dimension_synonym_map, metric_synonym_map

U = "(?U)"  # Unicode-aware \b, \s, \d, as Python's str patterns are


def _null_str() -> Column:
    return F.lit(None).cast("string")


def _prepend(arr: Column, item: Column) -> Column:
    """Insert ``item`` at the front unless null or already present."""
    return F.when(item.isNull() | F.array_contains(arr, item), arr).otherwise(F.concat(F.array(item), arr))


PARTS = ("_lim0", "_sort0", "_early", "_phrase_dim", "_metric", "_dim", "_metrics", "_dims", "_full")


def annotate_questions(df: DataFrame, text_col: str = "text", parts: bool = True) -> DataFrame:
    """K1: add the structured fields of each question (no prior context).

    Output columns: q_norm, q_limit, q_sort, q_metric, q_metrics, q_dimension,
    q_dimensions, q_intent_type, q_intent, q_wants_chart, q_chart_type,
    q_time_grain, q_percentage, q_full_distribution, q_comparison,
    q_recommendation, q_filter_region, q_pipeline_only, q_dataset,
    q_requires_join, q_join_key, q_aggregation; and ``PARTS``, the fields
    before the rules that depend on context, which ``annotate_followups`` needs.
    """
    d = df
    for stage in _annotation_stages(text_col):
        d = d.withColumns(stage)
    return d.drop("_phrase_metric", "_kw_metrics", "_kw_dims", "_wants", *(() if parts else PARTS))


def _wants_chart(n: Column, metric: Column, dim: Column) -> Column:
    """Chart flag of a question for a metric and dimension (either may be null)."""
    explicit = has_any(n, V.CHART_KEYWORDS)
    grouped = F.coalesce(metric.isin(*V.GROUPED_METRICS), F.lit(False))
    wants = explicit | (has(n, " by ") & grouped & starts_any(n, V.GROUPED_CHART_PREFIXES))
    return F.coalesce(F.when((metric == "deal_count") & (dim == "Deal_Stage") & ~explicit, F.lit(False)).otherwise(wants), F.lit(False))


def _shape(n: Column, metric: Column, dim: Column, wants: Column, full: Column, lim0: Column) -> dict[str, Column]:
    """The fields that follow from a metric, a dimension and the chart flag."""
    grouped_dim = F.coalesce(metric.isin(*V.GROUPED_METRICS), F.lit(False)) & dim.isNotNull()
    itype = (F.when((metric == "deal_count") & (dim == "Deal_Stage") & ~wants, F.lit("table"))
             .when(grouped_dim & wants, F.lit("grouped_chart"))
             .when(grouped_dim, F.lit("grouped_metric"))
             .when(wants & metric.isNotNull(), F.lit("chart"))
             .otherwise(F.lit("metric")))
    who = has_any(n, ("which ", "who "))
    itype = F.when(who & grouped_dim, F.when(wants | full, F.lit("grouped_chart")).otherwise(F.lit("grouped_metric"))) \
        .otherwise(itype)
    lim = F.when(has_any(n, ("highest revenue", "most revenue", "strongest pipeline")) & dim.isNotNull(),
                 F.coalesce(lim0, F.lit(1))).otherwise(lim0)
    lim = F.when(who, F.coalesce(lim, F.lit(1))).otherwise(lim)
    lim = F.when(has(n, "worst") & lim.isNull(), F.lit(3)).otherwise(lim)
    return {
        "limit": lim, "intent_type": itype,
        "chart_type": F.when(has(n, "pie chart"), F.lit("pie")).when(has_any(n, ("trend", "month")), F.lit("line"))
        .when(wants, F.lit("bar")),
        "pipeline_only": F.coalesce((metric == "pipeline") & ~F.coalesce(dim == "Forecast_Category", F.lit(False)),
                                    F.lit(False)),
        "aggregation": (F.when(metric == "average_deal_size", F.lit("mean")).when(metric == "deal_count", F.lit("count"))
                        .when(metric.isin("win_rate", "forecast_quality"), F.lit("ratio"))
                        .when(metric == "lead_source_conversion", F.lit("comparison")).otherwise(F.lit("sum"))),
    }


def _annotation_stages(text_col: str) -> list[dict]:
    """The staged column expressions of ``annotate_questions``."""
    n = F.col("q_norm")
    stages: list[dict] = [{"q_norm": normalize(F.col(text_col).cast("string"))}]
    stages.append({
        "_lim0": first_int(n, [U + p for p in V.LIMIT_PATTERNS]),
        "_sort0": F.when(has_any(n, V.ASC_TOKENS), F.lit("asc")).when(has_any(n, V.DESC_TOKENS), F.lit("desc")),
        "_early": (F.when(has_any(n, V.LEAD_CONVERSION_PHRASES) & has(n, "source"), F.lit("conversion"))
                   .when(has_any(n, V.FORECAST_QUALITY_PHRASES) & has_any(n, ("product", "category")),
                         F.lit("forecast_quality"))
                   .when(has_any(n, V.TIME_TREND_PHRASES)
                         | (has(n, "trend") & has_any(n, ("month", "closing date", "close date"))), F.lit("trend"))
                   .when(has_any(n, ("best salesman", "best salesperson", "best sales rep")), F.lit("best_rep"))),
        "_phrase_metric": longest_phrase("q_norm", metric_synonym_map()),
        "_phrase_dim": longest_phrase("q_norm", dimension_synonym_map()),
        "_kw_metrics": ordered_hits("q_norm", V.METRIC_KEYWORDS),
        "_kw_dims": ordered_hits("q_norm", V.DIMENSION_HINTS),
    })
    metric = (F.when(has_any(n, ("average deal size", "avg deal size")), F.lit("average_deal_size"))
              .when(has(n, "win rate"), F.lit("win_rate"))
              .when(has(n, "margin"), F.lit("margin"))
              .when(has_any(n, ("deal count", "number of deals")), F.lit("deal_count"))
              .when(has(n, "pipeline"), F.lit("pipeline"))
              .when(has_any(n, ("revenue", "sales", "amount", "value")), F.lit("revenue"))
              .otherwise(F.col("_phrase_metric")))
    dim = (F.when(has_any(n, ("product name", "item name", "sku")), F.lit("Product_Name"))
           .when(has_any(n, ("product category", "products", "product")), F.lit("Product_Category"))
           .when(has_any(n, ("account", "customer")) & ~has(n, "customer type") & ~has(n, "customer segment"),
                 F.lit("Account_Name"))
           .when(has_any(n, ("regions", "region", "dubai")),
                 F.when(has_any(n, ("by region", "regions", "region")), F.lit("Region"))
                 .otherwise(F.col("_phrase_dim")))
           .when(has_any(n, ("sales rep", "sales reps", "owner")), F.lit("Sales_Rep"))
           .when(has_any(n, ("customer type", "customer segment", "segment")), F.lit("Customer_Type"))
           .otherwise(F.col("_phrase_dim")))
    stages.append({"_metric": metric, "_dim": dim})
    wants = _wants_chart(n, F.col("_metric"), F.col("_dim"))
    stages.append({
        "_metrics": _prepend(F.col("_kw_metrics"), F.col("_metric")),
        "_dims": _prepend(F.col("_kw_dims"), F.col("_dim")),
        "_wants": wants,
        "_full": has_any(n, ("distribution", "all regions", "across all", "of each")),
    })
    dim_c, metric_c, wants_c, full_c = F.col("_dim"), F.col("_metric"), F.col("_wants"), F.col("_full")
    shape = _shape(n, metric_c, dim_c, wants_c, full_c, F.col("_lim0"))
    region_filter = F.when(has(n, "filter to dubai") | n.endswith("to dubai") | (has(n, "to dubai") & has(n, "filter")),
                           F.lit("Dubai"))
    joined = F.array_contains(F.col("_dims"), "Customer_Type")
    general = {
        "q_limit": shape["limit"], "q_sort": F.col("_sort0"), "q_metric": metric_c, "q_metrics": F.col("_metrics"),
        "q_dimension": dim_c, "q_dimensions": F.col("_dims"), "q_intent_type": shape["intent_type"],
        "q_intent": F.when(metric_c.isNotNull() | (F.size("_metrics") > 0), F.lit("analytics"))
        .otherwise(F.lit("unsupported")),
        "q_wants_chart": wants_c, "q_chart_type": shape["chart_type"],
        "q_time_grain": F.when(has(n, "month"), F.lit("month")),
        "q_percentage": has_any(n, ("percentage", "percent", "share")),
        "q_full_distribution": full_c,
        "q_comparison": has_any(n, ("compare", "comparison", "performance of each")),
        "q_recommendation": has_any(n, ("management priority", "management focus", "recommend", "recommendation",
                                        "priority")),
        "q_filter_region": region_filter,
        "q_pipeline_only": shape["pipeline_only"],
        "q_dataset": F.when(joined, F.lit("deals_joined_leads"))
        .when(metric_c == "lead_source_conversion", F.lit("leads")).otherwise(F.lit("deals")),
        "q_requires_join": joined,
        "q_join_key": F.when(joined, F.lit("Lead_ID")),
        "q_aggregation": shape["aggregation"],
    }
    # the early-return shapes override the general fields
    e = F.col("_early")
    trend_metric = F.when(has(n, "pipeline"), F.lit("monthly_pipeline_trend")).otherwise(F.lit("revenue"))
    early = {
        "conversion": dict(q_limit=F.lit(1).cast("bigint"), q_sort=F.lit("desc"), q_metric=F.lit("lead_source_conversion"),
                           q_metrics=F.array(F.lit("lead_source_conversion")), q_dimension=F.lit("Lead_Source"),
                           q_dimensions=F.array(F.lit("Lead_Source")), q_intent_type=F.lit("advanced"),
                           q_wants_chart=F.lit(False), q_chart_type=_null_str(), q_time_grain=_null_str(),
                           q_dataset=F.lit("leads"), q_aggregation=F.lit("comparison")),
        "forecast_quality": dict(q_limit=F.lit(1).cast("bigint"), q_sort=F.lit("desc"), q_metric=F.lit("forecast_quality"),
                                 q_metrics=F.array(F.lit("forecast_quality")), q_dimension=F.lit("Product_Category"),
                                 q_dimensions=F.array(F.lit("Product_Category")), q_intent_type=F.lit("advanced"),
                                 q_wants_chart=F.lit(False), q_chart_type=_null_str(), q_time_grain=_null_str(),
                                 q_dataset=F.lit("deals"), q_aggregation=F.lit("ratio")),
        "trend": dict(q_limit=F.lit(None).cast("bigint"), q_sort=_null_str(), q_metric=trend_metric,
                      q_metrics=F.array(trend_metric), q_dimension=F.lit("Closing_Date"),
                      q_dimensions=F.array(F.lit("Closing_Date")), q_intent_type=F.lit("time_trend"),
                      q_wants_chart=F.lit(True), q_chart_type=F.lit("line"), q_time_grain=F.lit("month"),
                      q_dataset=F.lit("deals"), q_aggregation=F.lit("sum"), q_pipeline_only=has(n, "pipeline")),
        "best_rep": dict(q_limit=F.lit(1).cast("bigint"), q_sort=F.lit("desc"), q_metric=F.lit("pipeline"),
                         q_metrics=F.array(F.lit("pipeline")), q_dimension=F.lit("Sales_Rep"),
                         q_dimensions=F.array(F.lit("Sales_Rep")), q_intent_type=F.lit("rank"),
                         q_wants_chart=F.lit(False), q_chart_type=_null_str(), q_time_grain=_null_str(),
                         q_dataset=F.lit("deals"), q_aggregation=F.lit("sum")),
    }
    # fields an early return leaves at their defaults
    defaults = dict(q_intent=F.lit("analytics"), q_percentage=F.lit(False), q_full_distribution=F.lit(False),
                    q_comparison=F.lit(False), q_recommendation=F.lit(False), q_filter_region=_null_str(),
                    q_pipeline_only=F.lit(False), q_requires_join=F.lit(False), q_join_key=_null_str())
    out = {}
    for field, expr in general.items():
        col = expr
        for kind in ("best_rep", "trend", "forecast_quality", "conversion"):
            spec = early[kind]
            val = spec.get(field, defaults.get(field))
            if val is not None:
                col = F.when(e == kind, val).otherwise(col)
        out[field] = col
    stages.append(out)
    return stages


def _q(text: Column, normalized: bool) -> Column:
    """The lower-cased, stripped question. Pass ``normalized=True`` with a column
    that already holds it: the rule ladders test it many times, and Spark does
    not share a subexpression across CASE branches."""
    return text if normalized else strip_lower(text)


def chart_intent(text: Column, normalized: bool = False) -> Column:
    """K3: does the question ask for a visualization?"""
    q = _q(text, normalized)
    by_rule = q.rlike(U + r"\b(show|compare|display)\b.+\b(by)\b") & has_any(q, V.CHART_VALUE_TOKENS)
    return F.when(q == "", F.lit(False)).otherwise(
        has_any(q, V.CHART_INTENT_KEYWORDS) | has_any(q, V.CHART_BY_PATTERNS) | by_rule)


def qualitative_flag(text: Column, normalized: bool = False) -> Column:
    """K5: qualitative question that should be answered from documents."""
    q = _q(text, normalized)
    generic = has_any(q, V.QUALITATIVE_TOKENS) & ~has_any(q, V.QUALITATIVE_EXCLUDES)
    return (F.when(q == "", F.lit(False)).when(chart_intent(q, True), F.lit(False))
            .when(has_any(q, V.QUANTITATIVE_BLOCKERS), F.lit(False))
            .otherwise(has_any(q, V.QUALITATIVE_PHRASES) | generic))


def followup_intent(text: Column, context_title: Column | None = None, normalized: bool = False) -> Column:
    """K6: follow-up intent label (ordered rules, first match wins)."""
    q = _q(text, normalized)
    title = F.coalesce(F.lower(context_title), F.lit("")) if context_title is not None else F.lit("")
    action = matches_any(q, [U + p for p in V.QUALITATIVE_ACTION_PATTERNS]) | has_any(q, V.ACTION_MARKERS)
    return (F.when(q == "", F.lit("ambiguous"))
            .when(has_any(q, V.UNRELATED_PHRASES), F.lit("unrelated"))
            .when(q.rlike(U + V.RANKING_FOLLOWUP_PATTERN), F.lit("analytics"))
            .when(action, F.when(has_any(q, V.EXPLANATION_KEYWORDS), F.lit("explanation"))
                  .otherwise(F.lit("business_recommendation")))
            .when(has_any(q, V.ANALYTICS_OVERRIDE_TOKENS), F.lit("analytics"))
            .when(has_any(q, V.CHART_IMPROVEMENT_PHRASES), F.lit("chart_improvement"))
            .when(has_any(q, V.BUSINESS_RECOMMENDATION_PHRASES), F.lit("business_recommendation"))
            .when(has_any(q, V.CLARIFICATION_PHRASES), F.lit("clarification"))
            .when(has_any(q, V.EXPLANATION_PHRASES), F.lit("explanation"))
            .when(has_any(q, V.NEW_CHART_PHRASES), F.lit("analytics"))
            .when(has_any(q, V.ANALYTICS_SHORT_TOKENS), F.lit("analytics"))
            .when(starts_any(q, V.CLARIFICATION_PREFIXES), F.lit("clarification"))
            .when(has_any(q, V.BUSINESS_RECOMMENDATION_KEYWORDS), F.lit("business_recommendation"))
            .when(has_any(q, V.EXPLANATION_KEYWORDS), F.lit("explanation"))
            .when(has_any(q, V.CONTEXTUAL_ACTION_MARKERS), F.lit("business_recommendation"))
            .when(has_any(q, V.ANALYTICS_VERBS) & (has_any(q, V.ANALYTICS_METRICS) | has_any(q, V.CHART_NOUNS)),
                  F.lit("analytics"))
            .when(has_any(q, V.ANALYTICS_METRICS), F.lit("analytics"))
            .when(q.isin(*V.CHART_NOUNS), F.lit("ambiguous"))
            .when(has(q, "chart") & has_any(q, ("improve", "present")), F.lit("chart_improvement"))
            .when((title != "") & has_any(q, ("this", "it", "that")), F.lit("explanation"))
            .otherwise(F.lit("ambiguous")))


def intent_bucket(intent: Column) -> Column:
    """K6: collapse intent labels into quantitative / qualitative_contextual / unrelated."""
    return (F.when(intent == "analytics", F.lit("quantitative"))
            .when(intent.isin("explanation", "chart_improvement", "business_recommendation", "clarification"),
                  F.lit("qualitative_contextual"))
            .otherwise(F.lit("unrelated")))


def deictic(text: Column) -> Column:
    """Refers to the current result (this/these/it/here/there, that result ...)."""
    q = F.lower(text)
    toks = F.regexp_extract_all(q, F.lit("[a-z0-9]+"), 0)
    return F.arrays_overlap(toks, F.array(*[F.lit(t) for t in V.DEICTIC_TOKENS])) | q.rlike(U + V.DEICTIC_PATTERN)


def relevance_score(question: Column, context: Column, has_result: Column, normalized: bool = False) -> Column:
    """K7: additive relevance of a follow-up to the prior result's text.

    Null context -> 0; an unrelated phrase -> -3.
    """
    q = _q(question, normalized)
    qt = tokens(q, V.TOKEN_STOP_WORDS)
    ct = tokens(F.coalesce(context, F.lit("")), V.TOKEN_STOP_WORDS)
    overlap = F.array_intersect(qt, ct)
    domain = F.array_intersect(overlap, F.array(*[F.lit(t) for t in V.DOMAIN_TERMS]))
    s = (F.when(deictic(q) & has_result, 2).otherwise(0)
         + F.when(F.size(domain) > 0, 2).when(F.size(overlap) > 0, 1).otherwise(0)
         + F.when(has_any(q, ("closed lost", "lost deal")) & (F.array_contains(ct, "stage")
                                                              | F.array_contains(ct, "deal_stage")), 2).otherwise(0)
         + F.when(has_result & has_any(q, V.RELEVANCE_ACTION_MARKERS), 2).otherwise(0))
    return (F.when(context.isNull(), F.lit(0)).when(has_any(q, V.UNRELATED_PHRASES), F.lit(-3))
            .otherwise(s)).cast("int")


def suggestions(context: Column) -> Column:
    """K8: next-question suggestions chosen by the prior result's text."""
    c = F.lower(F.coalesce(context, F.lit("")))
    arr = lambda key: F.array(*[F.lit(x) for x in V.FOLLOWUP_SUGGESTIONS[key]])
    return (F.when(has(c, "stage"), arr("stage"))
            .when(has_any(c, ("lead source", "source")), arr("source"))
            .when(has(c, "region"), arr("region"))
            .when(has_any(c, ("forecast", "pipeline")), arr("forecast"))
            .otherwise(arr("default")))


def rewrite_followup(question: Column, context: Column, title: Column) -> Column:
    """K8: resolve a stage or deictic reference against the prior result title."""
    q = F.lower(question)
    c = F.lower(F.coalesce(context, F.lit("")))
    t = F.coalesce(title, F.lit("the current result"))
    stage_ctx = has(c, "stage") | has(c, "deal_stage")
    return (F.when(stage_ctx & has(q, "lost deal") & has(c, "closed lost"),
                   F.concat(question, F.lit(" for the Closed Lost deal stage")))
            .when(stage_ctx & has(q, "this stage"), F.concat(question, F.lit(" about "), t))
            .when(deictic(q), F.concat(question, F.lit(" about "), t))
            .otherwise(question))


RESOLVED = ("r_metric", "r_metrics", "r_dimension", "r_dimensions", "r_filter_region", "r_dataset", "r_inherited",
            "r_intent", "r_intent_type", "r_limit", "r_sort", "r_wants_chart", "r_chart_type", "r_pipeline_only",
            "r_aggregation", "r_requires_join", "r_join_key")


def annotate_followups(questions: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """K2: resolve each question of a conversation against its context.

    ``questions`` comes from ``annotate_questions``. An answered question (one
    with a metric, its own or inherited) replaces the whole context with its
    resolved metric, metrics, dimension, dataset and region filter; a
    question that cannot be answered leaves it. Per field a question therefore
    sets a value, clears it or keeps it, and the context is the last set or
    clear before the turn. Which of the three holds depends on the context
    only through fields settled in an earlier pass, so four carries give the
    sequential result:

    1. whether an earlier question had a metric;
    2. the kind of the last answered question and the last stated metrics list;
    3. leading metric, dimension and region filter (a question without any
       metric word takes the first of the inherited list, so the first such
       question after a stated list also sets the leading metric);
    4. the metrics list and the dataset, which use the fields of pass 3.

    The early shapes (conversion, forecast quality, trend, best rep) inherit
    nothing and clear the filter. All fields that follow from metric and
    dimension are computed again after inheritance.
    """
    n, general = F.col("q_norm"), F.col("_early").isNull()
    cuts = order_cuts(questions, turn_col)
    questions = materialized(questions)  # a carry uses its input twice: the parsed questions are written once

    def carry(df: DataFrame, values: dict[str, Column]) -> DataFrame:
        return last_non_null_before(df, conv_col, turn_col, values, cuts=cuts)

    own = F.col("q_metric").isNotNull() | (F.size("q_metrics") > 0)
    d = carry(questions, {"_any": F.when(own, F.lit(True))})
    any_ = F.coalesce(F.col("_any"), F.lit(False))
    d = d.withColumns({
        "_a": general & F.col("_metric").isNull() & any_
        & (F.col("_phrase_dim").isNotNull() | F.col("_sort0").isNotNull() | F.col("_lim0").isNotNull()
           | has_any(n, V.CONTEXT_METRIC_TOKENS)),
        "_keep_dim": general & has_any(n, V.CONTEXT_DIMENSION_TOKENS),
        "_answered": own | any_, "_joined": F.lit(False)})
    d = d.withColumn("_b", general & any_ & (F.size("_metrics") == 0) & ~F.col("_a"))
    text = lambda c: F.struct(c.cast("string").alias("v"))
    stated = F.col("_answered") & ~F.col("_a") & ~F.col("_b")
    d = carry(d, {"_last": F.when(F.col("_answered"), F.when(stated, F.lit("stated")).otherwise(F.lit("inherited"))),
                  "_list": F.when(stated, F.col("q_metrics"))})
    d = carry(materialized(d), {
        "ctx_metric": F.when(stated, F.coalesce("q_metric", F.get("q_metrics", F.lit(0))))
        .when(F.col("_b") & (F.col("_last") == "stated"), F.get("_list", F.lit(0))),
        "_ctx_dim": F.when(F.col("_answered") & ~(F.col("q_dimension").isNull() & F.col("_keep_dim")), text(F.col("q_dimension"))),
        "_ctx_filter": F.when(F.col("_answered") & (~general | F.col("q_filter_region").isNotNull() | has(n, "filter")),
                              text(F.col("q_filter_region")))})
    d = d.withColumns({"ctx_dimension": F.col("_ctx_dim.v"), "ctx_filter_region": F.col("_ctx_filter.v")})
    d = d.withColumns({
        "_am": F.when(F.col("_a"), F.col("ctx_metric")).otherwise(F.col("q_metric")),
        "r_dimension": F.when(F.col("_keep_dim"), F.coalesce("q_dimension", "ctx_dimension")).otherwise(F.col("q_dimension")),
        "_dim_inherited": F.col("_keep_dim") & F.col("_phrase_dim").isNull() & F.col("ctx_dimension").isNotNull(),
        "r_filter_region": F.when(general & F.col("q_filter_region").isNull() & ~has(n, "filter"), F.col("ctx_filter_region"))
        .otherwise(F.col("q_filter_region"))})
    d = d.withColumn("r_dimensions", F.when(general, _prepend(F.col("q_dimensions"), F.col("r_dimension"))).otherwise(F.col("q_dimensions")))
    d = d.withColumn("_joined", general & F.array_contains("r_dimensions", "Customer_Type"))
    own_metrics = F.when(F.col("_a"), _prepend(F.col("q_metrics"), F.col("ctx_metric"))).otherwise(F.col("q_metrics"))
    own_dataset = (F.when(~general, F.col("q_dataset")).when(F.col("_joined"), F.lit("deals_joined_leads"))
                   .when(~any_, F.when(F.col("q_metric") == "lead_source_conversion", F.lit("leads")).otherwise(F.lit("deals"))))
    d = carry(d, {"ctx_metrics": F.when(F.col("_answered") & ~F.col("_b"), own_metrics), "ctx_dataset": F.when(F.col("_answered"), own_dataset)})
    d = d.withColumns({
        "r_metrics": F.when(F.col("_b"), F.col("ctx_metrics")).otherwise(own_metrics),
        "r_dataset": F.coalesce(own_dataset, F.col("ctx_dataset"), F.lit("deals")),
        "_rw": F.when(general, _wants_chart(n, F.col("_am"), F.col("r_dimension"))).otherwise(F.col("q_wants_chart"))})
    shape = _shape(n, F.col("_am"), F.col("r_dimension"), F.col("_rw"), F.col("_full"), F.col("_lim0"))
    resolved = {f"r_{k}": F.when(general, v).otherwise(F.col(f"q_{k}")) for k, v in shape.items()}
    d = d.withColumns({
        **resolved, "r_wants_chart": F.col("_rw"), "r_sort": F.col("q_sort"),
        "r_metric": F.when(F.col("_b"), F.get("r_metrics", F.lit(0))).otherwise(F.col("_am")),
        "r_inherited": general & (F.col("_a") | F.col("_b") | F.col("_dim_inherited")),
        "r_intent": F.when(F.col("_answered"), F.lit("analytics")).otherwise(F.lit("unsupported")),
        "r_requires_join": F.col("_joined"), "r_join_key": F.when(F.col("_joined"), F.lit("Lead_ID"))})
    return d.drop("_any", "_last", "_list", "_a", "_b", "_keep_dim", "_answered", "_ctx_dim", "_ctx_filter", "_am", "_dim_inherited", "_joined", "_rw")


def question_volume(annotated: DataFrame) -> DataFrame:
    """Question counts by metric x dimension x intent type."""
    return (annotated.groupBy(F.coalesce(F.col("q_metric"), F.lit("(none)")).alias("Metric"),
                              F.coalesce(F.col("q_dimension"), F.lit("(none)")).alias("Dimension"),
                              F.col("q_intent_type").alias("Intent_Type"))
            .agg(F.count(F.lit(1)).alias("Questions"))
            .orderBy(F.col("Questions").desc(), "Metric", "Dimension", "Intent_Type"))
