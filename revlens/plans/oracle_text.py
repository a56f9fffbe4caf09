"""DuckDB oracle SQL for the question-log annotation queries.

Written as SQL CASE ladders from the same fixed phrase lists; phrase tests
are ``contains`` and the few true patterns are RE2 regular expressions.
"""

from __future__ import annotations

from revlens.functions import vocab as V
from revlens.operators.charts import (AGGREGATION_KEYWORDS, CATEGORY_PHRASES, DATE_PHRASES, DEALS_DATASET_TOKENS,
                                      LEADS_DATASET_TOKENS, VALUE_PHRASE_TO_COLUMN)
from revlens.plans.semantic import dimension_synonym_map, metric_synonym_map

WS = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def s(v: str | None) -> str:
    return "NULL" if v is None else "'" + v.replace("'", "''") + "'"


def HAS(q: str, p: str) -> str:
    return f"contains({q}, {s(p)})"


def ANY(q: str, ps) -> str:
    ps = list(ps)
    return "(" + " OR ".join(HAS(q, p) for p in ps) + ")" if ps else "FALSE"


def STARTS(q: str, ps) -> str:
    return "(" + " OR ".join(f"starts_with({q}, {s(p)})" for p in ps) + ")"


def RX(q: str, pattern: str) -> str:
    return f"regexp_matches({q}, {s(pattern)})"


def STRIP_LOWER(col: str) -> str:
    return f"regexp_replace(lower({col}), {s('^' + WS + '|' + WS + '$')}, '', 'g')"


USERS = "(SELECT conv_id, turn, text FROM conversations WHERE role = 'user')"

PRIOR = """(SELECT * FROM (
  SELECT conv_id, turn, role, text,
         last_value(CASE WHEN role = 'assistant' THEN text END IGNORE NULLS) OVER w AS prior_result,
         last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER w AS prior_question
  FROM conversations
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
 WHERE role = 'user')"""


def chart_intent_sql(col: str) -> str:
    q = STRIP_LOWER(col)
    by_rule = f"({RX(q, r'\b(show|compare|display)\b.+\b(by)\b')} AND {ANY(q, V.CHART_VALUE_TOKENS)})"
    return (f"(CASE WHEN {q} = '' THEN FALSE ELSE ({ANY(q, V.CHART_INTENT_KEYWORDS)} "
            f"OR {ANY(q, V.CHART_BY_PATTERNS)} OR {by_rule}) END)")


def qualitative_sql(col: str) -> str:
    q = STRIP_LOWER(col)
    generic = f"({ANY(q, V.QUALITATIVE_TOKENS)} AND NOT {ANY(q, V.QUALITATIVE_EXCLUDES)})"
    return (f"(CASE WHEN {q} = '' THEN FALSE WHEN {chart_intent_sql(col)} THEN FALSE "
            f"WHEN {ANY(q, V.QUANTITATIVE_BLOCKERS)} THEN FALSE "
            f"ELSE ({ANY(q, V.QUALITATIVE_PHRASES)} OR {generic}) END)")


def followup_intent_sql(col: str, title: str) -> str:
    q = STRIP_LOWER(col)
    t = f"COALESCE(lower({title}), '')"
    action = "(" + " OR ".join(RX(q, p) for p in V.QUALITATIVE_ACTION_PATTERNS) + f" OR {ANY(q, V.ACTION_MARKERS)})"
    return f"""(CASE WHEN {q} = '' THEN 'ambiguous'
  WHEN {ANY(q, V.UNRELATED_PHRASES)} THEN 'unrelated'
  WHEN {RX(q, V.RANKING_FOLLOWUP_PATTERN)} THEN 'analytics'
  WHEN {action} THEN (CASE WHEN {ANY(q, V.EXPLANATION_KEYWORDS)} THEN 'explanation' ELSE 'business_recommendation' END)
  WHEN {ANY(q, V.ANALYTICS_OVERRIDE_TOKENS)} THEN 'analytics'
  WHEN {ANY(q, V.CHART_IMPROVEMENT_PHRASES)} THEN 'chart_improvement'
  WHEN {ANY(q, V.BUSINESS_RECOMMENDATION_PHRASES)} THEN 'business_recommendation'
  WHEN {ANY(q, V.CLARIFICATION_PHRASES)} THEN 'clarification'
  WHEN {ANY(q, V.EXPLANATION_PHRASES)} THEN 'explanation'
  WHEN {ANY(q, V.NEW_CHART_PHRASES)} THEN 'analytics'
  WHEN {ANY(q, V.ANALYTICS_SHORT_TOKENS)} THEN 'analytics'
  WHEN {STARTS(q, V.CLARIFICATION_PREFIXES)} THEN 'clarification'
  WHEN {ANY(q, V.BUSINESS_RECOMMENDATION_KEYWORDS)} THEN 'business_recommendation'
  WHEN {ANY(q, V.EXPLANATION_KEYWORDS)} THEN 'explanation'
  WHEN {ANY(q, V.CONTEXTUAL_ACTION_MARKERS)} THEN 'business_recommendation'
  WHEN {ANY(q, V.ANALYTICS_VERBS)} AND ({ANY(q, V.ANALYTICS_METRICS)} OR {ANY(q, V.CHART_NOUNS)}) THEN 'analytics'
  WHEN {ANY(q, V.ANALYTICS_METRICS)} THEN 'analytics'
  WHEN {q} IN ({', '.join(s(x) for x in V.CHART_NOUNS)}) THEN 'ambiguous'
  WHEN contains({q}, 'chart') AND (contains({q}, 'improve') OR contains({q}, 'present')) THEN 'chart_improvement'
  WHEN {t} <> '' AND {ANY(q, ('this', 'it', 'that'))} THEN 'explanation'
  ELSE 'ambiguous' END)"""


def _longest(n: str, mapping: dict) -> str:
    rows = ", ".join(f"({s(p)}, {s(v)}, {len(p)}, {i})" for i, (p, v) in enumerate(mapping.items()))
    return (f"(SELECT t.v FROM (VALUES {rows}) t(p, v, l, o) WHERE contains({n}, t.p) "
            f"ORDER BY t.l DESC, t.o ASC LIMIT 1)")


def _hits(n: str, groups: dict) -> str:
    parts = ", ".join(f"CASE WHEN {ANY(n, ps)} THEN {s(name)} END" for name, ps in groups.items())
    return f"list_filter([{parts}], lambda x: x IS NOT NULL)"


def annotate_sql(parts: bool = False) -> str:
    n = "n"
    lim0 = "TRY_CAST(COALESCE(" + ", ".join(
        f"CASE WHEN {RX(n, p)} THEN regexp_extract({n}, {s(p)}, 1) END" for p in V.LIMIT_PATTERNS) + ") AS BIGINT)"
    sort0 = f"CASE WHEN {ANY(n, V.ASC_TOKENS)} THEN 'asc' WHEN {ANY(n, V.DESC_TOKENS)} THEN 'desc' END"
    early = (f"CASE WHEN {ANY(n, V.LEAD_CONVERSION_PHRASES)} AND {HAS(n, 'source')} THEN 'conversion' "
             f"WHEN {ANY(n, V.FORECAST_QUALITY_PHRASES)} AND {ANY(n, ('product', 'category'))} THEN 'forecast_quality' "
             f"WHEN {ANY(n, V.TIME_TREND_PHRASES)} OR ({HAS(n, 'trend')} AND "
             f"{ANY(n, ('month', 'closing date', 'close date'))}) THEN 'trend' "
             f"WHEN {ANY(n, ('best salesman', 'best salesperson', 'best sales rep'))} THEN 'best_rep' END")
    metric = (f"CASE WHEN {ANY(n, ('average deal size', 'avg deal size'))} THEN 'average_deal_size' "
              f"WHEN {HAS(n, 'win rate')} THEN 'win_rate' WHEN {HAS(n, 'margin')} THEN 'margin' "
              f"WHEN {ANY(n, ('deal count', 'number of deals'))} THEN 'deal_count' "
              f"WHEN {HAS(n, 'pipeline')} THEN 'pipeline' "
              f"WHEN {ANY(n, ('revenue', 'sales', 'amount', 'value'))} THEN 'revenue' ELSE pm END")
    dim = (f"CASE WHEN {ANY(n, ('product name', 'item name', 'sku'))} THEN 'Product_Name' "
           f"WHEN {ANY(n, ('product category', 'products', 'product'))} THEN 'Product_Category' "
           f"WHEN {ANY(n, ('account', 'customer'))} AND NOT {HAS(n, 'customer type')} "
           f"AND NOT {HAS(n, 'customer segment')} THEN 'Account_Name' "
           f"WHEN {ANY(n, ('regions', 'region', 'dubai'))} THEN "
           f"(CASE WHEN {ANY(n, ('by region', 'regions', 'region'))} THEN 'Region' ELSE pd END) "
           f"WHEN {ANY(n, ('sales rep', 'sales reps', 'owner'))} THEN 'Sales_Rep' "
           f"WHEN {ANY(n, ('customer type', 'customer segment', 'segment'))} THEN 'Customer_Type' ELSE pd END")
    grouped = "COALESCE(metric IN ('revenue','pipeline','average_deal_size','deal_count','margin','win_rate'), FALSE)"
    explicit = ANY(n, V.CHART_KEYWORDS)
    wants = (f"CASE WHEN metric = 'deal_count' AND dim = 'Deal_Stage' AND NOT {explicit} THEN FALSE "
             f"ELSE COALESCE({explicit} OR ({HAS(n, ' by ')} AND {grouped} "
             f"AND {STARTS(n, V.GROUPED_CHART_PREFIXES)}), FALSE) END")
    prepend = ("CASE WHEN {m} IS NULL OR list_contains({a}, {m}) THEN {a} ELSE list_prepend({m}, {a}) END")
    stage1 = f"""SELECT conv_id, turn, {n}, {lim0} AS lim0, {sort0} AS sort0, {early} AS early,
  {_longest(n, metric_synonym_map())} AS pm, {_longest(n, dimension_synonym_map())} AS pd,
  {_hits(n, V.METRIC_KEYWORDS)} AS kwm, {_hits(n, V.DIMENSION_HINTS)} AS kwd
FROM (SELECT conv_id, turn, trim(regexp_replace(lower(text), {s(WS)}, ' ', 'g')) AS n FROM {USERS})"""
    stage2 = f"SELECT *, {metric} AS metric, {dim} AS dim FROM ({stage1})"
    stage3 = (f"SELECT *, {prepend.format(m='metric', a='kwm')} AS metrics, {prepend.format(m='dim', a='kwd')} AS dims, "
              f"{wants} AS wants, {ANY(n, ('distribution', 'all regions', 'across all', 'of each'))} AS full_d "
              f"FROM ({stage2})")
    gd = f"({grouped} AND dim IS NOT NULL)"
    who = ANY(n, ("which ", "who "))
    itype = (f"CASE WHEN {who} AND {gd} THEN (CASE WHEN wants OR full_d THEN 'grouped_chart' ELSE 'grouped_metric' END) "
             f"WHEN metric = 'deal_count' AND dim = 'Deal_Stage' AND NOT wants THEN 'table' "
             f"WHEN {gd} AND wants THEN 'grouped_chart' WHEN {gd} THEN 'grouped_metric' "
             f"WHEN wants AND metric IS NOT NULL THEN 'chart' ELSE 'metric' END")
    lim = (f"CASE WHEN {HAS(n, 'worst')} AND l2 IS NULL THEN 3 ELSE l2 END")
    l1 = (f"CASE WHEN {ANY(n, ('highest revenue', 'most revenue', 'strongest pipeline'))} AND dim IS NOT NULL "
          f"THEN COALESCE(lim0, 1) ELSE lim0 END")
    l2 = f"CASE WHEN {who} THEN COALESCE(l1, 1) ELSE l1 END"
    joined = "list_contains(dims, 'Customer_Type')"
    general = {
        "q_limit": lim, "q_sort": "sort0", "q_metric": "metric", "q_metrics": "metrics", "q_dimension": "dim",
        "q_dimensions": "dims", "q_intent_type": itype,
        "q_intent": "CASE WHEN metric IS NOT NULL OR len(metrics) > 0 THEN 'analytics' ELSE 'unsupported' END",
        "q_wants_chart": "wants",
        "q_chart_type": (f"CASE WHEN {HAS(n, 'pie chart')} THEN 'pie' WHEN {ANY(n, ('trend', 'month'))} THEN 'line' "
                         f"WHEN wants THEN 'bar' END"),
        "q_time_grain": f"CASE WHEN {HAS(n, 'month')} THEN 'month' END",
        "q_percentage": ANY(n, ("percentage", "percent", "share")),
        "q_full_distribution": "full_d",
        "q_comparison": ANY(n, ("compare", "comparison", "performance of each")),
        "q_recommendation": ANY(n, ("management priority", "management focus", "recommend", "recommendation",
                                    "priority")),
        "q_filter_region": (f"CASE WHEN {HAS(n, 'filter to dubai')} OR ends_with({n}, 'to dubai') OR "
                            f"({HAS(n, 'to dubai')} AND {HAS(n, 'filter')}) THEN 'Dubai' END"),
        "q_pipeline_only": "COALESCE(metric = 'pipeline' AND NOT COALESCE(dim = 'Forecast_Category', FALSE), FALSE)",
        "q_dataset": (f"CASE WHEN {joined} THEN 'deals_joined_leads' WHEN metric = 'lead_source_conversion' "
                      f"THEN 'leads' ELSE 'deals' END"),
        "q_requires_join": joined,
        "q_join_key": f"CASE WHEN {joined} THEN 'Lead_ID' END",
        "q_aggregation": ("CASE WHEN metric = 'average_deal_size' THEN 'mean' WHEN metric = 'deal_count' THEN 'count' "
                          "WHEN metric IN ('win_rate', 'forecast_quality') THEN 'ratio' "
                          "WHEN metric = 'lead_source_conversion' THEN 'comparison' ELSE 'sum' END"),
    }
    tm = f"CASE WHEN {HAS(n, 'pipeline')} THEN 'monthly_pipeline_trend' ELSE 'revenue' END"
    early_vals = {
        "conversion": dict(q_limit="1", q_sort="'desc'", q_metric="'lead_source_conversion'",
                           q_metrics="['lead_source_conversion']", q_dimension="'Lead_Source'",
                           q_dimensions="['Lead_Source']", q_intent_type="'advanced'", q_wants_chart="FALSE",
                           q_chart_type="NULL", q_time_grain="NULL", q_dataset="'leads'", q_aggregation="'comparison'"),
        "forecast_quality": dict(q_limit="1", q_sort="'desc'", q_metric="'forecast_quality'",
                                 q_metrics="['forecast_quality']", q_dimension="'Product_Category'",
                                 q_dimensions="['Product_Category']", q_intent_type="'advanced'",
                                 q_wants_chart="FALSE", q_chart_type="NULL", q_time_grain="NULL",
                                 q_dataset="'deals'", q_aggregation="'ratio'"),
        "trend": dict(q_limit="NULL", q_sort="NULL", q_metric=tm, q_metrics=f"[{tm}]", q_dimension="'Closing_Date'",
                      q_dimensions="['Closing_Date']", q_intent_type="'time_trend'", q_wants_chart="TRUE",
                      q_chart_type="'line'", q_time_grain="'month'", q_dataset="'deals'", q_aggregation="'sum'",
                      q_pipeline_only=HAS(n, "pipeline")),
        "best_rep": dict(q_limit="1", q_sort="'desc'", q_metric="'pipeline'", q_metrics="['pipeline']",
                         q_dimension="'Sales_Rep'", q_dimensions="['Sales_Rep']", q_intent_type="'rank'",
                         q_wants_chart="FALSE", q_chart_type="NULL", q_time_grain="NULL", q_dataset="'deals'",
                         q_aggregation="'sum'"),
    }
    defaults = dict(q_intent="'analytics'", q_percentage="FALSE", q_full_distribution="FALSE", q_comparison="FALSE",
                    q_recommendation="FALSE", q_filter_region="NULL", q_pipeline_only="FALSE",
                    q_requires_join="FALSE", q_join_key="NULL")
    cols = []
    for field, expr in general.items():
        whens = " ".join(f"WHEN early = '{k}' THEN {early_vals[k].get(field, defaults.get(field))}"
                         for k in ("conversion", "forecast_quality", "trend", "best_rep"))
        cols.append(f"CASE {whens} ELSE {expr} END AS {field}")
    stage4 = f"SELECT *, {l1} AS l1 FROM ({stage3})"
    stage5 = f"SELECT *, {l2} AS l2 FROM ({stage4})"
    more = ", lim0, sort0, early, pd AS phrase_dim, metric AS own_metric, metrics AS own_metrics, dims AS own_dims, full_d" if parts else ""
    return f"SELECT conv_id, turn, {n} AS q_norm, {', '.join(cols)}{more} FROM ({stage5})"


def followups_sql() -> str:
    """K2, turn by turn: a recursive step over the questions of each conversation.

    c_* is the context before the question; an answered question replaces all of it.
    """
    n, grouped = "q_norm", "('revenue','pipeline','average_deal_size','deal_count','margin','win_rate')"
    step1 = f"""SELECT b.*, c.n_has AS c_has, c.n_metric AS c_metric, c.n_metrics AS c_metrics, c.n_dim AS c_dim,
          c.n_dataset AS c_dataset, c.n_filter AS c_filter, b.early IS NULL AS general,
          b.early IS NULL AND b.own_metric IS NULL AND c.n_has AND (b.phrase_dim IS NOT NULL OR b.sort0 IS NOT NULL
            OR b.lim0 IS NOT NULL OR {ANY('b.q_norm', V.CONTEXT_METRIC_TOKENS)}) AS by_words
        FROM steps c JOIN b ON b.conv_id = c.conv_id AND b.rn = c.rn + 1"""
    step2 = f"""SELECT *, CASE WHEN by_words THEN COALESCE(c_metric, c_metrics[1]) ELSE q_metric END AS m1,
          CASE WHEN general AND q_dimension IS NULL AND {ANY(n, V.CONTEXT_DIMENSION_TOKENS)} THEN c_dim ELSE q_dimension END AS r_dimension,
          general AND phrase_dim IS NULL AND c_dim IS NOT NULL AND {ANY(n, V.CONTEXT_DIMENSION_TOKENS)} AS dim_in,
          CASE WHEN NOT general OR q_filter_region IS NOT NULL OR contains({n}, 'filter') THEN q_filter_region ELSE c_filter END AS r_filter_region
        FROM ({step1})"""
    step3 = f"""SELECT *, CASE WHEN m1 IS NULL OR list_contains(q_metrics, m1) THEN q_metrics ELSE list_prepend(m1, q_metrics) END AS ms1,
          CASE WHEN r_dimension IS NULL OR list_contains(q_dimensions, r_dimension) THEN q_dimensions
            ELSE list_prepend(r_dimension, q_dimensions) END AS dims1,
          CASE WHEN NOT general THEN q_wants_chart WHEN m1 = 'deal_count' AND r_dimension = 'Deal_Stage' AND NOT {ANY(n, V.CHART_KEYWORDS)} THEN FALSE
            ELSE COALESCE({ANY(n, V.CHART_KEYWORDS)} OR (contains({n}, ' by ') AND COALESCE(m1 IN {grouped}, FALSE)
              AND {STARTS(n, V.GROUPED_CHART_PREFIXES)}), FALSE) END AS r_wants_chart
        FROM ({step2})"""
    gd = f"(COALESCE(m1 IN {grouped}, FALSE) AND r_dimension IS NOT NULL)"
    who = ANY(n, ("which ", "who "))
    step4 = f"""SELECT *, general AND len(ms1) = 0 AND c_has AS by_list,
          general AND list_contains(dims1, 'Customer_Type') AS r_requires_join,
          CASE WHEN NOT general THEN q_intent_type
            WHEN {who} AND {gd} THEN (CASE WHEN r_wants_chart OR full_d THEN 'grouped_chart' ELSE 'grouped_metric' END)
            WHEN m1 = 'deal_count' AND r_dimension = 'Deal_Stage' AND NOT r_wants_chart THEN 'table'
            WHEN {gd} AND r_wants_chart THEN 'grouped_chart' WHEN {gd} THEN 'grouped_metric'
            WHEN r_wants_chart AND m1 IS NOT NULL THEN 'chart' ELSE 'metric' END AS r_intent_type,
          CASE WHEN {ANY(n, ('highest revenue', 'most revenue', 'strongest pipeline'))} AND r_dimension IS NOT NULL OR {who}
            THEN COALESCE(lim0, 1) ELSE lim0 END AS l1,
          CASE WHEN NOT general THEN q_chart_type WHEN contains({n}, 'pie chart') THEN 'pie'
            WHEN {ANY(n, ('trend', 'month'))} THEN 'line' WHEN r_wants_chart THEN 'bar' END AS r_chart_type,
          CASE WHEN NOT general THEN q_pipeline_only ELSE COALESCE(m1 = 'pipeline' AND r_dimension IS DISTINCT FROM 'Forecast_Category', FALSE) END AS r_pipeline_only,
          CASE WHEN NOT general THEN q_aggregation WHEN m1 = 'average_deal_size' THEN 'mean' WHEN m1 = 'deal_count' THEN 'count'
            WHEN m1 IN ('win_rate', 'forecast_quality') THEN 'ratio' WHEN m1 = 'lead_source_conversion' THEN 'comparison' ELSE 'sum' END AS r_aggregation
        FROM ({step3})"""
    step5 = f"""SELECT *, CASE WHEN by_list THEN c_metrics[1] ELSE m1 END AS r_metric, CASE WHEN by_list THEN c_metrics ELSE ms1 END AS r_metrics,
          CASE WHEN NOT general THEN q_limit WHEN contains({n}, 'worst') AND l1 IS NULL THEN 3 ELSE l1 END AS r_limit,
          CASE WHEN NOT general THEN q_dataset WHEN r_requires_join THEN 'deals_joined_leads' WHEN c_dataset IS NOT NULL THEN c_dataset
            WHEN m1 = 'lead_source_conversion' THEN 'leads' ELSE 'deals' END AS r_dataset
        FROM ({step4})"""
    keep = ("conv_id", "rn", "turn", "q_metric", "q_dimension", "c_metric", "c_dim", "c_filter", "c_dataset", "r_metric", "r_metrics", "r_dimension", "dims1",
            "r_filter_region", "r_dataset", "r_inherited", "r_intent", "r_intent_type", "r_limit", "q_sort", "r_wants_chart", "r_chart_type",
            "r_pipeline_only", "r_aggregation", "r_requires_join")
    step6 = f"""SELECT *, general AND (by_words OR by_list OR dim_in) AS r_inherited, r_metric IS NOT NULL OR len(r_metrics) > 0 AS answered,
          CASE WHEN r_metric IS NOT NULL OR len(r_metrics) > 0 THEN 'analytics' ELSE 'unsupported' END AS r_intent FROM ({step5})"""
    step = f"""SELECT {', '.join(keep)}, c_has OR answered AS n_has,
          CASE WHEN answered THEN COALESCE(r_metric, r_metrics[1]) ELSE c_metric END AS n_metric,
          CASE WHEN answered THEN r_metrics ELSE c_metrics END AS n_metrics, CASE WHEN answered THEN r_dimension ELSE c_dim END AS n_dim,
          CASE WHEN answered THEN r_dataset ELSE c_dataset END AS n_dataset, CASE WHEN answered THEN r_filter_region ELSE c_filter END AS n_filter
        FROM ({step6})"""
    kind = {"rn": "BIGINT", "turn": "BIGINT", "r_metrics": "VARCHAR[]", "dims1": "VARCHAR[]", "r_inherited": "BOOLEAN", "r_limit": "BIGINT",
            "r_wants_chart": "BOOLEAN", "r_pipeline_only": "BOOLEAN", "r_requires_join": "BOOLEAN"}
    start = ", ".join("conv_id" if k == "conv_id" else f"CAST({0 if k == 'rn' else 'NULL'} AS {kind.get(k, 'VARCHAR')}) AS {k}" for k in keep)
    return f"""WITH RECURSIVE b AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM ({annotate_sql(True)})),
      steps AS (SELECT {start}, FALSE AS n_has, CAST(NULL AS VARCHAR) AS n_metric, CAST(NULL AS VARCHAR[]) AS n_metrics, CAST(NULL AS VARCHAR) AS n_dim,
          CAST(NULL AS VARCHAR) AS n_dataset, CAST(NULL AS VARCHAR) AS n_filter FROM (SELECT DISTINCT conv_id FROM b)
        UNION ALL {step})
      SELECT conv_id, turn, q_metric, q_dimension, c_metric AS ctx_metric, c_dim AS ctx_dimension, c_filter AS ctx_filter_region,
        c_dataset AS ctx_dataset, r_metric, array_to_string(r_metrics, ',') AS r_metrics, r_dimension, array_to_string(dims1, ',') AS r_dimensions,
        r_filter_region, r_dataset, r_inherited, r_intent, r_intent_type, r_limit, q_sort AS r_sort, r_wants_chart, r_chart_type,
        r_pipeline_only, r_aggregation, r_requires_join, CASE WHEN r_requires_join THEN 'Lead_ID' END AS r_join_key FROM steps WHERE rn > 0"""


def followup_score_sql() -> str:
    q = STRIP_LOWER("text")
    stop = ", ".join(s(w) for w in sorted(V.TOKEN_STOP_WORDS))
    dom = ", ".join(s(w) for w in V.DOMAIN_TERMS)

    def toks(x: str) -> str:
        return (f"list_distinct(list_filter(regexp_extract_all(lower({x}), '[a-z0-9]+'), "
                f"lambda t: length(t) > 1 AND NOT list_contains([{stop}], t)))")
    deictic = (f"(len(list_intersect(regexp_extract_all({q}, '[a-z0-9]+'), "
               f"[{', '.join(s(t) for t in V.DEICTIC_TOKENS)}])) > 0 OR {RX(q, V.DEICTIC_PATTERN)})")
    ctx_toks = toks("COALESCE(prior_result, '')")
    base = (f"SELECT conv_id, turn, text, prior_result, prior_question, {q} AS q, {toks('text')} AS qt, "
            f"{ctx_toks} AS ct, COALESCE(length(prior_result) > 0, FALSE) AS has_result "
            f"FROM {PRIOR}")
    score = (f"CASE WHEN prior_result IS NULL THEN 0 WHEN {ANY('q', V.UNRELATED_PHRASES)} THEN -3 ELSE "
             f"(CASE WHEN {deictic.replace(q, 'q')} AND has_result THEN 2 ELSE 0 END) "
             f"+ (CASE WHEN len(list_intersect(list_intersect(qt, ct), [{dom}])) > 0 THEN 2 "
             f"WHEN len(list_intersect(qt, ct)) > 0 THEN 1 ELSE 0 END) "
             f"+ (CASE WHEN {ANY('q', ('closed lost', 'lost deal'))} AND (list_contains(ct, 'stage') "
             f"OR list_contains(ct, 'deal_stage')) THEN 2 ELSE 0 END) "
             f"+ (CASE WHEN has_result AND {ANY('q', V.RELEVANCE_ACTION_MARKERS)} THEN 2 ELSE 0 END) END")
    c = "lower(COALESCE(prior_result, ''))"
    sug = {k: s(" | ".join(v)) for k, v in V.FOLLOWUP_SUGGESTIONS.items()}
    suggestions = (f"CASE WHEN contains({c}, 'stage') THEN {sug['stage']} "
                   f"WHEN contains({c}, 'lead source') OR contains({c}, 'source') THEN {sug['source']} "
                   f"WHEN contains({c}, 'region') THEN {sug['region']} "
                   f"WHEN contains({c}, 'forecast') OR contains({c}, 'pipeline') THEN {sug['forecast']} "
                   f"ELSE {sug['default']} END")
    ql = "lower(text)"
    title = "COALESCE(prior_question, 'the current result')"
    stage_ctx = f"(contains({c}, 'stage') OR contains({c}, 'deal_stage'))"
    deictic_raw = (f"(len(list_intersect(regexp_extract_all({ql}, '[a-z0-9]+'), "
                   f"[{', '.join(s(t) for t in V.DEICTIC_TOKENS)}])) > 0 OR {RX(ql, V.DEICTIC_PATTERN)})")
    rewrite = (f"CASE WHEN {stage_ctx} AND contains({ql}, 'lost deal') AND contains({c}, 'closed lost') "
               f"THEN text || ' for the Closed Lost deal stage' "
               f"WHEN {stage_ctx} AND contains({ql}, 'this stage') THEN text || ' about ' || {title} "
               f"WHEN {deictic_raw} THEN text || ' about ' || {title} ELSE text END")
    return (f"SELECT conv_id, turn, CAST({score} AS INTEGER) AS relevance, "
            f"(({score}) >= 2 AND has_result) AS grounded, {suggestions} AS suggestions, "
            f"{rewrite} AS rewritten FROM ({base})")


def chart_spec_sql() -> str:
    q = STRIP_LOWER("text")

    def first(col: str, phrases) -> str:
        return "CASE " + " ".join(f"WHEN contains({col}, {s(p)}) THEN {s(p)}" for p in phrases) + " END"

    def lookup(key: str, mapping: dict) -> str:
        return "CASE " + " ".join(f"WHEN {key} = {s(k)} THEN {s(v) if v else 'NULL'}" for k, v in mapping.items()) \
            + " END"
    st1 = (f"SELECT conv_id, turn, q, CASE WHEN {ANY('q', LEADS_DATASET_TOKENS)} THEN 'leads' "
           f"WHEN {ANY('q', DEALS_DATASET_TOKENS)} THEN 'deals' WHEN contains(q, 'source') THEN 'leads' "
           f"ELSE 'deals' END AS ds0, {first('q', CATEGORY_PHRASES)} AS cat, {first('q', DATE_PHRASES)} AS dt, "
           f"{first('q', AGGREGATION_KEYWORDS)} AS aggk FROM (SELECT conv_id, turn, {q} AS q FROM {USERS})")
    lm = {p: lc for p, (lc, dc) in CATEGORY_PHRASES.items()}
    dm = {p: dc for p, (lc, dc) in CATEGORY_PHRASES.items()}
    st2 = (f"SELECT *, CASE WHEN ds0 = 'leads' THEN {lookup('cat', lm)} ELSE {lookup('cat', dm)} END AS xcat "
           f"FROM ({st1})")
    use = "(xcat IS NULL AND dt IS NOT NULL)"
    st3 = (f"SELECT *, CASE WHEN {use} THEN {lookup('dt', {p: d for p, (d, c) in DATE_PHRASES.items()})} "
           f"ELSE ds0 END AS ds, CASE WHEN {use} THEN {lookup('dt', {p: c for p, (d, c) in DATE_PHRASES.items()})} "
           f"ELSE xcat END AS x, CASE WHEN {use} AND contains(q, 'month') THEN 'month' END AS grain FROM ({st2})")
    y0 = ("COALESCE(CASE " + " ".join(
        f"WHEN contains(q, {s(p)}) AND NOT (ds = 'leads' AND {s(c)} = 'Amount') THEN {s(c)}"
        for p, c in VALUE_PHRASE_TO_COLUMN.items()) + " END, CASE WHEN contains(q, 'leads by') AND ds = 'leads' "
          "THEN 'Lead_ID' WHEN contains(q, 'deals by') AND ds = 'deals' THEN 'Deal_ID' END)")
    st4 = f"SELECT *, {y0} AS y0 FROM ({st3})"
    st5 = (f"SELECT *, COALESCE({lookup('aggk', AGGREGATION_KEYWORDS)}, CASE WHEN y0 IN ('Amount', 'Estimated_Value') "
           f"THEN 'sum' ELSE 'count' END) AS agg FROM ({st4})")
    st6 = (f"SELECT *, CASE WHEN agg = 'count' THEN (CASE WHEN ds = 'leads' THEN 'Lead_ID' ELSE 'Deal_ID' END) "
           f"ELSE y0 END AS y, contains(q, 'pipeline') AND ds = 'deals' AS pipe FROM ({st5})")
    x_label = "CASE WHEN grain = 'month' THEN 'Month of ' || replace(x, '_', ' ') ELSE replace(x, '_', ' ') END"
    base = ("CASE WHEN agg = 'count' THEN (CASE WHEN ds = 'leads' THEN 'Lead Count' ELSE 'Deal Count' END) "
            "WHEN agg = 'mean' THEN (CASE WHEN y = 'Amount' THEN 'Average Deal Size' "
            "ELSE 'Average ' || replace(y, '_', ' ') END) "
            "WHEN y = 'Amount' THEN (CASE WHEN pipe THEN 'Pipeline' ELSE 'Revenue' END) "
            "WHEN y = 'Estimated_Value' THEN 'Estimated Lead Value' ELSE replace(y, '_', ' ') END")
    return (f"SELECT conv_id, turn, ds AS dataset, x AS x_column, y AS y_column, agg AS aggregation, "
            f"CASE WHEN grain = 'month' THEN 'line' ELSE 'bar' END AS chart_type, "
            f"({base}) || ' by ' || ({x_label}) AS title, grain AS time_grain, pipe AS pipeline_filter, "
            f"(q <> '' AND x IS NOT NULL AND y IS NOT NULL) AS supported FROM ({st6})")


def register(sql) -> None:
    sql("chart_intent", f"SELECT conv_id, turn, {chart_intent_sql('text')} AS chart_intent FROM {USERS}")
    sql("qualitative_flag", f"SELECT conv_id, turn, {qualitative_sql('text')} AS qualitative FROM {USERS}")
    intent = followup_intent_sql("text", "prior_question")
    bucket = (f"CASE WHEN i = 'analytics' THEN 'quantitative' WHEN i IN ('explanation', 'chart_improvement', "
              f"'business_recommendation', 'clarification') THEN 'qualitative_contextual' ELSE 'unrelated' END")
    sql("followup_intents", f"SELECT conv_id, turn, i AS intent, {bucket} AS bucket FROM "
                            f"(SELECT conv_id, turn, {intent} AS i FROM {PRIOR})")
    ann = annotate_sql()
    sql("annotate_questions", f"""SELECT * EXCLUDE (q_metrics, q_dimensions),
        array_to_string(q_metrics, ',') AS q_metrics, array_to_string(q_dimensions, ',') AS q_dimensions
        FROM ({ann})""")
    sql("question_volume", f"""SELECT COALESCE(q_metric, '(none)') AS Metric, COALESCE(q_dimension, '(none)') AS Dimension,
        q_intent_type AS Intent_Type, COUNT(*) AS Questions FROM ({ann}) GROUP BY ALL""")
    sql("annotate_followups", followups_sql())
    sql("followup_scores", followup_score_sql())
    sql("chart_specs", chart_spec_sql())
