"""Differential test of the question-log queries: Spark vs the DuckDB SQL, on
questions assembled from the phrase vocabularies so that every rule fires."""

import os
import random
import tempfile

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as E
from revlens.functions import vocab as V
from revlens.operators.charts import AGGREGATION_KEYWORDS, CATEGORY_PHRASES, DATE_PHRASES, VALUE_PHRASE_TO_COLUMN
from revlens.plans.semantic import DIMENSION_SYNONYMS, METRICS

TEXT_QUERIES = ["annotate_questions", "annotate_followups", "question_volume", "chart_intent", "qualitative_flag",
                "followup_intents", "followup_scores", "chart_specs", "token_overlap"]


def _fragments():
    frags = set()
    for group in (V.FORECAST_QUALITY_PHRASES, V.LEAD_CONVERSION_PHRASES, V.TIME_TREND_PHRASES, V.CHART_KEYWORDS,
                  V.DESC_TOKENS, V.ASC_TOKENS, V.QUALITATIVE_PHRASES, V.QUANTITATIVE_BLOCKERS, V.NEW_CHART_PHRASES,
                  V.EXPLANATION_PHRASES, V.CHART_IMPROVEMENT_PHRASES, V.BUSINESS_RECOMMENDATION_PHRASES,
                  V.CLARIFICATION_PHRASES, V.UNRELATED_PHRASES, V.ANALYTICS_VERBS, V.ANALYTICS_METRICS,
                  V.CHART_BY_PATTERNS, V.CONTEXTUAL_ACTION_MARKERS, V.DOMAIN_TERMS):
        frags.update(group)
    for spec in METRICS.values():
        frags.update(spec.synonyms)
    for syns in DIMENSION_SYNONYMS.values():
        frags.update(syns)
    for d in (VALUE_PHRASE_TO_COLUMN, CATEGORY_PHRASES, DATE_PHRASES, AGGREGATION_KEYWORDS):
        frags.update(d)
    frags.update(["top 5", "bottom 3", "give me 4", "show 7", "first 2", "which", "who", "by", "filter to dubai",
                  "to dubai", "percentage", "share", "distribution", "across all", "compare", "priority", "this",
                  "that result", "it", "why is", "how should", "what does", "define", "what is", "Show", "  ",
                  "\tWHICH", "customer type", "pie chart", "closed lost", "lost deal", "this stage", "deal_stage"])
    return sorted(frags)


@pytest.fixture(scope="module")
def fixture_dir():
    rng = random.Random(11)
    frags = _fragments()
    rows = []
    for conv in range(300):
        for turn in range(rng.randint(1, 6)):
            role = "user" if turn % 2 == 0 or rng.random() < 0.3 else "assistant"
            text = " ".join(rng.choice(frags) for _ in range(rng.randint(1, 7)))
            if rng.random() < 0.1:
                text = text.upper() + " ?"
            rows.append((conv, turn, role, text))
    pdf = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"])
    pdf = pdf.astype({"conv_id": "int64", "turn": "int64"})
    d = tempfile.mkdtemp(prefix="revlens-textdiff-")
    pdf.to_parquet(os.path.join(d, "conversations.parquet"), index=False)
    return d


def _norm(v):
    if isinstance(v, float):
        return round(v, 9)
    return v


@pytest.mark.parametrize("name", TEXT_QUERIES)
def test_spark_matches_sql(spark, fixture_dir, name):
    sdf = E.queries()[name](spark, fixture_dir)
    cols = sorted(sdf.columns)
    got = sorted((tuple(_norm(r[c]) for c in cols) for r in sdf.collect()), key=repr)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{fixture_dir}/conversations.parquet')")
    res = con.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in res.description]
    assert sorted(ocols) == cols
    idx = [ocols.index(c) for c in cols]
    exp = sorted((tuple(_norm(r[i]) for i in idx) for r in res.fetchall()), key=repr)
    assert len(got) == len(exp)
    diff = [(a, b) for a, b in zip(got, exp) if a != b]
    assert not diff, diff[:3]
