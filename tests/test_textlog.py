"""Question and follow-up annotation (K1-K8) on the reference's example sentences."""

import pytest
from pyspark.sql import functions as F

from revlens.operators import textlog


def _annotate(spark, questions):
    df = spark.createDataFrame([(i, q) for i, q in enumerate(questions)], "id int, text string")
    return {r["text"]: r for r in textlog.annotate_questions(df).collect()}


def test_grouped_questions_are_supported(spark):
    qs = ["Revenue by product category", "Pipeline by sales rep", "Average deal size by region", "Deal count by stage",
          "Margin by product category", "Win rate by lead source", "Top 5 regions by revenue",
          "Which region has the highest revenue", "Show revenue trend by month", "Show pipeline by forecast category"]
    out = _annotate(spark, qs)
    assert all(out[q]["q_intent"] == "analytics" for q in qs)
    assert out["Top 5 regions by revenue"]["q_limit"] == 5
    assert out["Top 5 regions by revenue"]["q_sort"] == "desc"
    assert out["Which region has the highest revenue"]["q_limit"] == 1
    assert out["Show revenue trend by month"]["q_intent_type"] == "time_trend"
    assert out["Show pipeline by forecast category"]["q_pipeline_only"] is False
    assert out["Pipeline by sales rep"]["q_pipeline_only"] is True


def test_synonyms(spark):
    out = _annotate(spark, ["show sales by area", "who is the best salesman", "pipeline by owner"])
    assert out["show sales by area"]["q_metric"] == "revenue"
    assert out["show sales by area"]["q_dimension"] == "Region"
    assert out["who is the best salesman"]["q_dimension"] == "Sales_Rep"
    assert out["pipeline by owner"]["q_dimension"] == "Sales_Rep"


def test_compound_question_requires_join(spark):
    q = ("Compare the performance of each customer type based on total revenue and average deal size, "
         "then identify which customer segment deserves the highest management priority.")
    r = _annotate(spark, [q])[q]
    assert r["q_requires_join"] is True and r["q_join_key"] == "Lead_ID"
    assert list(r["q_metrics"][:2]) == ["revenue", "average_deal_size"]
    assert r["q_recommendation"] is True and r["q_comparison"] is True


def test_substring_rules_are_kept(spark):
    r = _annotate(spark, ["which sales rep has the strongest pipeline"])["which sales rep has the strongest pipeline"]
    assert list(r["q_metrics"]) == ["revenue", "pipeline"]


def test_context_inheritance(spark):
    df = spark.createDataFrame([(1, 0, "Show revenue by region"), (1, 1, "now show the bottom 3 by product"),
                                (1, 2, "rank them")], "conv_id int, turn int, text string")
    a = textlog.annotate_followups(textlog.annotate_questions(df)).orderBy("turn").collect()
    assert a[1]["r_metric"] == "revenue" and a[1]["r_dimension"] == "Product_Category"
    assert a[1]["q_limit"] == 3 and a[1]["q_sort"] == "asc"
    assert a[2]["r_metric"] == "revenue" and a[2]["r_dimension"] == "Product_Category"


def test_qualitative_and_chart_flags(spark):
    qs = {"What does forecast quality mean?": True, "How should management interpret at-risk pipeline?": True,
          "What should management focus on this week?": True, "What is the total pipeline value?": False,
          "Show revenue by region.": False, "Create a chart of deals by stage.": False}
    df = spark.createDataFrame([(q,) for q in qs], "text string")
    got = {r["text"]: r["f"] for r in df.select("text", textlog.qualitative_flag(F.col("text")).alias("f")).collect()}
    assert got == qs
    c = spark.createDataFrame([("Show revenue by region",), ("What is the win rate?",)], "text string")
    flags = [r[0] for r in c.select(textlog.chart_intent(F.col("text"))).collect()]
    assert flags == [True, False]


def test_followup_intent_examples(spark):
    cases = {"what does this chart actually tell us": "explanation",
             "what are some changes i can make on this chart": "chart_improvement",
             "show this as a chart": "analytics", "create a chart by region": "analytics",
             "compare this with other sales reps": "analytics",
             "what should management do": "business_recommendation",
             "what is forecast quality": "clarification", "tell me a joke": "unrelated", "chart": "ambiguous"}
    df = spark.createDataFrame([(q, "Deals by Stage") for q in cases], "text string, title string")
    got = {r["text"]: r["i"] for r in
           df.select("text", textlog.followup_intent(F.col("text"), F.col("title")).alias("i")).collect()}
    assert got == cases


def test_relevance_of_indirect_action_followup(spark):
    ctx = "Deals by Stage. Closed Lost has 12 deals worth AED 1.2M. Focus on the Negotiation stage."
    df = spark.createDataFrame([("How should we address this?", ctx)], "q string, c string")
    s = df.select(textlog.relevance_score(F.col("q"), F.col("c"), F.lit(True)).alias("s")).first()["s"]
    assert s >= 2


def test_question_without_metric_words_inherits_the_context_metric(spark):
    df = spark.createDataFrame([(1, 0, "Show margin by product category"), (1, 1, "and for each region?"),
                                (2, 0, "hello there")], "conv_id int, turn int, text string")
    a = {(r["conv_id"], r["turn"]): r for r in textlog.annotate_followups(textlog.annotate_questions(df)).collect()}
    assert a[(1, 1)]["r_metric"] == "margin" and a[(1, 1)]["r_intent"] == "analytics"
    assert a[(2, 0)]["r_metric"] is None and a[(2, 0)]["r_intent"] == "unsupported"


def test_each_answered_question_replaces_the_whole_context(spark):
    qs = ["show revenue by region filter to dubai", "monthly pipeline trend", "total pipeline value", "which lead source has low conversion",
          "rank them", "show pipeline by sales rep", "and next week?", "total revenue", "rank it"]
    df = spark.createDataFrame([(1, i, q) for i, q in enumerate(qs)], "conv_id int, turn int, text string")
    a = {r["turn"]: r for r in textlog.annotate_followups(textlog.annotate_questions(df)).collect()}
    assert [a[i]["r_filter_region"] for i in range(4)] == ["Dubai", None, None, None]
    assert a[1]["r_dimension"] == "Closing_Date" and a[2]["r_dimension"] is None and a[3]["r_dataset"] == "leads"
    assert a[4]["r_metric"] == "lead_source_conversion" and a[4]["r_dimension"] == "Lead_Source" and a[4]["r_aggregation"] == "comparison"
    assert a[5]["r_intent_type"] == "grouped_chart" and a[5]["r_dataset"] == "leads"  # the dataset stays until a question fixes one
    assert a[6]["r_inherited"] and a[6]["r_dimension"] is None and a[6]["r_intent"] == "analytics"
    assert a[8]["r_dimension"] is None and a[8]["r_metric"] == "revenue"
