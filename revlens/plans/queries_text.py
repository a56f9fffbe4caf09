"""Question-log annotation queries over the conversation table.

User turns of ``conversations`` are the question log; the assistant turn
before a user turn is the prior result that a follow-up refers to.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from revlens.operators import textlog
from revlens.functions.text import strip_lower
from revlens.plans.distributed import last_non_null_before
from revlens.plans.registry import register
from revlens.sources.tables import Catalog

K1_FIELDS = ("q_limit", "q_sort", "q_metric", "q_dimension", "q_intent_type", "q_intent", "q_wants_chart",
             "q_chart_type", "q_time_grain", "q_percentage", "q_full_distribution", "q_comparison",
             "q_recommendation", "q_filter_region", "q_pipeline_only", "q_dataset", "q_requires_join",
             "q_join_key", "q_aggregation")


def _user_turns(spark, sf_dir):
    c = Catalog(spark, sf_dir).conversations
    return c.where(F.col("role") == "user").select("conv_id", "turn", "text")


def _with_prior_result(spark, sf_dir):
    """User turns with the last assistant text and the last user question before them."""
    c = Catalog(spark, sf_dir).conversations.select("conv_id", "turn", "role", "text")
    c = last_non_null_before(c, "conv_id", "turn", {
        "prior_result": F.when(F.col("role") == "assistant", F.col("text")),
        "prior_question": F.when(F.col("role") == "user", F.col("text"))})
    return c.where(F.col("role") == "user")


@register("annotate_questions")
def q_annotate_questions(spark, sf_dir):
    a = textlog.annotate_questions(_user_turns(spark, sf_dir))
    return a.select("conv_id", "turn", "q_norm", *K1_FIELDS,
                    F.array_join("q_metrics", ",").alias("q_metrics"),
                    F.array_join("q_dimensions", ",").alias("q_dimensions"))


@register("annotate_followups")
def q_annotate_followups(spark, sf_dir):
    a = textlog.annotate_followups(textlog.annotate_questions(_user_turns(spark, sf_dir)))
    lists = ("r_metrics", "r_dimensions")
    return a.select("conv_id", "turn", "q_metric", "q_dimension", "ctx_metric", "ctx_dimension", "ctx_filter_region", "ctx_dataset",
                    *[F.array_join(c, ",").alias(c) if c in lists else F.col(c) for c in textlog.RESOLVED])


@register("chart_intent")
def q_chart_intent(spark, sf_dir):
    u = _user_turns(spark, sf_dir).withColumn("__q", strip_lower(F.col("text")))
    return u.select("conv_id", "turn", textlog.chart_intent(F.col("__q"), normalized=True).alias("chart_intent"))


@register("qualitative_flag")
def q_qualitative_flag(spark, sf_dir):
    u = _user_turns(spark, sf_dir).withColumn("__q", strip_lower(F.col("text")))
    return u.select("conv_id", "turn", textlog.qualitative_flag(F.col("__q"), normalized=True).alias("qualitative"))


@register("followup_intents")
def q_followup_intents(spark, sf_dir):
    u = _with_prior_result(spark, sf_dir).withColumn("__q", strip_lower(F.col("text")))
    u = u.withColumn("intent", textlog.followup_intent(F.col("__q"), F.col("prior_question"), normalized=True))
    return u.select("conv_id", "turn", "intent", textlog.intent_bucket(F.col("intent")).alias("bucket"))


@register("followup_scores")
def q_followup_scores(spark, sf_dir):
    u = _with_prior_result(spark, sf_dir).withColumn("__q", strip_lower(F.col("text")))
    has_result = F.coalesce(F.length("prior_result") > 0, F.lit(False))
    u = u.withColumn("relevance", textlog.relevance_score(F.col("__q"), F.col("prior_result"), has_result,
                                                          normalized=True))
    score = F.col("relevance")
    return u.select(
        "conv_id", "turn", "relevance",
        ((score >= 2) & has_result).alias("grounded"),
        F.array_join(textlog.suggestions(F.col("prior_result")), " | ").alias("suggestions"),
        textlog.rewrite_followup(F.col("text"), F.col("prior_result"), F.col("prior_question")).alias("rewritten"))


@register("question_volume")
def q_question_volume(spark, sf_dir):
    return textlog.question_volume(textlog.annotate_questions(_user_turns(spark, sf_dir)))


@register("token_overlap")
def q_token_overlap(spark, sf_dir):
    """Meaningful tokens a follow-up shares with the prior result text."""
    from revlens.functions import vocab as V
    from revlens.functions.text import tokens
    u = _with_prior_result(spark, sf_dir)
    shared = F.array_sort(F.array_intersect(tokens(F.col("text"), V.TOKEN_STOP_WORDS),
                                            tokens(F.coalesce(F.col("prior_result"), F.lit("")), V.TOKEN_STOP_WORDS)))
    return u.select("conv_id", "turn", F.size(shared).alias("shared_tokens"),
                    F.array_join(shared, " ").alias("shared"))
