"""Insight, document and retrieval queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from revlens.operators import buckets, documents, insights, joins, report, retrieval, vector_index
from revlens.plans.registry import Modules, register
from revlens.sources.ingest import shared_dir
from revlens.sources.tables import Catalog


def _report(m: Modules, several: bool = True):
    """Leads, enriched Deals and their one-pass aggregates."""
    leads, deals = m.leads, m.deals
    # Region (from Accounts) and Product_Category (from Products): key-deduplicated lookups (C4)
    d = joins.with_lookup(deals, m.accounts, "Account_ID", ["Region"])
    d = joins.with_lookup(d, m.products, "Product_ID", ["Product_Category"])
    return leads, d, report.build(leads, d, base=deals, several=several)


def _flat(docs):
    return docs.select("id", "text", "metadata.source_type", "metadata.module", "metadata.topic",
                       "metadata.created_by", "Doc_Order")


@register("auto_insights")
def q_auto_insights(spark, sf_dir):
    return insights.auto_insights(*_report(Modules(spark, sf_dir), several=False))


@register("management_focus")
def q_management_focus(spark, sf_dir):
    return insights.management_focus(Modules(spark, sf_dir).deals)


@register("summary_documents")
def q_summary_documents(spark, sf_dir):
    leads, d, r = _report(Modules(spark, sf_dir))
    return _flat(documents.summary_documents(leads, d, insights.auto_insights(leads, d, r), r))


@register("rag_documents")
def q_rag_documents(spark, sf_dir):
    leads, d, r = _report(Modules(spark, sf_dir))
    return _flat(documents.rag_documents(spark, leads, d, insights.auto_insights(leads, d, r), r))


@register("vector_top_k")
def q_vector_top_k(spark, sf_dir):
    """The 5 nearest vectors (squared L2) to each label's exemplar vector."""
    emb = Catalog(spark, sf_dir).embeddings
    q = retrieval.exemplar_queries(emb)
    top = retrieval.vector_top_k(emb, q, k=5)
    return top.join(emb.select("vec_id", "label"), "vec_id").select(
        "query_id", "rank", "vec_id", "label", "distance")


@register("vector_neighbours")
def q_vector_neighbours(spark, sf_dir):
    """J5 with queries that grow with the corpus: the 5 nearest vectors of every 50th id, from a partitioned index."""
    emb = Catalog(spark, sf_dir).embeddings
    q = emb.where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    return vector_index.search(vector_index.build(emb), q, k=5).select("query_id", "rank", "vec_id", "distance")


@register("context_text")
def q_context_text(spark, sf_dir):
    """J7 over the vector results: per query, numbered context lines naming each
    retrieved vector (source type, label topic, id) in rank order."""
    emb = Catalog(spark, sf_dir).embeddings
    top = retrieval.vector_top_k(emb, retrieval.exemplar_queries(emb), k=5)
    res = top.join(emb.select("vec_id", "label"), "vec_id").select(
        "query_id", "rank", F.concat(F.lit("vector "), F.col("vec_id").cast("string")).alias("text"),
        F.struct(F.lit("embedding").alias("source_type"),
                 F.concat(F.lit("label "), F.col("label").cast("string")).alias("topic")).alias("metadata"))
    return documents.context_text(res, "query_id")


@register("corpus_upsert")
def q_corpus_upsert(spark, sf_dir):
    """Every second vector arrives again, doubled; a third of these without a version."""
    emb = Catalog(spark, sf_dir).embeddings
    old = emb.select(F.col("vec_id").alias("id"), "embedding", F.lit(None).cast("bigint").alias("version"))
    new = emb.where(F.col("vec_id") % 2 == 0).select(
        F.col("vec_id").alias("id"), F.transform("embedding", lambda x: (x * 2).cast("float")).alias("embedding"),
        F.when(F.col("vec_id") % 3 != 0, F.col("vec_id") % 5).alias("version"))
    best = retrieval.corpus_upsert(old, new)
    return best.select("id", F.aggregate("embedding", F.lit(0.0).cast("double"), lambda a, x: a + x.cast("double")).alias("total"),
                       F.size("embedding").cast("bigint").alias("dimensions"), "version")


@register("corpus_merge")
def q_corpus_merge(spark, sf_dir):
    """J6 on a stored corpus: each 100th vector arrives again, doubled, a third of these without a version; only the buckets of
    their ids are written again."""
    emb = Catalog(spark, sf_dir).embeddings
    path = shared_dir(spark, "corpus")
    buckets.create(emb.select(F.col("vec_id").alias("id"), "embedding", F.lit(None).cast("bigint").alias("version")), path)
    buckets.upsert(emb.where(F.col("vec_id") % 100 == 0).select(
        F.col("vec_id").alias("id"), F.transform("embedding", lambda x: (x * 2).cast("float")).alias("embedding"),
        F.when(F.col("vec_id") % 3 != 0, F.col("vec_id") % 5).alias("version")), path)
    return buckets.read(spark, path).select("id", F.aggregate("embedding", F.lit(0.0).cast("double"), lambda a, x: a + x.cast("double")).alias("total"),
                                            F.size("embedding").cast("bigint").alias("dimensions"), "version")
