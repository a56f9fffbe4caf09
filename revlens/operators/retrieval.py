"""Exact vector top-k retrieval and corpus upsert.

Distance is squared L2 in double precision, summed left to right over the
vector (the default metric of the store the reference uses).

``vector_top_k`` is for a handful of queries, such as one exemplar a group:

* The query set, at most ``MAX_BROADCAST_QUERIES``, a bound that the plan itself
  asserts, is packed into arrays of ``max_queries`` vectors, which are
  broadcast. The corpus is never broadcast or collected.
* Every corpus row computes its Q distances with built-in higher-order
  functions (``zip_with`` + ``aggregate``), all JVM-side.
* Per query, ``row_number() <= k`` over (distance, id): Spark inserts a
  partial WindowGroupLimit before the shuffle, so each map task forwards at
  most k rows per query and the shuffle carries O(Q * k * tasks) rows, not
  O(Q * N).

Query sets that grow with the data go through ``vector_index`` (cells, rings
and exact bounds); ``vector_top_k_blocks`` builds an index and searches it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revlens.operators import vector_index

MAX_BROADCAST_QUERIES = 4096
BLOCK_ROWS = vector_index.BLOCK_ROWS


def squared_l2(a: Column, b: Column) -> Column:
    """Squared distance; vectors of different lengths raise."""
    same = F.assert_true(F.size(a) == F.size(b), F.lit("vectors have different dimensions"))
    diffs = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    total = F.aggregate(diffs, F.lit(0.0).cast("double"), lambda acc, x: acc + x)
    return F.when(same.isNull(), total)


def vector_top_k(corpus: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id",
                 vec_col: str = "embedding", qid: str = "query_id", qvec: str = "query_vec",
                 max_queries: int = MAX_BROADCAST_QUERIES) -> DataFrame:
    """The k nearest corpus rows of each of a few queries: (query, rank, id, distance).

    Rows without a vector, on either side, take no part. The queries are worked
    in packs of ``max_queries``; more than ``MAX_BROADCAST_QUERIES`` of them in
    all raise when the plan runs.
    """
    corpus, queries = corpus.where(F.col(vec_col).isNotNull()), queries.where(F.col(qvec).isNotNull())
    few = queries.limit(MAX_BROADCAST_QUERIES + 1)  # so that the array is bounded even where the check fails
    packed = few.agg(F.collect_list(F.struct(F.col(qid).alias("qid"), F.col(qvec).alias("qv"))).alias("__qs"))
    told = F.assert_true(F.size("__qs") <= MAX_BROADCAST_QUERIES, F.lit(f"more than {MAX_BROADCAST_QUERIES} queries: search a vector index"))
    packs = F.transform(F.sequence(F.lit(0), F.size("__qs") - 1, F.lit(max_queries)), lambda at: F.slice("__qs", at + 1, max_queries))
    packed = packed.where(told.isNull() & (F.size("__qs") > 0)).select(F.explode(packs).alias("__qs"))
    j = (corpus.select(id_col, vec_col).withColumn("__k", F.lit(1))
         .join(F.broadcast(packed.withColumn("__k", F.lit(1))), "__k").drop("__k"))
    d = j.select(id_col, F.explode(F.transform("__qs", lambda q: F.struct(
        q["qid"].alias(qid), squared_l2(F.col(vec_col), q["qv"]).alias("distance")))).alias("__d"))
    d = d.select(F.col(f"__d.{qid}").alias(qid), id_col, F.col("__d.distance").alias("distance"))
    w = Window.partitionBy(qid).orderBy(F.col("distance").asc_nulls_last(), F.col(id_col).asc())
    top = d.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return top.withColumn("rank", F.col("rank").cast("bigint"))


def vector_top_k_blocks(corpus: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id",
                        vec_col: str = "embedding", qid: str = "query_id", qvec: str = "query_vec",
                        block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``vector_top_k`` for query sets of any size, through an index of the corpus; a null in a vector raises, too."""
    index = vector_index.build(corpus, id_col, vec_col)
    return vector_index.search(index, queries, k, qid, qvec, id_col, block_rows)


def exemplar_queries(vectors: DataFrame, group_col: str = "label", id_col: str = "vec_id",
                     vec_col: str = "embedding") -> DataFrame:
    """One query per group: the vector of the group's smallest id (query by example)."""
    return vectors.groupBy(group_col).agg(F.min_by(F.col(vec_col), F.col(id_col)).alias("query_vec")) \
        .withColumnRenamed(group_col, "query_id")


def corpus_upsert(existing: DataFrame, updates: DataFrame, id_col: str = "id", vec_col: str = "embedding",
                  version_col: str = "version") -> DataFrame:
    """Insert or replace by id; the newest version wins; update rows without
    an embedding are skipped. A missing version is the oldest; of equal versions
    an update beats the stored row, then the larger vector wins. One aggregate
    per id (``max_by``), so a hot id costs one partial row per task."""
    upd = updates.where(F.col(vec_col).isNotNull())
    both = (existing.withColumn("__new", F.lit(0)).unionByName(upd.withColumn("__new", F.lit(1)), allowMissingColumns=True))
    cols = [c for c in both.columns if c not in (id_col, "__new")]
    order = F.struct(F.col(version_col).isNotNull().cast("int"), F.col(version_col), F.col("__new"), F.col(vec_col))
    best = both.groupBy(id_col).agg(F.max_by(F.struct(*[F.col(c) for c in cols]), order).alias("__b"))
    return best.select(id_col, *[F.col(f"__b.{c}").alias(c) for c in cols])
