"""The partitioned index: exact answers, every row indexed, rings left out where nothing near can be."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from revlens.operators import retrieval, vector_index as V

C, Q = "vec_id long, embedding array<float>", "query_id long, query_vec array<float>"


def brute(corpus, queries, k):
    out = []
    for i, q in enumerate(queries):
        d = np.zeros(len(corpus))
        for a, b in zip(corpus.astype(float).T, q.astype(float)):  # left to right
            d += (a - b) ** 2
        out += [(i, int(j), float(d[j]), n + 1) for n, j in enumerate(np.lexsort((np.arange(len(corpus)), d))[:k])]
    return sorted(out)


def frames(spark, corpus, queries):
    c = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(corpus)], C).repartition(4)
    return c, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(queries)], Q)


@pytest.mark.parametrize("kind", ["clusters", "noise", "grid", "line", "one point"])
def test_search_is_exact(spark, kind):
    g = np.random.default_rng(5)
    if kind == "clusters":
        corpus = (g.normal(size=(12, 8)) * 10)[g.integers(0, 12, 900)] + g.normal(size=(900, 8)) * .2
    elif kind == "noise":
        corpus = g.normal(size=(700, 16))
    elif kind == "grid":
        corpus = g.integers(0, 3, size=(800, 3))  # ties and equal rows everywhere
    elif kind == "line":
        corpus = np.arange(600)[:, None] * np.array([[1.0, 0.0]])
    else:
        corpus = np.ones((500, 4))
    corpus = corpus.astype(np.float32)
    queries = np.concatenate([corpus[::50], corpus[:7] + np.float32(.3)])
    c, q = frames(spark, corpus, queries)
    index = V.build(c, cell_rows=40, max_cells=16, sample_rows=128)
    assert index.rows.count() == len(corpus) and index.rings[:, 2].sum() == len(corpus)
    got = V.search(index, q, k=6, block_rows=50)
    assert sorted((r.query_id, r.vec_id, r.distance, r.rank) for r in got.collect()) == brute(corpus, queries, 6)


def test_rings_that_cannot_hold_a_neighbour_are_not_visited(spark):
    g = np.random.default_rng(2)
    corpus = ((g.normal(size=(10, 6)) * 50)[g.integers(0, 10, 1000)] + g.normal(size=(1000, 6))).astype(np.float32)
    c, _ = frames(spark, corpus, corpus[:1])
    index = V.build(c, cell_rows=100, max_cells=10, sample_rows=256)
    _, squared, reach = V._helpers()
    near = np.sort(squared(corpus[:100].astype(float), corpus.astype(float)), axis=1)[:, 4]
    visits = reach(squared(corpus[:100].astype(float), index.pivots), index.pivots, index.rings, np.sqrt(near))
    assert np.mean([len(v) for v in visits]) < len(index.rings) / 4


def test_a_hot_cell_and_a_hot_query_are_split(spark):
    corpus = np.concatenate([np.zeros((400, 2)), np.arange(40).reshape(20, 2)]).astype(np.float32)
    queries = np.zeros((300, 2), dtype=np.float32)
    c, q = frames(spark, corpus, queries)
    got = V.search(V.build(c, cell_rows=50), q, k=3, block_rows=64).collect()
    assert sorted((r.query_id, r.vec_id, r.distance, r.rank) for r in got) == [(i, j, 0.0, j + 1) for i in range(300) for j in range(3)]


def test_fewer_rows_than_k_nulls_and_empty(spark):
    c = spark.createDataFrame([(1, [1.0, 2.0]), (2, None), (3, [0.0, 0.0])], C)
    q = spark.createDataFrame([(7, [0.0, 0.0]), (8, None)], Q)
    assert [tuple(r) for r in V.search(V.build(c), q, k=5).orderBy("rank").collect()] == [(7, 3, 0.0, 1), (7, 1, 5.0, 2)]
    assert V.search(V.build(c.limit(0)), q).count() == 0 and V.search(V.build(c), q.limit(0)).count() == 0
    strings = c.withColumn("vec_id", F.concat(F.lit("v"), "vec_id"))
    assert {r.vec_id for r in V.search(V.build(strings), q).collect()} == {"v1", "v3"}


def test_other_lengths_and_null_elements_raise(spark):
    c = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 1.0])], C)
    for bad in ([1.0], [None, 1.0]):
        with pytest.raises(Exception, match="different dimensions|null element"):
            V.search(V.build(c), spark.createDataFrame([(1, bad)], Q)).collect()
        with pytest.raises(Exception, match="different dimensions|null element"):
            V.build(c.union(spark.createDataFrame([(3, bad)], C)))


def test_shuffled_rows_stay_in_proportion(spark, sf_small):
    """Rows into the comparison: the corpus once, and the visits."""
    emb = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    q = emb.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    n, nq, k = emb.count(), q.count(), 5
    index = V.build(emb)
    _, squared, reach = V._helpers()
    vectors = np.array([r.query_vec for r in q.collect()], dtype=float)
    near = np.partition(squared(vectors, index.sample), k - 1, axis=1)[:, k - 1]
    visits = sum(map(len, reach(squared(vectors, index.pivots), index.pivots, index.rings, np.sqrt(near))))
    assert n + visits + nq <= 2 * (n + nq * k)


def test_too_many_broadcast_queries_raise_in_the_plan(spark, monkeypatch):
    c = spark.createDataFrame([(i, [float(i)]) for i in range(5)], C)
    q = c.toDF("query_id", "query_vec")
    monkeypatch.setattr(retrieval, "MAX_BROADCAST_QUERIES", 5)
    assert retrieval.vector_top_k(c, q, k=1).count() == 5 and retrieval.vector_top_k(c, q, k=1, max_queries=2).count() == 5
    assert retrieval.vector_top_k(c, q.limit(0), k=1).count() == 0
    monkeypatch.setattr(retrieval, "MAX_BROADCAST_QUERIES", 4)
    with pytest.raises(Exception, match="more than 4 queries"):
        retrieval.vector_top_k(c, q, k=1).collect()
