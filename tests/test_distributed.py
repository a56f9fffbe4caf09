"""Distributed helpers and retrieval against brute force on small fixtures."""

import numpy as np
import pandas as pd
import pytest

from revlens.operators import retrieval
from revlens.plans.distributed import dense_ranks_global, share_of_total


@pytest.mark.parametrize("buckets", [2, 7])
def test_dense_rank_matches_pandas(spark, buckets):
    rng = np.random.default_rng(1)
    vals = rng.integers(0, 40, size=300).astype(float)
    vals[::17] = np.nan
    pdf = pd.DataFrame({"k": np.arange(300), "v": vals})
    df = spark.createDataFrame(pdf)
    df = df.replace(float("nan"), None)
    out = dense_ranks_global(df, [("v", "r_desc", False), ("v", "r_asc", True)], buckets=buckets).toPandas()
    out = out.sort_values("k").reset_index(drop=True)
    exp_desc = pdf["v"].rank(method="dense", ascending=False)
    exp_asc = pdf["v"].rank(method="dense", ascending=True)
    assert out["r_desc"].astype("float").fillna(-1).tolist() == exp_desc.fillna(-1).tolist()
    assert out["r_asc"].astype("float").fillna(-1).tolist() == exp_asc.fillna(-1).tolist()


def test_share_sums_to_100(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 3.0)], "d string, v double")
    shares = {r["d"]: r["Share_Percentage"] for r in share_of_total(df, "v").collect()}
    assert shares == {"a": 25.0, "b": 75.0}


@pytest.mark.parametrize("max_queries", [4096, 2])
def test_vector_top_k_matches_brute_force(spark, max_queries):
    rng = np.random.default_rng(7)
    corpus = rng.normal(size=(200, 8)).astype(np.float32)
    queries = rng.normal(size=(5, 8)).astype(np.float32)
    cdf = spark.createDataFrame([(i, corpus[i].tolist()) for i in range(200)], "vec_id long, embedding array<float>")
    qdf = spark.createDataFrame([(j, queries[j].tolist()) for j in range(5)], "query_id long, query_vec array<float>")
    got = retrieval.vector_top_k(cdf, qdf, k=4, max_queries=max_queries).toPandas()
    for j in range(5):
        d = ((corpus.astype(np.float64) - queries[j].astype(np.float64)) ** 2).sum(axis=1)
        order = np.lexsort((np.arange(200), d))[:4]
        g = got[got.query_id == j].sort_values("rank")
        assert g["vec_id"].tolist() == order.tolist()
        assert np.allclose(g["distance"].to_numpy(), d[order])


def test_corpus_upsert_newest_wins_and_skips_missing_embeddings(spark):
    old = spark.createDataFrame([("a", [1.0], 1), ("b", [2.0], 1)], "id string, embedding array<double>, version int")
    new = spark.createDataFrame([("a", [9.0], 2), ("b", None, 2), ("c", [3.0], 2)],
                                "id string, embedding array<double>, version int")
    out = {r["id"]: list(r["embedding"]) for r in retrieval.corpus_upsert(old, new).collect()}
    assert out == {"a": [9.0], "b": [2.0], "c": [3.0]}


@pytest.mark.parametrize("buckets,scale", [(2, 2), (9, 2), (9, 86_400_000_000)])
def test_last_non_null_before_matches_brute_force(spark, buckets, scale):
    from pyspark.sql import functions as F
    from revlens.plans.distributed import last_non_null_before
    rng = np.random.default_rng(3)
    rows = []
    for key, n in ((0, 200), (1, 7), (2, 1)):  # key 0 is hot
        for t in range(n):
            v = None if rng.random() < 0.6 else f"v{key}_{t}"
            rows.append((key, t * scale, v))
    df = spark.createDataFrame(rows, "k int, t long, v string")
    got = {(r["k"], r["t"]): r["prev"] for r in
           last_non_null_before(df, "k", "t", {"prev": F.col("v")}, buckets=buckets).collect()}
    exp = {}
    last = {}
    for k, t, v in rows:
        exp[(k, t)] = last.get(k)
        if v is not None:
            last[k] = v
    assert got == exp


def test_corpus_upsert_keeps_rows_without_a_version(spark):
    old = spark.createDataFrame([("a", [1.0], None), ("c", [5.0], 3)], "id string, embedding array<double>, version int")
    new = spark.createDataFrame([("b", [2.0], 1), ("c", [6.0], 3), ("c", [4.0], None)], "id string, embedding array<double>, version int")
    out = {r["id"]: list(r["embedding"]) for r in retrieval.corpus_upsert(old, new).collect()}
    assert out == {"a": [1.0], "b": [2.0], "c": [6.0]}


def test_vector_top_k_ignores_missing_vectors_and_rejects_other_dimensions(spark):
    q = spark.createDataFrame([(1, [0.0, 0.0]), (2, None)], "query_id long, query_vec array<float>")
    c = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "vec_id long, embedding array<float>")
    assert [(r["query_id"], r["vec_id"]) for r in retrieval.vector_top_k(c, q, k=3).collect()] == [(1, 1)]
    bad = spark.createDataFrame([(3, [1.0])], "vec_id long, embedding array<float>")
    with pytest.raises(Exception, match="different dimensions"):
        retrieval.vector_top_k(bad, q, k=3).collect()


def test_new_files_are_seen(spark, tmp_path):
    from revlens.sources.tables import read_table
    spark.range(5).toDF("n_nationkey").write.parquet(f"{tmp_path}/nation.parquet")
    assert read_table(spark, str(tmp_path), "nation").count() == 5
    spark.range(5).toDF("n_nationkey").write.mode("append").parquet(f"{tmp_path}/nation.parquet")
    assert read_table(spark, str(tmp_path), "nation").count() == 10


def test_a_cluster_needs_a_shared_checkpoint_folder():
    from types import SimpleNamespace
    from revlens.session import ensure_checkpoint_dir
    sc = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    s = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: d), sparkContext=sc)
    with pytest.raises(ValueError, match="checkpoint"):
        ensure_checkpoint_dir(s)
