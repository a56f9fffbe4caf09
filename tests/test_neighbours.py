"""Searches whose queries grow with the corpus."""

import duckdb
import numpy as np
import pytest

import __spark_entry__ as E
from revlens.operators import retrieval


def test_registered_search_matches_its_oracle(spark, sf_small):
    got = sorted(tuple(r) for r in E.queries()["vector_neighbours"](spark, sf_small).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{sf_small}/embeddings.parquet')")
    want = sorted(con.execute(E.oracle_sql()["vector_neighbours"]).fetchall())
    assert len(got) == 5 * con.execute("SELECT COUNT(*) FROM embeddings WHERE vec_id % 50 = 0").fetchone()[0]
    assert [g[:3] for g in got] == [w[:3] for w in want] and [g[3] for g in got] == pytest.approx([w[3] for w in want], rel=1e-12)


@pytest.mark.parametrize("block_rows", [4096, 7])
def test_blocks_with_ties_and_missing_vectors(spark, block_rows):
    rng = np.random.default_rng(3)
    corpus = rng.integers(0, 2, size=(90, 4)).astype(np.float32)  # many equal vectors
    c = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(corpus)] + [(500, None)], "vec_id long, embedding array<float>").repartition(3)
    q = spark.createDataFrame([(f"q{i}", v.tolist()) for i, v in enumerate(corpus[:30])] + [("none", None)], "query_id string, query_vec array<float>")
    got = retrieval.vector_top_k_blocks(c, q, k=6, block_rows=block_rows).collect()
    want = []
    for i in range(30):
        d = ((corpus.astype(float) - corpus[i].astype(float)) ** 2).sum(axis=1)
        want += [(f"q{i}", int(j), float(d[j]), n + 1) for n, j in enumerate(np.lexsort((np.arange(90), d))[:6])]
    assert sorted(map(tuple, got)) == sorted(want)
    assert retrieval.vector_top_k_blocks(c.limit(0), q).count() == 0 and retrieval.vector_top_k_blocks(c, q.limit(0)).count() == 0


def test_blocks_reject_other_dimensions(spark):
    c = spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<float>")
    q = spark.createDataFrame([(1, [1.0, 2.0])], "query_id long, query_vec array<float>")
    with pytest.raises(Exception, match="different dimensions"):
        retrieval.vector_top_k_blocks(c, q).collect()


def test_more_queries_than_one_broadcast_read_the_corpus_once(spark, tmp_path):
    spark.createDataFrame([(i, [float(i), 1.0]) for i in range(40)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/e")
    e = spark.read.parquet(f"{tmp_path}/e")
    q = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(9)], "query_id long, query_vec array<float>")
    plan = retrieval.vector_top_k(e, q, k=2, max_queries=2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1
