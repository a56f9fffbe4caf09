"""Global dense ranks without samples, checkpoints or one-partition windows."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from revlens.plans import distributed as D


@pytest.mark.parametrize("kind", ["money", "near", "signs", "huge"])
def test_ranks_by_key_match_pandas(spark, kind):
    g = np.random.default_rng(4)
    v = {"money": g.integers(0, 5_000_000, 3000) / 100, "near": 1e9 + g.integers(0, 500, 3000) / 100,
         "signs": g.integers(-40, 40, 3000) / 4, "huge": g.normal(size=3000) * 10.0 ** g.integers(-300, 300, 3000)}[kind]
    pdf = pd.DataFrame({"k": [f"k{i}" for i in range(3000)], "v": v, "w": g.integers(0, 9, 3000)})
    df = spark.createDataFrame(pdf).withColumn("v", F.when(F.col("w") > 0, F.col("v"))).repartition(5)
    got = D.dense_ranks_by_key(df, "k", [("v", "a", True), ("v", "d", False), ("w", "w_rank", False)]).toPandas().set_index("k").loc[pdf.k]
    want = pdf.v.where(pdf.w > 0)
    assert got.a.astype(float).fillna(0).tolist() == want.rank(method="dense").fillna(0).tolist()
    assert got.d.astype(float).fillna(0).tolist() == want.rank(method="dense", ascending=False).fillna(0).tolist()
    assert got.w_rank.astype(float).tolist() == pdf.w.rank(method="dense", ascending=False).tolist()


def test_buckets_never_fall():
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    r = random.Random(1)
    values = sorted({r.choice([-1, 1]) * r.random() * 10.0 ** r.randrange(-310, 309) for _ in range(5000)} | {0.0, 1.0, -1.0, 5e-324, 1.7e308, -1.7e308})
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").select("i", D.value_bucket(F.col("v")).alias("b")).orderBy("i").collect()
    assert all(x.b <= y.b for x, y in zip(rows, rows[1:]))
    assert max(abs(x.b) for x in rows) < 130_000


def test_a_million_values_with_ties(spark):
    n = 1_000_000
    df = spark.range(0, n, 1, 8).select(F.col("id").cast("string").alias("k"), (F.floor(F.col("id") / 2) / 100).alias("v"))
    out = D.dense_ranks_by_key(df, "k", [("v", "r", True)])
    wrong = out.where(F.col("r") != F.floor(F.col("k").cast("bigint") / 2) + 1).count()
    assert wrong == 0 and out.count() == n


def test_nothing_runs_while_the_query_is_built(spark):
    status = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("ranks", "build only")
    df = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") % 7).alias("v"))
    D.dense_ranks_by_key(df, "k", [("v", "r", False)])
    D.dense_ranks_global(df, [("v", "r", False)])
    assert not status.getJobIdsForGroup("ranks")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
