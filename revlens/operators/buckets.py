"""J6 on a stored corpus: upserts that rewrite only the buckets they touch.

Rows lie in buckets by a hash of their id, each bucket's files in the folder of
the commit that last wrote it; a small manifest a commit names that commit for
every bucket. An upsert reads the buckets of its ids, merges them with
``retrieval.corpus_upsert``, writes them under the next commit, then writes the
manifest. Readers see a commit only when its manifest is whole, and earlier
ones stay readable. One writer at a time; ``buckets`` is fixed at creation (a
bucket should be about what a few tasks can hold).

Defined cases: an update without rows, or without any embedding, adds a commit
that changes nothing; null ids are one id, as in ``corpus_upsert``; columns that only the updates have are
dropped, those that they lack are null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revlens.operators.retrieval import corpus_upsert

BUCKETS = 256
_BUCKET, _COMMIT = "__bucket", "__commit"


def _bucket(id_col: str, buckets: int):
    return F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(buckets)).cast("int")


def _write(df: DataFrame, path: str, id_col: str, buckets: int, commit: int) -> None:
    df.withColumn(_BUCKET, _bucket(id_col, buckets)).repartition(_BUCKET).write.partitionBy(_BUCKET).parquet(f"{path}/data/{_COMMIT}={commit}")


def _manifest(spark: SparkSession, path: str, commit: int | None = None) -> tuple[int, int, str, dict[int, int]]:
    """(commit, buckets, schema, bucket -> commit of its files); at most ``buckets`` rows."""
    m = spark.read.parquet(f"{path}/manifest")
    last = m.agg(F.max("commit")).first()[0] if commit is None else commit
    rows = m.where(F.col("commit") == last).collect()
    return last, rows[0]["buckets"], rows[0]["schema"], {r["bucket"]: r["written"] for r in rows if r["bucket"] is not None}


def _publish(spark: SparkSession, path: str, commit: int, buckets: int, schema: str, written: dict[int, int]) -> None:
    rows = [(buckets, schema, b, c) for b, c in sorted(written.items())] or [(buckets, schema, None, None)]
    spark.createDataFrame(rows, "buckets int, schema string, bucket int, written int").coalesce(1).write.parquet(f"{path}/manifest/commit={commit}")


def _filled(df: DataFrame, id_col: str, buckets: int) -> list[int]:
    return [r[0] for r in df.select(_bucket(id_col, buckets)).distinct().collect()]  # at most ``buckets`` numbers


def create(df: DataFrame, path: str, id_col: str = "id", buckets: int = BUCKETS) -> None:
    """Store ``df`` as commit 0."""
    spark = df.sparkSession
    _write(df, path, id_col, buckets, 0)
    stored = spark.read.schema(df.schema).parquet(f"{path}/data/{_COMMIT}=0")
    _publish(spark, path, 0, buckets, df.schema.json(), dict.fromkeys(_filled(stored, id_col, buckets), 0))


def _frame(spark: SparkSession, path: str, schema: str, written: dict[int, int]) -> DataFrame:
    import json
    kind = T.StructType.fromJson(json.loads(schema))
    folders = [f"{path}/data/{_COMMIT}={c}/{_BUCKET}={b}" for b, c in sorted(written.items())]
    return spark.read.schema(kind).parquet(*folders) if folders else spark.createDataFrame([], kind)


def read(spark: SparkSession, path: str, commit: int | None = None) -> DataFrame:
    """The rows of the last commit, or of an earlier one."""
    _, _, schema, written = _manifest(spark, path, commit)
    return _frame(spark, path, schema, written)


def upsert(updates: DataFrame, path: str, id_col: str = "id", vec_col: str = "embedding", version_col: str = "version") -> list[int]:
    """Merge ``updates`` and return the buckets that were written again."""
    spark = updates.sparkSession
    last, buckets, schema, written = _manifest(spark, path)
    useful = updates.where(F.col(vec_col).isNotNull())
    touched = sorted(_filled(useful, id_col, buckets))
    if touched:
        old = _frame(spark, path, schema, {b: written[b] for b in touched if b in written})
        merged = corpus_upsert(old, useful, id_col, vec_col, version_col)
        _write(merged.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in old.schema]), path, id_col, buckets, last + 1)
    _publish(spark, path, last + 1, buckets, schema, written | dict.fromkeys(touched, last + 1))
    return touched
