"""Whole-table helpers that avoid single-partition windows.

``Window.partitionBy()`` with no keys moves every row into one task. The
helpers here give the same results with the work spread over the cluster:

* ``with_total`` / ``share_of_total`` - a column total is a one-row aggregate
  joined back on a constant key (the broadcast side is one row by
  construction).
* ``dense_ranks_by_key``, ``dense_ranks_global`` - dense ranks over a whole
  column. The distinct values fall into buckets of a monotone function of the
  value (``value_bucket``); each bucket is ranked in its own window partition,
  and a table with one row per bucket (its distinct count) gives the offset of
  each bucket. Equal values always fall into the same bucket, so ties are
  exact, and nothing has to be sampled, collected or written beforehand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _one_row_join(df: DataFrame, one: DataFrame) -> DataFrame:
    return (df.withColumn("__k", F.lit(1))
            .join(F.broadcast(one.withColumn("__k", F.lit(1))), "__k").drop("__k"))


def with_total(df: DataFrame, value: str, out: str = "__total") -> DataFrame:
    """Add the column total; doubles are summed exactly (as decimal) so the
    total does not depend on the order partitions are combined in."""
    v = F.col(value)
    if dict(df.dtypes)[value] in ("double", "float"):
        total = F.sum(v.cast("decimal(38,6)")).cast("double")
    else:
        total = F.sum(v)
    return _one_row_join(df, df.agg(total.alias(out)))


def share_of_total(df: DataFrame, value: str, out: str = "Share_Percentage") -> DataFrame:
    """Value / total * 100 (null when the total is not positive)."""
    j = with_total(df, value)
    share = F.when(F.col("__total") > 0,
                   F.col(value).cast("double") / F.col("__total").cast("double") * F.lit(100.0))
    return j.withColumn(out, share).drop("__total")


def materialized(df: DataFrame) -> DataFrame:
    """Materialise ``df`` once in the shared checkpoint folder (reliable
    checkpoint, survives executor loss) so later jobs do not recompute it."""
    from revlens.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def range_cuts(df: DataFrame, columns: list[str], buckets: int) -> list[list[float]]:
    """Cut points of each numeric column into about ``buckets`` ranges of equal
    row counts: one approximate-quantile job, at most ``buckets`` - 1 numbers a column."""
    if buckets < 2:
        return [[] for _ in columns]
    probs = [i / buckets for i in range(1, buckets)]
    return [sorted(set(c)) for c in df.approxQuantile(columns, probs, 1.0 / (4 * buckets))]


def range_number(value: Column, cuts: list[float]) -> Column:
    """Number of cuts below ``value``, as a balanced tree of comparisons."""
    def node(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(value > F.lit(float(cuts[mid])), node(mid + 1, hi)).otherwise(node(lo, mid))
    return node(0, len(cuts))


def _buckets(df: DataFrame, buckets: int | None) -> int:
    return buckets or max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def value_bucket(value: Column, per_octave: int = 180) -> Column:
    """A whole number that never falls as ``value`` (double) grows: equal steps of its logarithm.

    Some 130,000 buckets at most cover all doubles each way; a bucket spans about
    0.4 % of its values' size, so no sample and no cut points are needed.
    """
    return (F.signum(value) * F.floor(F.log1p(F.abs(value)) * F.lit(float(per_octave)))).cast("int")


def _ranks(values: DataFrame) -> DataFrame:
    """(spec, value, rank): dense ranks of the distinct (spec, value), ascending.

    Values are ranked within their bucket; the distinct counts of lower buckets,
    one row a bucket that occurs, are the offset.
    """
    distinct = values.distinct().withColumn("b", value_bucket(F.col("value")))
    local = distinct.withColumn("place", F.dense_rank().over(Window.partitionBy("spec", "b").orderBy("value")))
    # bounded by the number of buckets, whatever the number of values
    before = Window.partitionBy("spec").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = distinct.groupBy("spec", "b").agg(F.count(F.lit(1)).alias("n")).select("spec", "b", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("off"))
    return local.join(offsets, ["spec", "b"]).select("spec", "value", (F.col("off") + F.col("place")).cast("bigint").alias("rank"))


def dense_ranks_by_key(df: DataFrame, key: str, specs: list[tuple[str, str, bool]]) -> DataFrame:
    """``df``, one row a non-null ``key``, plus one dense-rank column per ``(value, out, ascending)``; null values get null.

    All specs go through one pass: (spec, value) rows are ranked together and
    brought back by key, so the number of shuffles does not grow with the specs.
    Nothing runs while the query is built.
    """
    columns = df.columns
    signed = [F.struct(F.lit(i).alias("spec"), (F.col(v).cast("double") * F.lit(1.0 if asc else -1.0)).alias("value")) for i, (v, _, asc) in enumerate(specs)]
    long = df.withColumn("__s", F.explode(F.array(*signed))).select(*columns, F.col("__s.spec").alias("spec"), (F.col("__s.value") + F.lit(0.0)).alias("value"))
    ranks = _ranks(long.where(F.col("value").isNotNull()).select("spec", "value"))
    both = long.join(ranks, ["spec", "value"], "left")
    return both.groupBy(key).agg(*[F.any_value(c).alias(c) for c in columns if c != key],
                                 *[F.max(F.when(F.col("spec") == i, F.col("rank"))).alias(out) for i, (_, out, _) in enumerate(specs)]) \
        .select(*columns, *[out for _, out, _ in specs])


def dense_ranks_global(df: DataFrame, specs: list[tuple[str, str, bool]], buckets: int | None = None,
                       checkpoint: bool = False) -> DataFrame:
    """Add one dense-rank column per ``(value, out, ascending)`` spec to a frame of any rows.

    ``ascending=False`` ranks the largest value first. Null values get a null
    rank. ``checkpoint`` writes the input once, for inputs that are costly to
    compute; ``buckets`` is kept for callers and has no effect.
    """
    base = materialized(df) if checkpoint else df
    out = base
    for i, (value, name, asc) in enumerate(specs):
        signed = F.col(value).cast("double") * F.lit(1.0 if asc else -1.0) + F.lit(0.0)
        ranked = _ranks(base.where(F.col(value).isNotNull()).select(F.lit(i).alias("spec"), signed.alias("value")))
        out = out.withColumn("__v", signed).join(ranked.select(F.col("value").alias("__v"), F.col("rank").alias(name)), "__v", "left").drop("__v")
    return out


def dense_rank_global(df: DataFrame, value: str, out: str, ascending: bool = False,
                      buckets: int | None = None) -> DataFrame:
    """Add ``out`` = dense rank of ``value`` over the whole frame (1 = first)."""
    return dense_ranks_global(df, [(value, out, ascending)], buckets)


def order_cuts(df: DataFrame, order: str, buckets: int | None = None) -> list[float]:
    """Cut points of ``order`` into ranges of about equal row counts, for ``last_non_null_before``."""
    keyed = df.select(F.col(order).cast("double").alias("__o"))
    return range_cuts(keyed, ["__o"], _buckets(df, buckets))[0]


def last_non_null_before(df: DataFrame, key: str, order: str, values: dict[str, Column],
                         buckets: int | None = None, cuts: list[float] | None = None) -> DataFrame:
    """For each row, the last non-null value of each expression among the
    earlier rows (smaller ``order``) with the same ``key``: ``{out: expr}``.

    Two levels, so one key (say a conversation holding a third of all rows)
    is never one window partition: ``order`` is cut into ranges of about equal
    row counts, whatever its scale and spread; a window per (key, range) gives
    the value from earlier rows of the same range, and a window over the
    per-range summaries (at most ``buckets`` rows a key) carries the last value
    of earlier ranges. ``cuts`` from ``order_cuts`` may be passed to reuse them.
    """
    cuts = order_cuts(df, order, buckets) if cuts is None else cuts
    base = df.withColumn("__blk", range_number(F.col(order).cast("double"), cuts)).withColumns(
        {f"__v_{o}": e for o, e in values.items()})
    w_local = Window.partitionBy(key, "__blk").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    local = base.withColumns({f"__l_{o}": F.last(f"__v_{o}", ignorenulls=True).over(w_local) for o in values})
    summary = base.groupBy(key, "__blk").agg(
        *[F.max_by(F.col(f"__v_{o}"), F.when(F.col(f"__v_{o}").isNotNull(), F.col(order))).alias(f"__s_{o}")
          for o in values])
    w_blocks = Window.partitionBy(key).orderBy("__blk").rowsBetween(Window.unboundedPreceding, -1)
    carry = summary.select(key, "__blk", *[F.last(f"__s_{o}", ignorenulls=True).over(w_blocks).alias(f"__c_{o}")
                                           for o in values])
    out = local.join(carry, [key, "__blk"], "left")
    out = out.withColumns({o: F.coalesce(F.col(f"__l_{o}"), F.col(f"__c_{o}")) for o in values})
    drop = ["__blk"] + [f"__{p}_{o}" for o in values for p in ("v", "l", "c")]
    return out.drop(*drop)
