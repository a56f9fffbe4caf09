"""Partitioned vector index with exact search.

``build`` cuts the corpus into cells around pivots and each cell into rings by
distance to its pivot. Pivots are fitted on a bounded sample (``SAMPLE_ROWS``
rows, those of least hash); every row is indexed. The index is rows
``(id, v, cell, r, ring)``, written once to the shared checkpoint folder, the
pivots, and one summary row a ring (rows, least and greatest distance), at most
``MAX_CELLS`` x ``RINGS`` of them.

``search`` is exact. With ``t`` an upper bound of a query's k-th distance, a
ring is visited only if it can hold a row that near. For a row x of a ring with
pivot p and radii [lo, hi], and the query's nearest pivot h:

* ``|q - x| >= max(|q - p| - hi, lo - |q - p|)`` (triangle inequality), and
* ``|q - x| >= (|q - p|^2 - |q - h|^2) / (2 |p - h|)``, since x is no nearer to h
  than to p.

Bounds are compared with a slack above rounding. ``t`` comes first from the
sample, without a shuffle, then from at most about ``PROBE_ROWS`` rows of the
query's own cell. What is visited is compared in groups of one ring block
(``BLOCK_ROWS`` rows by hash) and a block of the queries that visit it, so a
cell, ring or query block with any share of the rows is many groups. A group
returns at most k rows a query, none beyond ``t``.

Shuffled rows: the corpus once (a row again for each further ``BLOCK_ROWS``
queries that visit its ring), the probe rows, and the visits. Vectors without
any structure can visit every ring; that is the price of exact answers, not of
the plan. Nothing that grows with the tables is broadcast or collected: the
driver holds the sample, the pivots and the ring table.

Distances are squared L2 in double precision, summed left to right; ties go to
the smaller id. Rows without a vector, on either side, take no part; a null
element or a vector of another length raises.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revlens.plans.distributed import materialized

SAMPLE_ROWS = 4096
MAX_CELLS = 512
CELL_ROWS = 2048
RINGS = 4
BLOCK_ROWS = 4096
PROBE_ROWS = 512
SLACK = 1e-6


@dataclass
class VectorIndex:
    rows: DataFrame          # id, v, cell, r, ring
    pivots: np.ndarray       # cells x dimensions
    sample: np.ndarray       # rows of the corpus
    rings: np.ndarray        # cell, ring, rows, least r, greatest r

    @property
    def cell_rows(self) -> np.ndarray:
        return np.bincount(self.rings[:, 0].astype(int), weights=self.rings[:, 2], minlength=len(self.pivots)).astype(int)


def _helpers():
    """Functions that tasks use; workers get them by value, so executors need no package."""
    def matrix(column, width: int | None = None) -> np.ndarray:
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        flat, sizes = column.flatten(), np.diff(column.offsets.to_numpy())
        if flat.null_count:
            raise ValueError("a vector has a null element")
        width = int(sizes[0]) if width is None and len(sizes) else width or 0
        if (sizes != width).any():
            raise ValueError("vectors have different dimensions")
        return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(sizes), width)

    def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """All squared distances, each summed left to right over the vector."""
        d = np.zeros((len(x), len(y)))
        for a, b in zip(np.ascontiguousarray(x.T), np.ascontiguousarray(y.T)):
            step = a[:, None] - b[None, :]
            step *= step
            d += step
        return d

    def reach(to_pivots: np.ndarray, pivots: np.ndarray, rings: np.ndarray, bound: np.ndarray) -> list[np.ndarray]:
        """Per query, by its squared distances to the pivots, the numbers of the rings that can hold a row within ``bound`` (a distance)."""
        home = to_pivots.argmin(axis=1)
        far = np.sqrt(to_pivots)
        between = np.sqrt(squared(pivots, pivots))
        cell = rings[:, 0].astype(int)
        out = []
        for i in range(len(to_pivots)):
            d = far[i, cell]
            gap = between[home[i], cell]
            plane = np.where(gap > 0, (to_pivots[i, cell] - to_pivots[i, home[i]]) / np.where(gap > 0, 2 * gap, 1.0), 0.0)
            least = np.maximum(np.maximum(d - rings[:, 4], rings[:, 3] - d), plane)
            # not "least <= bound": a bound or a distance that is no number must keep the ring
            out.append(np.flatnonzero(~(least > bound[i] * (1 + SLACK) + SLACK * (1 + d))))
        return out
    return matrix, squared, reach


def _fit(sample: np.ndarray, cells: int, rounds: int = 6) -> np.ndarray:
    """Pivots: means of the sample's clusters, from rows spread over the sample."""
    _, squared, _ = _helpers()
    pivots = np.unique(sample, axis=0)
    pivots = pivots[np.linspace(0, len(pivots) - 1, min(cells, len(pivots))).astype(int)]
    for _ in range(rounds):
        near = squared(sample, pivots).argmin(axis=1)
        size = np.bincount(near, minlength=len(pivots))
        total = np.zeros_like(pivots)
        np.add.at(total, near, sample)
        used = size > 0
        pivots[used] = total[used] / size[used, None]
    return pivots


def build(corpus: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cell_rows: int = CELL_ROWS,
          max_cells: int = MAX_CELLS, sample_rows: int = SAMPLE_ROWS, rings: int = RINGS) -> VectorIndex:
    """Index every row of ``corpus`` that has a vector."""
    rows = corpus.where(F.col(vec_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    # of least hash: the same rows whatever the partitioning; each task keeps sample_rows at most
    drawn = rows.select("v").orderBy(F.xxhash64("id", "v"), "v").limit(sample_rows).collect()
    n = rows.count() if len(drawn) == sample_rows else len(drawn)
    matrix, squared, reach = _helpers()
    sample = matrix(pa.array([r["v"] for r in drawn], pa.list_(pa.float64()))) if drawn else np.zeros((0, 0))
    if len(sample) and not np.isfinite(sample).all():
        sample = sample[np.isfinite(sample).all(axis=1)]
    pivots = _fit(sample, max(1, min(max_cells, n // cell_rows, max(1, len(sample) // 4)))) if len(sample) else np.zeros((1, sample.shape[1]))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = squared(matrix(batch.column("v"), pivots.shape[1]), pivots)
                cell = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(cell.astype(np.int32)),
                                                  pa.array(np.sqrt(d[np.arange(len(d)), cell]))], names=["id", "v", "cell", "r"])
    kind = dict(rows.dtypes)["id"]
    placed = materialized(rows.mapInArrow(assign, f"id {kind}, v array<double>, cell int, r double"))
    # cut points of each cell's distances: one row a cell
    cuts = [[] for _ in pivots]
    if rings > 1:
        for c in placed.groupBy("cell").agg(F.percentile_approx("r", [i / rings for i in range(1, rings)], 200).alias("cuts")).collect():
            cuts[c["cell"]] = c["cuts"]
    own = F.element_at(_literal(cuts, "array<array<double>>"), F.col("cell") + 1)
    held = placed.withColumn("ring", F.size(F.filter(own, lambda c: F.col("r") > c)).cast("int"))
    table = held.groupBy("cell", "ring").agg(F.count(F.lit(1)).alias("n"), F.min("r").alias("lo"), F.max("r").alias("hi")).collect()
    rings_table = np.array([[t["cell"], t["ring"], t["n"], t["lo"], t["hi"]] for t in table], dtype=np.float64).reshape(-1, 5)
    return VectorIndex(held, pivots, sample, rings_table)


def _nearest(k: int):
    """For a block of rows (id, v) and queries (qid, qv, bound): their k nearest rows, none beyond the bound."""
    matrix, squared, reach = _helpers()

    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        schema = pa.schema([("qid", queries.schema.field("qid").type), ("id", rows.schema.field("id").type), ("distance", pa.float64())])
        if not rows.num_rows or not queries.num_rows:
            return schema.empty_table()
        rows = rows.take(pc.sort_indices(rows.column("id"), null_placement="at_start"))  # of equal distances the smaller id comes first
        c, q = matrix(rows.column("v")), matrix(queries.column("qv"))
        if c.shape[1] != q.shape[1]:
            raise ValueError("vectors have different dimensions")
        bound = queries.column("bound").to_numpy()
        n = min(k, len(c))
        who, near, far = [np.zeros(0, int)], [np.zeros(0, int)], [np.zeros(0)]
        for lo in range(0, len(q), 64):
            d = squared(q[lo:lo + 64], c)
            last = np.partition(d, n - 1, axis=1)[:, n - 1]
            for i, row in enumerate(d):
                some = np.flatnonzero(~(row > last[i]) & ~(row > bound[lo + i]))
                some = some[np.argsort(row[some], kind="stable")][:n]
                who.append(np.full(len(some), lo + i))
                near.append(some)
                far.append(row[some])
        return pa.table([queries.column("qid").take(pa.array(np.concatenate(who))), rows.column("id").take(pa.array(np.concatenate(near))),
                         pa.array(np.concatenate(far))], schema=schema)
    return run


def search(index: VectorIndex, queries: DataFrame, k: int = 5, qid: str = "query_id", qvec: str = "query_vec", id_col: str = "vec_id",
           block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The k nearest indexed rows of every query, exactly: (query, id, distance, rank)."""
    rows, pivots, sample, rings = index.rows, index.pivots, index.sample, index.rings
    types = dict(rows.dtypes) | {"qid": dict(queries.dtypes)[qid]}
    matrix, squared, reach = _helpers()
    if not len(rings):
        return queries.sparkSession.createDataFrame([], f"`{qid}` {types['qid']}, `{id_col}` {types['id']}, distance double, rank bigint")
    q = queries.where(F.col(qvec).isNotNull()).select(F.col(qid).alias("qid"), F.col(qvec).cast("array<double>").alias("qv"))
    q = q.withColumn("row", F.monotonically_increasing_id())

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query's own cell, and its k-th distance in the sample."""
        for batch in batches:
            if batch.num_rows:
                v = matrix(batch.column("qv"), pivots.shape[1])
                near = squared(v, sample) if len(sample) >= k else None
                bound = np.partition(near, k - 1, axis=1)[:, k - 1] if near is not None else np.full(len(v), np.inf)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(squared(v, pivots).argmin(axis=1).astype(np.int32)), pa.array(bound)],
                                                 names=[*batch.schema.names, "cell", "bound"])
    q = materialized(q.mapInArrow(start, f"qid {types['qid']}, qv array<double>, row long, cell int, bound double"))

    # a share of each cell's rows, PROBE_ROWS of them or so, meets the cell's queries
    size = index.cell_rows
    share = F.element_at(_literal([min(1.0, PROBE_ROWS / max(1, int(s))) for s in size], "array<double>"), F.col("cell") + 1)
    probes = rows.where(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 20)) < share * F.lit(float(1 << 20))).select("cell", "id", "v")
    blocks = _block_counts(q.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect(), len(pivots), "cell", block_rows)
    probes = _repeat(probes, F.col("cell"), blocks)
    nearer = probes.groupBy("cell", "part").cogroup(_dealt(q, F.col("cell"), blocks).groupBy("cell", "part")) \
        .applyInArrow(_kth(k), "row long, near double")
    q = q.join(nearer, "row", "left").select("qid", "qv", "row", F.least("bound", F.coalesce("near", "bound")).alias("bound"))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = reach(squared(matrix(batch.column("qv"), pivots.shape[1]), pivots), pivots, rings, np.sqrt(batch.column("bound").to_numpy()))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([f.astype(np.int32) for f in found], pa.list_(pa.int32()))],
                                                 names=[*batch.schema.names, "visits"])
    told = materialized(q.mapInArrow(visit, f"qid {types['qid']}, qv array<double>, row long, bound double, visits array<int>"))
    visits = told.select("qid", "qv", "row", F.col("bound"), F.explode("visits").alias("at"))
    counts = _block_counts(told.select(F.explode("visits").alias("at")).groupBy("at").agg(F.count(F.lit(1)).alias("n")).collect(), len(rings), "at", block_rows)

    # a ring is as many row blocks as it needs; each meets each block of the queries that visit the ring
    row_blocks = [max(1, -(-int(n) // block_rows)) for n in rings[:, 2]]
    stride = int(rings[:, 1].max()) + 1
    number = [0] * (len(pivots) * stride)
    for i, (c, g) in enumerate(rings[:, :2].astype(int)):
        number[c * stride + g] = i
    at = _of(number, F.col("cell") * F.lit(stride) + F.col("ring"))
    blocked = rows.select("id", "v", at.alias("at"))
    blocked = blocked.withColumn("block", F.pmod(F.xxhash64("id", F.lit(5)), _of(row_blocks, F.col("at"))).cast("int"))
    blocked = _repeat(blocked, F.col("at"), counts).select("at", "block", "part", "id", "v")
    asked = _dealt(visits, F.col("at"), counts).withColumn("block", F.explode(F.sequence(F.lit(0), _of(row_blocks, F.col("at")) - 1)))
    near = blocked.groupBy("at", "block", "part").cogroup(asked.select("at", "block", "part", "qid", "qv", "bound").groupBy("at", "block", "part")) \
        .applyInArrow(_nearest(k), f"qid {types['qid']}, id {types['id']}, distance double")
    w = Window.partitionBy("qid").orderBy(F.col("distance").asc_nulls_last(), F.col("id").asc())
    return near.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= k).select(
        F.col("qid").alias(qid), F.col("id").alias(id_col), "distance", "rank")


def _literal(values, kind: str):
    """An array of bounded length as one literal, folded when the query is planned."""
    return F.from_json(F.lit(json.dumps(values)), kind)


def _of(numbers: list[int], at):
    """The number at a 0-based position."""
    return F.element_at(_literal(numbers, "array<int>"), at + 1)


def _block_counts(rows, n: int, key: str, block_rows: int) -> list[int]:
    """Query blocks of each cell or ring; 0 where no query goes."""
    out = [0] * n
    for r in rows:
        out[r[key]] = -(-r["n"] // block_rows)
    return out


def _repeat(rows: DataFrame, at, blocks: list[int]) -> DataFrame:
    """Each row once for every block of the queries that come to it; rows that nobody asks for go."""
    parts = _of(blocks, at)
    return rows.where(parts > 0).withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))


def _dealt(queries: DataFrame, at, blocks: list[int]) -> DataFrame:
    return queries.withColumn("part", F.pmod(F.xxhash64("row"), F.greatest(_of(blocks, at), F.lit(1))).cast("int"))


def _kth(k: int):
    """Each query's k-th distance among the probe rows of its cell, where there are so many."""
    matrix, squared, reach = _helpers()

    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        schema = pa.schema([("row", pa.int64()), ("near", pa.float64())])
        if rows.num_rows < k or not queries.num_rows:
            return schema.empty_table()
        c, q = matrix(rows.column("v")), matrix(queries.column("qv"))
        near = np.concatenate([np.partition(squared(q[lo:lo + 256], c), k - 1, axis=1)[:, k - 1] for lo in range(0, len(q), 256)])
        return pa.table([queries.column("row").combine_chunks(), pa.array(near)], schema=schema)
    return run
