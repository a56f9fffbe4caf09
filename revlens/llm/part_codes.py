"""Product-quantisation codes by memoised grid cells, exact in integers.

Vectors become integers ``floor(SCALE * x)`` and are cut into ``parts``
consecutive parts, each with a codebook of its own. A part is assigned to its
codebook's nearest entry (squared Euclidean distance, ties to the lower index):
its coarse cell, the components divided by ``cell``, is looked up by hash; for
a cell not met before, each entry's least and greatest distance to the cell's
box are computed, and the entries whose least distance is above the smallest
greatest distance are dominated in the whole box. The others are kept for the
cell, and only those are evaluated, exactly. The outermost cells reach to the
end of the domain, so every part has a cell.

Codebooks start as the parts of the first vectors by id. Each round is one
map-only pass over the vectors and a sum: a task sends a count and
component sums for each part and entry, Spark adds them, and the driver reads
one row for each part, entry and position (``entries`` times the dimension,
whatever the table's size). The table is read again in each round and never
written; the codebooks are sent along as a closure of that size.

Scale: a task holds one batch and a cache of ``CELLS`` cells a part. A label
with any share of the rows is one sum, combined before the shuffle; the join
back goes by label, where adaptive execution broadcasts a small side of sums or
splits a hot label.

Defined cases: vectors that are null, or hold null or non-finite components or
ones beyond +-2^27 / SCALE (whose distances leave 64 bits), or have another
length than the first vector by id, are dropped; ties of vec_id are ordered by
the vector; null ids come after all others; with fewer vectors than entries the
codebooks are shorter; unused entries stay; a length that is no multiple of
``parts`` is cut as evenly as it goes, so some parts may be empty (index 0); an
empty table, or one with all rows dropped, gives no rows. Repeated rows count
each. Null labels are one label. Further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.llm.frames import ship, stored

SCALE = 4096
PARTS, ENTRIES, ROUNDS = 8, 16, 6
DOMAIN = 1 << 27
CELL = 1 << 8
CELLS = 50_000
BATCH = 10_000

Books = list[np.ndarray]  # per part: entries x components, int64


def kept(vectors: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """(vec_id, label, vec) of the rows that take part, ``vec`` as integers."""
    x = F.col(vec_col).cast("array<double>")
    whole = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < DOMAIN / SCALE))
    return (vectors.where(F.coalesce(whole, F.lit(False)) & (F.size(x) > 0))
            .select("vec_id", "label", F.transform(x, lambda v: F.floor(v * SCALE).cast("int")).alias("vec")))


def cuts(width: int, parts: int) -> list[int]:
    return [k * width // parts for k in range(parts + 1)]


class Cells:
    """Per cell of one part's grid, the entries that some point of the cell may be nearest to."""

    def __init__(self, book: np.ndarray, cell: int):
        self.book, self.cell = book, cell
        self.edge = max(1, min(127, DOMAIN // cell))  # cells from -edge to edge, the outermost ones open
        self.masks: dict[bytes, int] = {}

    def candidates(self, cells: np.ndarray) -> np.ndarray:
        """Entry masks (bit e: entry e) of distinct cells, by box bounds."""
        low = cells.astype(np.int64) * self.cell
        high = low + (self.cell - 1)
        low[cells == -self.edge] = -DOMAIN
        high[cells == self.edge] = DOMAIN
        out = np.empty(len(cells), dtype=np.uint64)
        bit = np.uint64(1) << np.arange(len(self.book), dtype=np.uint64)
        for a in range(0, len(cells), 2048):
            lo, hi, e = low[a:a + 2048, None], high[a:a + 2048, None], self.book[None]
            near = np.maximum(0, np.maximum(lo - e, e - hi))
            far = np.maximum(np.abs(e - lo), np.abs(e - hi))
            least, most = (near * near).sum(2), (far * far).sum(2)
            out[a:a + 2048] = np.where(least <= most.min(1)[:, None], bit, np.uint64(0)).sum(1, dtype=np.uint64)
        return out

    def masks_of(self, points: np.ndarray) -> np.ndarray:
        """The cached entry mask of each point's cell."""
        cells = np.ascontiguousarray(np.clip(points // self.cell, -self.edge, self.edge).astype(np.int8))
        keys = cells.view(np.dtype((np.void, cells.shape[1]))).ravel()
        distinct, first, of = np.unique(keys, return_index=True, return_inverse=True)
        names = [k.tobytes() for k in distinct]
        new = [k for k, name in enumerate(names) if name not in self.masks]
        fresh = dict(zip((names[k] for k in new), self.candidates(cells[first[new]]).tolist())) if new else {}
        found = np.array([fresh[n] if n in fresh else self.masks[n] for n in names], dtype=np.uint64)
        if len(self.masks) + len(fresh) > CELLS:  # bounded memory: the cache starts anew
            self.masks = {}
        self.masks.update(list(fresh.items())[:CELLS])
        return found[of.ravel()]

    def assign(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of each point, among its cell's candidates."""
        n = len(points)
        entry, best = np.zeros(n, dtype=np.int64), np.full(n, np.iinfo(np.int64).max)
        if not points.shape[1]:
            return entry, np.zeros(n, dtype=np.int64)
        masks = self.masks_of(points)
        for e in range(len(self.book)):  # in order, so that ties keep the lower index
            rows = np.flatnonzero(masks >> np.uint64(e) & np.uint64(1))
            diff = points[rows] - self.book[e]
            far = np.einsum("ij,ij->i", diff, diff)
            closer = far < best[rows]
            rows = rows[closer]
            best[rows], entry[rows] = far[closer], e
        return entry, best


def matrices(batch: pa.RecordBatch) -> np.ndarray:
    """The batch's vectors, all of one length, as rows of 64-bit integers."""
    return np.stack(batch.column("vec").to_numpy(zero_copy_only=False)).astype(np.int64)


def coded(batch: pa.RecordBatch, cut: list[int], grids: list[Cells]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per part: its components, entries and distances."""
    whole = matrices(batch)
    for k, grid in enumerate(grids):
        points = whole[:, cut[k]:cut[k + 1]]
        yield points, *grid.assign(points)


def improved(vectors: DataFrame, books: Books, cut: list[int], cell: int) -> Books:
    """The codebooks after one round: floor of the mean of each entry's parts; unused entries stay."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grids = [Cells(b, cell) for b in books]
        sums, counts = [np.zeros_like(b) for b in books], [np.zeros(len(b), dtype=np.int64) for b in books]
        some = False
        for batch in batches:
            if batch.num_rows:
                some = True
                for k, (points, entry, _) in enumerate(coded(batch, cut, grids)):
                    counts[k] += np.bincount(entry, minlength=len(books[k]))
                    np.add.at(sums[k], entry, points)
        if some:
            rows = [(k, e, int(counts[k][e]), sums[k][e].tolist()) for k in range(len(books)) for e in range(len(books[k])) if counts[k][e]]
            part, entry, count, total = map(list, zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(count, pa.int64()),
                                              pa.array(total, pa.list_(pa.int64()))], names=["part", "entry", "n", "total"])
    sums = vectors.select("vec").mapInArrow(run, "part int, entry int, n long, total array<long>")
    wide = sums.select("part", "entry", "n", F.posexplode("total").alias("at", "value"))
    rows = (wide.groupBy("part", "entry", "at").agg(F.sum(F.col("value").cast("decimal(28,0)")).alias("value"), F.sum("n").alias("n"))
            .collect())  # at most entries x dimension rows
    out = [b.copy() for b in books]
    for r in rows:
        out[r["part"]][r["entry"], r["at"]] = int(r["value"]) // r["n"]
    return out


def trained(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, cell: int = CELL) -> tuple[Books, int]:
    """Codebooks (64 ``entries`` at most) fitted on all of ``vectors`` (from ``kept``), and the vectors' length; no books without vectors."""
    if not 0 < entries <= 64:
        raise ValueError("a codebook has 1 to 64 entries")
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "vec").select("vec").limit(1).collect()
    if not first:
        return [], 0
    width = len(first[0]["vec"])
    same = vectors.where(F.size("vec") == width)
    seeds = np.array([r["vec"] for r in same.orderBy(F.col("vec_id").asc_nulls_last(), "vec").select("vec").limit(entries).collect()], dtype=np.int64)
    cut = cuts(width, parts)
    books = [seeds[:, a:b] for a, b in zip(cut, cut[1:])]
    for _ in range(rounds):
        books = improved(same, books, cut, cell)
    return books, width


def encode(vectors: DataFrame, books: Books, width: int, cell: int = CELL) -> DataFrame:
    """(vec_id, label, code, error) of every vector of that length: ``code`` array<int> of entries in part order."""
    cut = cuts(width, len(books))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grids = [Cells(b, cell) for b in books]
        for batch in batches:
            if batch.num_rows:
                parts = [(entry, far) for _, entry, far in coded(batch, cut, grids)]
                code = np.stack([entry for entry, _ in parts], axis=1)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(list(code.astype(np.int32)), pa.list_(pa.int32())),
                                                  pa.array(sum(far for _, far in parts), pa.int64())], names=["vec_id", "label", "code", "error"])
    types = dict(vectors.dtypes)
    return (vectors.where(F.size("vec") == width).select("vec_id", "label", "vec")
            .mapInArrow(run, f"vec_id {types['vec_id']}, label {types['label']}, code array<int>, error long"))


def decode(codes: DataFrame, books: Books) -> DataFrame:
    """``codes`` plus ``vec``: the entries that a code names, joined (built-in functions over small literal tables)."""
    tables = [F.array(*[F.array(*[F.lit(int(v)) for v in entry]) for entry in b]) for b in books]
    return codes.withColumn("vec", F.concat(*[F.get(t, F.col("code")[k]) for k, t in enumerate(tables)]))


def digest(books: Books) -> str:
    return hashlib.sha256(",".join(str(v) for b in books for entry in b for v in entry.tolist()).encode()).hexdigest()


def report(vectors: DataFrame) -> DataFrame:
    """Per kept vector: code (hex), error, its label's summed error and the digest of all codebooks."""
    spark = vectors.sparkSession
    ship(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH))
    ints = kept(vectors)
    books, width = trained(ints)
    if not books:
        return ints.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"),
                           F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256")).limit(0)
    rows = stored(encode(ints, books, width))
    by_label = rows.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    hex_code = F.array_join(F.transform("code", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    return (rows.join(by_label, F.col("label").eqNullSafe(F.col("_label")))
            .select("vec_id", hex_code.alias("code"), "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256")))
