"""MinHash near-duplicates with tensored banding.

A table key joins one half key of a first small collection with one of a
second: ``SIDE`` half keys each, of ``HALF`` MinHash values. All SIDE x SIDE
pairs are tables, so 100 tables of four values need 2 x 10 x 2 = 40 MinHash
values instead of 400. Two sets of similarity s share a table with
probability (1 - (1 - s**HALF)**SIDE)**2: at 0.8 a pair is missed with 7e-5.
Candidates are verified on the full sets (see ``near_groups``).

A document's set is its distinct n-word shingles; with fewer words, the whole
sequence; without words it is empty and linked with nothing.

Scale: one pass hashes the texts; exact copies (equal sets) collapse to one
class; only classes that share a key have their texts read again, through a
join on the id. Signatures, candidate sets, links and components are written
to the shared checkpoint folder.

Defined cases: null text: empty set; null id: takes part, but is never the
smallest id; ``component_id`` is null only if no id of the component is known;
repeated rows are copies of each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.llm import bytewords as bw
from revlens.llm import near_groups
from revlens.llm.frames import stored, texts, tidy

SIDE, HALF = 10, 2
WIDTH = 2 * SIDE * HALF
PERCENT = 80
_SEED = np.random.default_rng(20240607)
_A = _SEED.integers(1, 1 << 63, WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _SEED.integers(0, 1 << 63, WIDTH, dtype=np.uint64)


def minhash(x: np.ndarray, a: np.ndarray = _A, b: np.ndarray = _B) -> np.ndarray:
    """MinHash values (upper 32 bits of a*x + b) of a set of 64-bit shingles."""
    low = np.full(len(a), 0xFFFFFFFF, dtype=np.uint64)
    for k in range(0, len(x), 2048):
        np.minimum(low, ((a[:, None] * x[None, k:k + 2048] + b[:, None]) >> np.uint64(32)).min(axis=1), out=low)
    return low.astype(np.uint32)


def half_keys(mh: np.ndarray) -> np.ndarray:
    """The 2 x SIDE half keys of each row of MinHash values."""
    v = mh.astype(np.uint64).reshape(-1, 2 * SIDE, HALF)
    half = np.zeros(v.shape[:2], dtype=np.uint64)
    for k in range(HALF):
        half = half * bw.BASE + v[:, :, k] + np.uint64(1)
    return bw.mix(half + np.arange(2 * SIDE, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))


def table_keys(mh: np.ndarray) -> np.ndarray:
    """The SIDE x SIDE table keys of each row of MinHash values."""
    half = half_keys(mh)
    return bw.mix(half[:, :SIDE, None] * np.uint64(0x9FB21C651E98DF25) + half[:, None, SIDE:]).reshape(len(mh), -1)


def set_name(x: np.ndarray) -> bytes:
    """128-bit name of a shingle set."""
    c = np.uint64(len(x))
    one = bw.mix(x ^ np.uint64(0x2545F4914F6CDD1D)).sum(dtype=np.uint64) + c
    two = bw.mix(x * np.uint64(0xDA942042E4DD58B5) + np.uint64(77)).sum(dtype=np.uint64) ^ c
    return int(one).to_bytes(8, "big") + int(two).to_bytes(8, "big")


def _sets(column, words: int) -> Iterator[np.ndarray]:
    _, _, _, h, per = bw.words(column, bw.NOT_SPACE)
    at = 0
    for n in per.tolist():
        yield bw.shingles(h[at:at + n], words)
        at += n


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, n, cid, mh, short) of every row; an empty set has null cid, mh and short."""
    d = texts(docs)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, cid, mh, short = [], [], [], []
            for x in _sets(batch.column("text"), words):
                n.append(len(x))
                cid.append(set_name(x) if len(x) else None)
                mh.append(minhash(x).tobytes() if len(x) else None)
                short.append(near_groups.short_set(x) if len(x) else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(cid, pa.binary()), pa.array(mh, pa.binary()),
                                              pa.array(short, pa.binary())], names=["doc_id", "n", "cid", "mh", "short"])
    kind = dict(d.dtypes)["doc_id"]
    return d.mapInArrow(run, f"doc_id {kind}, n long, cid binary, mh binary, short binary")


def components(docs: DataFrame, words: int = 4, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n, cid, root, component_id) of every row; an empty set has its own component."""
    d = texts(docs)
    signed = stored(signatures(docs, words))
    classes = stored(signed.where("n > 0").groupBy(F.col("cid").alias("name")).agg(F.first("n").alias("n"), F.first("mh").alias("mh"), F.min("doc_id").alias("doc_id"))
                     .withColumn("cid", F.monotonically_increasing_id()))

    def sets_of(ids: DataFrame) -> DataFrame:
        wanted = classes.join(ids, "cid").select(F.col("doc_id").alias("_id"), "cid", "name")
        near = d.join(wanted, F.col("doc_id").eqNullSafe(F.col("_id"))).select("text", "cid", "name")

        @tidy
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = [(c, x.tobytes()) for c, name, x in zip(batch.column("cid").to_pylist(), batch.column("name").to_pylist(), _sets(batch.column("text"), words)) if len(x) and set_name(x) == name]
                yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in out], pa.int64()), pa.array([x for _, x in out], pa.binary())], names=["cid", "shingles"])
        return near.mapInArrow(run, "cid long, shingles binary").dropDuplicates(["cid"])  # repeated ids

    def short_of(ids: DataFrame) -> DataFrame:
        names = classes.join(ids, "cid").select("name", F.col("cid").alias("_cid"))
        return signed.select("cid", "short").join(names, F.col("cid") == F.col("name")).groupBy("_cid").agg(F.first("short").alias("short")).withColumnRenamed("_cid", "cid")

    roots = near_groups.group(classes.select("cid", "n", "mh"), sets_of, short_of, table_keys, lambda mh: half_keys(mh)[:, :SIDE].copy(), WIDTH, percent)
    named = classes.select("cid", "name", "doc_id").join(roots, "cid", "left").select("name", F.coalesce("root", "cid").alias("root"), "doc_id")
    least = named.groupBy("root").agg(F.min("doc_id").alias("least"))
    by_class = named.join(least, "root").select(F.col("name").alias("cid"), "root", "least")
    return (signed.select("doc_id", "n", "cid").join(by_class, "cid", "left")
            .select("doc_id", "n", "cid", "root", F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id")))


def report(docs: DataFrame, words: int = 4, percent: int = PERCENT) -> DataFrame:
    """Per document: n_shingles, component_id, kept."""
    return components(docs, words, percent).select("doc_id", F.col("n").alias("n_shingles"), "component_id",
                                                   F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def one_of_each(docs: DataFrame, words: int = 5, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each component: the smallest id; of several rows with that id, one.

    Rows with an empty set all stay.
    """
    names = docs.columns
    found = components(docs, words, percent)
    kept = (found.where(F.col("n") > 0).groupBy("root").agg(F.min(F.struct("doc_id", "cid")).alias("k"), F.min("component_id").alias("c"))
            # a null id sorts first: where a known id exists, it is taken
            .select(F.col("c").alias("_id"), "root"))
    best = (found.where(F.col("n") > 0).join(kept, "root").where(F.col("doc_id").eqNullSafe(F.col("_id")))
            .groupBy("root").agg(F.min("_id").alias("_id"), F.min("cid").alias("_cid"), (F.count(F.lit(1)) > 1).alias("_many")))
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.col("doc_id").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    empty = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    near = held.where(~empty).join(best.select("_id", "_cid", "_many"), F.col("doc_id").eqNullSafe(F.col("_id"))).select("_row", "text", "_cid", "_many")

    @tidy
    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows whose set is the wanted one."""
        for batch in batches:
            keep = [len(x) > 0 and set_name(x) == c for c, x in zip(batch.column("_cid").to_pylist(), _sets(batch.column("text"), words))]
            yield batch.select(["_row", "_cid"]).filter(pa.array(keep, pa.bool_()))

    def checked(rows: DataFrame) -> DataFrame:
        return rows.select("_row", "text", "_cid").mapInArrow(wanted, held.select("_row", F.lit(None).cast("binary").alias("_cid")).schema)

    # rows are shuffled once; only ids that occur in several rows need the second step
    one = checked(near.where(~F.col("_many"))).select("_row")
    one = one.union(checked(near.where("_many")).groupBy("_cid").agg(F.first("_row").alias("_row")).select("_row"))
    return one.union(held.where(empty).select("_row")).select(*[F.col(f"_row.`{c}`").alias(c) for c in names])
