"""MinHash document fingerprints, and near-duplicates by signature bands.

A text's shingles are runs of five words (A-Z lower-cased), the first ones
padded at the text's start, so that short texts have shingles too. ``PERMS``
universal hash functions (multiply, add, upper 32 bits) of every shingle are
taken in numpy; the fingerprint is the smallest value of each, in hex. The
likeness of two fingerprints is the share of equal values, an estimate of the
Jaccard similarity of the shingle sets.

``edited_report`` pairs each text with the next one in descending id order
(ties by text, null ids last, after the last comes the first): rows are dealt
into ranges of the id whose cuts are approximate quantiles, and the first id
of each range also goes to the range before it, so each text is shuffled
once. ``near_duplicates`` joins bands of the signatures in Spark and verifies
Jaccard on the full sets.

Defined cases: a null text is empty; a text without words has no shingles:
all values are the largest, and two such texts are alike (1.0). Repeated
documents: row by row; copies come next to each other. Other columns are not
read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revlens.llm import bytewords as bw
from revlens.llm import near_groups
from revlens.llm.frames import slices, stored, text_bytes, texts

PERMS = 64
WORDS = 5
BANDS, ROWS = 16, 4
RANGE_BYTES = 12 << 20
_SEED = np.random.default_rng(97)
_A = _SEED.integers(1, 1 << 63, PERMS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _SEED.integers(0, 1 << 63, PERMS, dtype=np.uint64)


def padded_shingles(h: np.ndarray, per: np.ndarray, words: int = WORDS) -> np.ndarray:
    """One shingle for each word, of the ``words`` words that end there, padded at each text's start."""
    out = np.zeros(len(h), dtype=np.uint64)
    place = np.arange(len(h)) - np.repeat(np.cumsum(per) - per, per)
    for back in range(words - 1, -1, -1):
        word = np.empty_like(h)
        word[back:] = h[:max(0, len(h) - back)]
        word[:back] = 0
        out = out * bw.BASE + np.where(place >= back, word, np.uint64(0x51))
    return bw.mix(out)


def signatures(column, words: int = WORDS) -> np.ndarray:
    """MinHash values of each text of a column, one row a text."""
    _, _, _, h, per = bw.words(column, bw.NOT_SPACE)
    x = padded_shingles(h, per, words)
    out = np.full((len(per), PERMS), 0xFFFFFFFF, dtype=np.uint32)
    full = np.flatnonzero(per)
    if len(full):
        ends = np.cumsum(per)
        starts = (ends - per)[full]
        lo = 0
        while lo < len(full):  # about SPAN shingles at a time
            hi = max(lo + 1, int(np.searchsorted(ends[full], starts[lo] + bw.SPAN // 4, "right")))
            part = x[starts[lo]:ends[full[hi - 1]]]
            for k in range(PERMS):
                out[full[lo:hi], k] = np.minimum.reduceat((part * _A[k] + _B[k]) >> np.uint64(32), starts[lo:hi] - starts[lo])
            lo = hi
    return out


def hexes(sig: np.ndarray) -> list[str]:
    raw = sig.astype(">u4").tobytes().hex()
    n = PERMS * 8
    return [raw[k:k + n] for k in range(0, len(raw), n)]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(axis=1)


def ranges(d: DataFrame, target: int = RANGE_BYTES) -> DataFrame:
    """``d`` (doc_id, text) plus ``part`` (id range, descending) and ``ghost``: the rows that a range ends with
    are followed by the first id's rows of the next range (after the last: of the first)."""
    parts = slices(text_bytes(d), target)
    if dict(d.dtypes)["doc_id"] in ("bigint", "int", "smallint", "tinyint"):
        key = F.col("doc_id").cast("double")
    else:
        key = F.col("doc_id").cast("string").cast("double")
    cuts = d.select(key.alias("k")).approxQuantile("k", [i / parts for i in range(1, parts)], 0.25 / parts) if parts > 1 else []
    edges = np.unique(np.array(cuts or [], dtype=float))

    @F.pandas_udf("int")
    def range_of(k: pd.Series) -> pd.Series:
        v = k.to_numpy(dtype=float)
        return pd.Series(np.where(np.isnan(v), len(edges) + 1, len(edges) - np.searchsorted(edges, v, "right")).astype(np.int32))

    placed = d.select("doc_id", "text", range_of(key).alias("part"))
    # one row per range: its first id and the range before it
    firsts = d.select("doc_id", range_of(key).alias("part")).groupBy("part").agg(F.max("doc_id").alias("first"))
    order = Window.orderBy("part")
    firsts = firsts.withColumn("before", F.coalesce(F.lag("part").over(order), F.max("part").over(Window.partitionBy())))
    own = placed.join(F.broadcast(firsts), "part")  # at most as many rows as there are ranges
    first = F.col("doc_id").eqNullSafe(F.col("first"))
    homes = F.when(first, F.array(F.struct(F.col("part").alias("part"), F.lit(0).alias("ghost")), F.struct(F.col("before").alias("part"), F.lit(1).alias("ghost")))) \
        .otherwise(F.array(F.struct(F.col("part").alias("part"), F.lit(0).alias("ghost"))))
    return own.select("doc_id", "text", F.explode(homes).alias("h")).select("doc_id", "text", "h.part", "h.ghost")


def edited_report(docs: DataFrame, target: int = RANGE_BYTES) -> DataFrame:
    """Per document: n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    d = texts(docs)
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(table: pa.Table) -> pa.Table:
        ids, text, ghost = (table.column(c).to_pylist() for c in ("doc_id", "text", "ghost"))
        # real rows, then the next range's first rows; ids descend, null last, ties by text
        order = sorted(range(len(ids)), key=text.__getitem__)
        order.sort(key=lambda i: (ids[i] is not None, ids[i] if ids[i] is not None else 0), reverse=True)  # stable in reverse, too
        order.sort(key=ghost.__getitem__)
        real = len(ids) - sum(ghost)
        order = order[:real + 1]
        text = [text[i] for i in order]
        edited = []
        for t, nxt in zip(text[:real], text[1:]):
            k = len(t) // 3
            edited.append(t[:len(t) - k] + nxt[:k])
        own, other = signatures(pa.array(text, pa.large_string())), signatures(pa.array(edited, pa.large_string()))
        return pa.table([pa.array([ids[i] for i in order[:real]], table.schema.field("doc_id").type), pa.array([len(t) for t in text[:real]], pa.int64()),
                         pa.array([hashlib.sha256(t.encode("utf-8")).hexdigest() for t in edited], pa.string()), pa.array(hexes(own)[:real], pa.string()),
                         pa.array(hexes(other), pa.string()), pa.array(likeness(own[:real], other)), pa.array(likeness(own[:real], own[1:real + 1]))], names=names)

    kind = dict(d.dtypes)["doc_id"]
    return ranges(d, target).groupBy("part").applyInArrow(
        run, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def band_keys(mh: np.ndarray) -> np.ndarray:
    """One key per band of ROWS values."""
    v = mh.astype(np.uint64).reshape(-1, BANDS, ROWS)
    key = np.zeros(v.shape[:2], dtype=np.uint64)
    for k in range(ROWS):
        key = key * bw.BASE + v[:, :, k] + np.uint64(1)
    return bw.mix(key + np.arange(BANDS, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = 80) -> DataFrame:
    """(doc_id, n, component_id) of every row: bands joined in Spark, Jaccard verified on the full sets."""
    from revlens.llm.minhash_tensor import set_name
    d = texts(docs)

    def sets(column) -> Iterator[np.ndarray]:
        _, _, _, h, per = bw.words(column, bw.NOT_SPACE)
        x = padded_shingles(h, per, words)
        for a, b in zip((np.cumsum(per) - per).tolist(), np.cumsum(per).tolist()):
            yield np.unique(x[a:b])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = [(len(x), set_name(x) if len(x) else None, near_groups.short_set(x)) for x in sets(batch.column("text"))]
            mh = [m.tobytes() for m in signatures(batch.column("text"), words)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([n for n, _, _ in s], pa.int64()), pa.array([c for _, c, _ in s], pa.binary()),
                                              pa.array(mh, pa.binary()), pa.array([x for _, _, x in s], pa.binary())], names=["doc_id", "n", "cid", "mh", "short"])

    signed = stored(d.mapInArrow(sign, f"doc_id {dict(d.dtypes)['doc_id']}, n long, cid binary, mh binary, short binary"))
    classes = stored(signed.where("n > 0").groupBy(F.col("cid").alias("name")).agg(F.first("n").alias("n"), F.first("mh").alias("mh"), F.min("doc_id").alias("doc_id"))
                     .withColumn("cid", F.monotonically_increasing_id()))

    def sets_of(ids: DataFrame) -> DataFrame:
        near = d.join(classes.join(ids, "cid").select(F.col("doc_id").alias("_id"), "cid", "name"), F.col("doc_id").eqNullSafe(F.col("_id"))).select("text", "cid", "name")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = [(c, x.tobytes()) for c, name, x in zip(batch.column("cid").to_pylist(), batch.column("name").to_pylist(), sets(batch.column("text"))) if len(x) and set_name(x) == name]
                yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in out], pa.int64()), pa.array([x for _, x in out], pa.binary())], names=["cid", "shingles"])
        return near.mapInArrow(run, "cid long, shingles binary").dropDuplicates(["cid"])

    def short_of(ids: DataFrame) -> DataFrame:
        names = classes.join(ids, "cid").select("name", F.col("cid").alias("_cid"))
        return signed.select("cid", "short").join(names, F.col("cid") == F.col("name")).groupBy("_cid").agg(F.first("short").alias("short")).withColumnRenamed("_cid", "cid")

    roots = near_groups.group(classes.select("cid", "n", "mh"), sets_of, short_of, band_keys, band_keys, PERMS, percent)
    named = classes.select("cid", "name", "doc_id").join(roots, "cid", "left").select("name", F.coalesce("root", "cid").alias("root"), "doc_id")
    by_class = named.join(named.groupBy("root").agg(F.min("doc_id").alias("least")), "root").select(F.col("name").alias("cid"), "least")
    return signed.select("doc_id", "n", "cid").join(by_class, "cid", "left").select(
        "doc_id", "n", F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))
