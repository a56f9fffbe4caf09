"""Benchmark decontamination with a generalised suffix automaton.

The items' words (digits, letters and everything beyond ASCII, A-Z
lower-cased) feed one suffix automaton. Every document streams its words
through it and tracks the longest match that ends at each word. Where the
match is at least ``window`` words long, the last ``window`` words are hit; an
item of fewer words is hit as a whole. An item occurs in a document if one of
its windows does.

Scale: a document needs no other document, so matching is a ``mapInArrow``
step without a shuffle. Repeated pieces of the benchmark are dropped, and the
rest is cut by a running word count into shards of at most ``SHARD_WORDS`` item
words (long items are cut into pieces that overlap by ``window - 1`` words). A
benchmark of one shard is broadcast. Of a larger one the shards are written to
the checkpoint folder and matched one after another: the driver and the
workers hold one shard at a time, the hits of each are written there, too, and
joined to the documents at the end. The documents are read once a shard.
Inside a task the automaton restarts where a match cannot go on: numpy finds
the runs of words whose neighbouring pairs all occur in the items, and only
runs as long as the shortest window are streamed.

Defined cases: null text or id: no words, null id kept; empty text: no words;
repeated documents: each row is judged by itself; repeated items: one id;
an item with a null id marks words but is not listed; an empty benchmark marks
nothing. Other columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revlens.llm import bytewords as bw
from revlens.llm.frames import checkpoint_dir, small_batches, stored, texts, tidy

WINDOW = 10
SHARD_WORDS = 200_000
PIECE_WORDS = 20_000
#: shards that a task of the running word count cuts, and whose hits are kept apart
SHARDS_AT_ONCE = 16
#: the pipeline drops a document of which more than this share of words is hit
MAX_COVERAGE = 0.5


class Automaton:
    """Suffix automaton over the word sequences of one shard."""

    def __init__(self, items: list[tuple[str | None, bytes, bool]], window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.items: dict[int, set] = {}
        self.short: dict[int, list] = {}
        self.shortest = window
        sequences = [(item, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in text.split(b" ")], short)
                     for item, text, short in items if text]
        pairs = set()
        for _, ids, _ in sequences:
            self._add(ids)
            pairs.update(zip(ids, ids[1:]))
        for item, ids, short in sequences:
            self._mark(item, ids, short)
        self.terms = list(self.vocabulary)
        if self.terms:
            lengths = np.array([len(t) for t in self.terms])
            ends = np.cumsum(lengths + 1) - 1
            raw = np.frombuffer(b" ".join(self.terms) + b" ", dtype=np.uint8)
            keys = bw.hashes(raw, ends - lengths, ends)
        else:
            keys = np.zeros(0, dtype=np.uint64)
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        width = max(1, len(self.terms))
        self.pairs = np.sort(np.array([a * width + b for a, b in pairs], dtype=np.int64))

    def _add(self, ids: list[int]) -> None:
        last = 0
        for w in ids:
            last = self._extend(last, w)

    def _new(self, length: int, link: int, nxt: dict) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(nxt)
        return len(self.length) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        """The state for the words of ``p`` then ``w``, cut off from the longer ones in ``q``."""
        clone = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, w: int) -> int:
        q = self.next[last].get(w)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, w, q)
        state, p = self._new(self.length[last] + 1, 0, {}), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = state
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[state] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
        return state

    def _mark(self, item: str | None, ids: list[int], short: bool) -> None:
        s, n = 0, 0
        for w in ids:
            s, n = self.next[s][w], n + 1
            if not short and n >= self.window:
                v = self._of_length(s, self.window)
                self.items.setdefault(v, set()).add(item)
        if short:
            self.shortest = min(self.shortest, n)
            self.short.setdefault(self._of_length(s, n), []).append((n, item))

    def _of_length(self, s: int, n: int) -> int:
        """The state of the last ``n`` words of the match at ``s``."""
        while self.length[self.link[s]] >= n:
            s = self.link[s]
        return s

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        """Word numbers of hashes; -1: in no item."""
        if not len(self.keys):
            return np.full(len(hashes), -1, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[at] == hashes, self.order[at], -1)

    def stream(self, ids: list[int], hit: np.ndarray, base: int) -> set:
        """Stream words; mark hits in ``hit[base:]`` and return the items met."""
        s = n = 0
        met: set = set()
        for i, w in enumerate(ids):
            while s and w not in self.next[s]:
                s = self.link[s]
                n = self.length[s]
            if w in self.next[s]:
                s, n = self.next[s][w], n + 1
            else:
                s = n = 0
                continue
            if n >= self.window:
                v = self._of_length(s, self.window)
                if v in self.items:
                    met |= self.items[v]
                    hit[base + i + 1 - self.window:base + i + 1] = True
            if self.short:
                v = s
                while v > 0:
                    for k, item in self.short.get(v, ()):
                        if k <= n:
                            met.add(item)
                            hit[base + i + 1 - k:base + i + 1] = True
                    v = self.link[v]
        return met

    def runs(self, ids: np.ndarray, document: np.ndarray) -> Iterator[tuple[int, int]]:
        """Maximal runs of words of one document whose neighbouring pairs are all in items."""
        if not len(ids):
            return
        good = ids >= 0
        code = np.where(good[:-1] & good[1:] & (document[:-1] == document[1:]), ids[:-1] * max(1, len(self.terms)) + ids[1:], -1)
        joined = np.zeros(len(code), dtype=bool)
        if len(self.pairs):
            at = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
            joined = self.pairs[at] == code
        edge = np.flatnonzero(~joined) + 1
        starts, ends = np.concatenate([[0], edge]), np.concatenate([edge, [len(ids)]])
        keep = (ends - starts >= self.shortest) & good[starts]
        yield from zip(starts[keep].tolist(), ends[keep].tolist())


def benchmark_shards(items: DataFrame, window: int, limit: int) -> list[Callable[[], list[tuple]]]:
    """Readers of the shards of the items' distinct pieces: at most ``limit`` words each, or one longer piece."""
    def pieces(batches):
        for batch in batches:
            raw, starts, ends, _, per = bw.words(batch.column("text"), bw.LETTER_DIGIT)
            out, at = [], 0
            for item, n in zip(batch.column("id").to_pylist(), per.tolist()):
                terms = [raw[a:b].tobytes() for a, b in zip(starts[at:at + n], ends[at:at + n])]
                at += n
                for k in range(0, max(1, n - window + 1), PIECE_WORDS):
                    part = terms[k:k + PIECE_WORDS + window - 1]
                    if part:
                        out.append((item, b" ".join(part), n < window, len(part)))
            cols = list(zip(*out)) if out else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.binary()),
                                              pa.array(cols[2], pa.bool_()), pa.array(cols[3], pa.int64())],
                                             names=["id", "words", "short", "n"])

    small_batches(items.sparkSession)
    cut = (items.select(F.col("item_id").cast("string").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
           .mapInArrow(pieces, "id string, words binary, short boolean, n long")
           .dropDuplicates(["id", "words", "short"]))
    total, largest = cut.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()

    def reader(rows: Callable[[], DataFrame]) -> Callable[[], list[tuple]]:
        return lambda: [(r.id, bytes(r.words), r.short) for r in rows().select("id", "words", "short").collect()]

    if total <= limit:
        return [reader(lambda: cut)]
    parts, step = -(-total // (SHARDS_AT_ONCE * limit)), max(1, limit - largest + 1)
    before = Window.partitionBy("p").orderBy("h").rowsBetween(Window.unboundedPreceding, -1)
    folder = f"{checkpoint_dir(items.sparkSession).rstrip('/')}/benchmark-{uuid.uuid4().hex}"
    (cut.withColumn("h", F.xxhash64("id", "words", "short")).withColumn("p", F.pmod("h", F.lit(parts)))
     .withColumn("k", F.floor(F.coalesce(F.sum("n").over(before), F.lit(0)) / F.lit(step)).cast("long"))
     .select("id", "words", "short", "p", "k").write.partitionBy("p", "k").parquet(folder))
    spark = items.sparkSession
    shards = sorted(tuple(r) for r in spark.read.parquet(folder).select("p", "k").distinct().collect())
    return [reader(lambda p=p, k=k: spark.read.parquet(f"{folder}/p={p}/k={k}")) for p, k in shards]


def match(docs: DataFrame, items: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``docs`` (with a string column ``text``) plus ``_n_words`` long, ``_hit`` binary (one
    bit a word, empty: none) and ``_items`` array<string> (ids of the items that occur)."""
    spark = docs.sparkSession
    small_batches(spark)
    names = docs.columns
    marked = docs.withColumns({"_n_words": F.lit(0).cast("long"), "_hit": F.lit(b""), "_items": F.array().cast("array<string>")}).schema
    shards = benchmark_shards(items, window, shard_words)
    if len(shards) == 1:
        return docs.mapInArrow(_marker(spark.sparkContext.broadcast(shards[0]()), window), marked)
    docs = stored(docs.withColumn("_at", F.monotonically_increasing_id()))
    found: list[DataFrame] = []
    for shard in shards:
        sent = spark.sparkContext.broadcast(shard())
        found.append(stored(docs.select("_at", "text").mapInArrow(_finder(sent, window), "_at long, _hit binary, _items array<string>")))
        sent.destroy()
        if len(found) == SHARDS_AT_ONCE:
            found = [stored(_joined(found))]
    out = docs.join(_joined(found), "_at", "left").select(*[F.col(f"`{c}`") for c in names], F.coalesce("_hit", F.lit(b"")).alias("_hit"),
                                                          F.coalesce("_items", F.array().cast("array<string>")).alias("_items"))
    return out.mapInArrow(_counted, out.withColumn("_n_words", F.lit(0).cast("long")).schema).select(*[f"`{c}`" for c in marked.names])


def _found(automaton: Automaton, column) -> tuple[np.ndarray, dict[int, bytes], dict[int, list[str]]]:
    """Words of each text; of the texts with hits: the bits and the items."""
    raw, starts, ends, h, per = bw.words(column, bw.LETTER_DIGIT)
    ids = automaton.lookup(h)
    document = np.repeat(np.arange(len(per)), per)
    first = np.concatenate([[0], np.cumsum(per)])
    hits: dict[int, np.ndarray] = {}
    met: dict[int, set] = {}
    for a, b in automaton.runs(ids, document):
        d = int(document[a])
        own = ids[a:b].tolist()
        # equal hashes are confirmed on the words themselves
        own = [w if automaton.terms[w] == raw[starts[a + i]:ends[a + i]].tobytes() else -1 for i, w in enumerate(own)]
        hit = hits.setdefault(d, np.zeros(per[d], dtype=bool))
        met.setdefault(d, set()).update(automaton.stream(own, hit, a - int(first[d])))
    some = [d for d, hit in hits.items() if hit.any()]
    return per, {d: np.packbits(hits[d]).tobytes() for d in some}, {d: sorted(i for i in met[d] if i is not None) for d in some}


def _marker(sent, window: int):
    """All rows with their marks."""
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(sent.value, window)
        for batch in batches:
            per, hits, met = _found(automaton, batch.column("text"))
            rows = range(batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(per, pa.int64()), pa.array([hits.get(d, b"") for d in rows], pa.binary()),
                                              pa.array([met.get(d, []) for d in rows], pa.list_(pa.string()))],
                                             names=[*batch.schema.names, "_n_words", "_hit", "_items"])
    return run


def _finder(sent, window: int):
    """The marks of the rows with hits."""
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(sent.value, window)
        for batch in batches:
            _, hits, met = _found(automaton, batch.column("text"))
            at = sorted(hits)
            yield pa.RecordBatch.from_arrays([batch.column("_at").take(pa.array(at, pa.int64())), pa.array([hits[d] for d in at], pa.binary()),
                                              pa.array([met[d] for d in at], pa.list_(pa.string()))], names=["_at", "_hit", "_items"])
    return run


def _joined(found: list[DataFrame]) -> DataFrame:
    """One row for each document with hits: the bits of all shards and the items, sorted."""
    rows = reduce(DataFrame.unionAll, found).groupBy("_at").agg(
        F.collect_list("_hit").alias("_hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("_items")))).alias("_items"))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = [np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in bits]).tobytes() for bits in batch.column("_hits").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("_at"), pa.array(hit, pa.binary()), batch.column("_items")], names=["_at", "_hit", "_items"])
    return rows.mapInArrow(run, "_at long, _hit binary, _items array<string>")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with the number of their words."""
    for batch in batches:
        raw, offsets = bw.buffer_of(batch.column("text"))
        per = bw.spans(bw.LOWER[raw], offsets, bw.LETTER_DIGIT)[2]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(per, pa.int64())], names=[*batch.schema.names, "_n_words"])


def report(docs: DataFrame, items: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256, contaminated."""
    m = match(texts(docs), items, window, shard_words)
    bits = F.transform(F.sequence(F.lit(1), F.length("_hit")), lambda i: F.bit_count(F.conv(F.hex(F.substring("_hit", i, F.lit(1))), 16, 10).cast("long")))
    n_hit = F.aggregate(bits, F.lit(0), lambda x, y: x + y)
    n_hit = F.when(F.length("_hit") > 0, n_hit).otherwise(F.lit(0)).cast("long")
    return m.select("doc_id", F.col("_n_words").alias("n_words"), n_hit.alias("n_hit"), F.size("_items").cast("long").alias("n_items"),
                    F.sha2(F.array_join("_items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def clean(docs: DataFrame, items: DataFrame, window: int = WINDOW, max_coverage: float = MAX_COVERAGE) -> DataFrame:
    """``docs`` without the hit spans; a document with over ``max_coverage`` of its words hit goes.

    A removed span reaches from the first hit word to the end of the last one of
    a run. Documents without a hit, and every other column, are unchanged.
    """
    names = docs.columns
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    m = match(held, items, window)

    @tidy
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = bw.buffer_of(batch.column("text"))
            starts, ends, per = bw.spans(bw.LOWER[raw], offsets, bw.LETTER_DIGIT)
            first = np.concatenate([[0], np.cumsum(per)])
            out, gone = batch.column("text").to_pylist(), [False] * batch.num_rows
            for d, bits in enumerate(batch.column("_hit").to_pylist()):
                if bits:
                    hit = np.unpackbits(np.frombuffer(bits, np.uint8), count=int(per[d])).astype(bool)
                    gone[d] = bool(hit.sum() > max_coverage * per[d])
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
                    s, e = starts[first[d]:first[d + 1]], ends[first[d]:first[d + 1]]
                    left, parts = int(offsets[d]), []
                    for a, b in zip(edge[::2], edge[1::2]):
                        parts.append(raw[left:s[a]].tobytes())
                        left = int(e[b - 1])
                    parts.append(raw[left:offsets[d + 1]].tobytes())
                    out[d] = b"".join(parts).decode("utf-8")
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(out, batch.schema.field("text").type), pa.array(gone, pa.bool_())],
                                             names=["_row", "text", "_gone"])

    schema = m.select("_row", "text", F.lit(False).alias("_gone")).schema
    done = m.select("_row", "text", "_hit").mapInArrow(cut, schema).where(~F.col("_gone"))
    null = F.col("_row.text").isNull()
    return done.select(*[(F.when(~null, F.col("text")) if c == "text" else F.col(f"_row.`{c}`")).alias(c) for c in names])
