"""Toxicity from a weighted lexicon matched by Aho-Corasick.

Texts are folded first: lower case, NFKC compatibility forms, look-alike
letters of other scripts to Latin, digits and signs that stand for letters to
those letters (``i`` and ``l`` share one class, since ``1`` stands for both),
zero-width characters away and punctuation to spaces. The lexicon is learned
from labelled rows: whole words and word beginnings whose document frequency
differs between the classes, weighted by the smoothed log odds. One automaton
finds lexicon terms and exception phrases; a term inside an exception phrase
does not count. The features are normalised by length and a logistic fit
turns them into a score between 0 and 1.

Scale: learning reads at most about ``train_rows`` labelled rows (a hash
sample when there are more; the ids, bounded by that number, are broadcast),
and counts terms per task before the shuffle. Scoring is one ``mapInArrow``
without a shuffle. The model (at most ``LEXICON`` terms) is all the driver holds.

Defined cases: null or empty text: no hits, the score of an empty text; null
label or id: not learned from; several labels of one id: the largest counts;
no usable labels: score 0; repeated documents are scored row by row.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.llm.frames import crc_rest, texts, tidy

#: bound on the labelled rows a fit reads
TRAIN_ROWS = 20_000
#: bound on the terms of a lexicon
LEXICON = 4_000
MIN_DOCS = 4
#: least weight (log odds) of a term, and least deviation (G statistic)
MIN_WEIGHT, MIN_G = 2.0, 12.0
PREFIXES = range(4, 9)
#: terms that a task counts before it sends partial counts on, about 150 bytes each
HELD_TERMS = 150_000
LONGEST = 24

#: look-alike letters of other scripts
LOOKALIKES = dict(zip("аеорсухѕіјԁһкмтвнοαιυνρτκεχɡ", "aeopcyxsijdhkmtbhoaiuvptkexg"))
#: digits and signs written for letters; i and l are one class
SUBSTITUTES = {"0": "o", "1": "l", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "i": "l"}
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "clown school", "loser bracket", "pathetic fallacy")

_OTHER = re.compile(r"[Ͱ-ԯɡ​-‏⁠﻿＀-￯]")
_TABLE = {i: " " for i in range(128) if not chr(i).isalnum()} | {ord(k): v for k, v in (LOOKALIKES | SUBSTITUTES).items()} | \
    {i: None for i in (*range(0x200B, 0x2010), 0x2060, 0xFEFF)}
_ASCII = bytes(ord(_TABLE.get(i, chr(i)) or " ") for i in range(128)) + bytes(range(128, 256))


def fold(text: str) -> str:
    """The folded text, with a space at both ends."""
    low = text.lower()
    if low.isascii():
        return f" {low.encode('ascii').translate(_ASCII).decode('ascii')} "
    if _OTHER.search(low):
        low = unicodedata.normalize("NFKC", low).lower()
    return f" {low.translate(_TABLE)} "


def terms(folded: str) -> set[str]:
    """Word beginnings (`` begin``) and whole words (`` word ``) of a folded text."""
    out = set()
    for w in set(folded.split()):
        w = f" {w[:LONGEST + 1]}"
        if len(w) - 1 <= LONGEST:
            out.add(f"{w} ")
        out.update(w[:k + 1] for k in PREFIXES if k < len(w))
    return out


@dataclass
class Model:
    """A fitted lexicon: weights by term, exception phrases, logistic coefficients."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = EXCEPTIONS
    coefficients: tuple[float, ...] | None = None

    def automaton(self):
        import ahocorasick
        a = ahocorasick.Automaton()
        for term, w in self.weights.items():
            a.add_word(term, (len(term), w))
        for phrase in self.exceptions:
            t = f" {' '.join(fold(phrase).split())} "
            a.add_word(t, (len(t), None))
        a.make_automaton()
        return a

    def features(self, automaton, text: str) -> tuple[float, float, float, float]:
        """(hits by length, weight by length, largest weight, any hit)."""
        folded = fold(text)
        found = list(automaton.iter(folded)) if len(automaton) else []
        safe = [(end - n + 1, end) for end, (n, w) in found if w is None]
        best: dict[int, float] = {}
        for end, (n, w) in found:
            if w is not None and not any(a <= end - n + 1 <= b for a, b in safe):
                best[end - n + 1] = max(w, best.get(end - n + 1, 0.0))  # one hit a word
        if not best:
            return 0.0, 0.0, 0.0, 0.0
        total, length = sum(best.values()), 20.0 + len(folded) / 6.0
        return np.log1p(100 * len(best) / length), np.log1p(100 * total / length), max(best.values()), 1.0

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.coefficients is None:
            return np.zeros(len(x))
        z = x @ np.array(self.coefficients[1:]) + self.coefficients[0]
        return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def labelled(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, held_out_mod: int = 5) -> DataFrame:
    """(text, toxic) of at most about ``train_rows`` rows that may be learned from."""
    usable = (labels.select(F.col("doc_id").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
              .where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (crc_rest("doc_id", held_out_mod) != 0))
              .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    n = usable.count()
    if n > train_rows:
        usable = usable.where(F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(1 << 20)) < int((1 << 20) * train_rows / n))
    return texts(docs).join(F.broadcast(usable), "doc_id").select("text", "toxic")  # train_rows ids at most, in expectation


@tidy
def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = (Counter(), Counter())
    rows = [0, 0]
    schema = pa.schema([("term", pa.string()), ("toxic", pa.int32()), ("n", pa.int64())])

    def flush():
        data = [(t, k, n) for k in (0, 1) for t, n in seen[k].items()] + [(None, k, rows[k]) for k in (0, 1)]
        return pa.RecordBatch.from_pydict(dict(zip(schema.names, map(list, zip(*data)))), schema=schema)

    for batch in batches:
        for text, k in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            k = int(k > 0)
            rows[k] += 1
            seen[k].update(terms(fold(text)))
        if len(seen[0]) + len(seen[1]) > HELD_TERMS:  # bounded memory: partial counts go on
            yield flush()
            seen, rows = (Counter(), Counter()), [0, 0]
    yield flush()


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, exceptions: tuple[str, ...] = EXCEPTIONS,
        held_out_mod: int = 5) -> Model:
    """Learn lexicon and coefficients from the labelled rows that are not held out."""
    train = labelled(docs, labels, train_rows, held_out_mod)
    per_term = (train.mapInArrow(_count, "term string, toxic int, n long").groupBy("term")
                .agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("t"),
                     F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("c")))
    # the row of the null term has the class sizes; a term must be frequent enough to come back at all
    rows = per_term.where(F.col("term").isNull() | ((F.col("t") >= MIN_DOCS) & (F.col("t") > F.col("c") / 4)))
    rows = rows.orderBy(F.col("term").isNotNull(), (F.col("t") / (F.col("c") + 1.0) * F.col("t")).desc(), "term").limit(8 * LEXICON + 1).collect()
    sizes = next(((r.t, r.c) for r in rows if r.term is None), (0, 0))
    if not min(sizes):
        return Model({}, exceptions, None)
    found = []
    for r in rows:
        if r.term is None:
            continue
        weight = np.log((r.t + 0.5) / (sizes[0] + 1)) - np.log((r.c + 0.5) / (sizes[1] + 1))
        expected = (r.t + r.c) * np.array([sizes[0], sizes[1]]) / sum(sizes)
        g = 2 * sum(o * np.log(o / e) for o, e in zip((r.t, r.c), expected) if o)
        if weight >= MIN_WEIGHT and g >= MIN_G:
            found.append((r.term, float(weight), float(g)))
    # a longer term is kept only where it says more than its beginning does
    chosen: dict[str, float] = {}
    for term, weight, _ in sorted(sorted(found, key=lambda f: -f[2])[:LEXICON], key=lambda f: (len(f[0]), f[0])):
        if not any(term[:k] in chosen and chosen[term[:k]] >= weight - 0.7 for k in range(3, len(term))):
            chosen[term] = round(weight, 4)
    model = Model(chosen, exceptions, None)
    known = train.mapInArrow(_features(model), "a double, b double, c double, d double, y int").collect()  # train_rows rows at most
    x = np.array([[r.a, r.b, r.c, r.d] for r in known])
    model.coefficients = logistic(x, np.array([float(r.y > 0) for r in known]))
    return model


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.5, rounds: int = 60) -> tuple[float, ...]:
    """Ridge logistic regression by Newton steps; intercept first."""
    z = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(z.shape[1])
    penalty = np.diag([1e-6] + [ridge] * x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p) + 1e-9)[:, None]) + penalty, z.T @ (p - y) + penalty @ w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(float(v) for v in w)


def _features(model: Model):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = model.automaton()
        for batch in batches:
            x = np.array([model.features(automaton, t) for t in batch.column("text").to_pylist()]).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([*(pa.array(x[:, i]) for i in range(4)), batch.column("toxic").cast(pa.int32())],
                                             names=["a", "b", "c", "d", "y"])
    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` (with a string column ``text``) plus ``_score`` double."""
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = model.automaton()
        for batch in batches:
            x = np.array([model.features(automaton, t or "") for t in batch.column("text").to_pylist()]).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.scores(x), pa.float64())], names=[*batch.schema.names, "_score"])
    small = docs.withColumn("_score", F.lit(0.0).cast("double"))
    return docs.mapInArrow(run, small.schema)


def report(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    model = fit(docs, labels, train_rows)
    return score(texts(docs), model).select("doc_id", (crc_rest("doc_id", 5) == 0).alias("held_out"), F.col("_score").alias("score"),
                                            (F.col("_score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with the columns of ``docs``."""
    model = fit(docs, labels)
    names = docs.columns
    texts(docs)
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return score(held, model).where(F.col("_score") < threshold).select(*[F.col(f"_row.`{c}`").alias(c) for c in names])
