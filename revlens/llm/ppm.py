"""Language-model scores by prediction by partial matching (PPM, escape method C).

The text is its token sequence: words (A-Z lower-cased), each written as its
bytes and a closing space, then one end symbol, all after one opening space.
With ``across`` a symbol is predicted from the ``ORDER`` bytes before it in its
document, across spaces, and the end symbol from the end of the last word;
without it only back to the opening space of its own word, and the end from one
space. The context trie holds the training counts of all orders.
Coding starts at the longest context seen in training; a symbol without a
count there costs an escape, q / (n + q) for n counts of q symbols, and the
next shorter context predicts without the symbols already excluded, down to
the uniform distribution over what no context has. The model is a proper
distribution over token sequences, trained before it is used (pretrained).

Everything that exclusion needs is a number of the node: since a shorter
context has every symbol of a longer one, the counts left at the shorter one
are its own less the sum over the longer one's symbols.

Scale: documents are dealt once into hash slices of about ``SLICE_BYTES``. A
slice counts its distinct words and byte grams and sends them once, packed in
one row for each hash bucket, so a hot word reaches the shuffle once a slice
and a gram costs 16 bytes there and 8 back. Grams are built in chunks of
``CHUNK`` symbols. Words and distinct grams are
summed by hash bucket; distinct grams are dealt again by their last two
context bytes, where each builds its part of the trie and is priced; counts
and prices go back to the slices that asked, which score their documents.
Orders 0 and 1, at most 65,536 counts, are the only part that is broadcast.

Defined cases: null text: only the end token; null id: crc32 remainder 0, so
held back from nothing; repeated documents: trained and scored row by row;
no training rows: the uniform model. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.llm import bytewords as bw
from revlens.llm.frames import crc_rest, slices, stored, text_bytes, texts

ORDER = 5
SLICE_BYTES = 12 << 20
CHUNK = 1 << 20
HELD_MOD, HELD_REST = 7, 2
SPACE, END = 0x20, 0xFF
U = np.uint64
_BASE2 = U(0xD1342543DE82EF95)
_MASK = np.array([(1 << 8 * (k + 1)) - 1 for k in range(ORDER + 1)], dtype=U)  # a symbol and k before it
_INV2 = U(pow(0xD1342543DE82EF95, -1, 1 << 64))


class Slice:
    """Distinct words and grams of the texts of one slice.

    ``text`` holds the sequences end to end: whole documents (``across``) or
    distinct words. A gram is a symbol and up to ``ORDER`` symbols before it in
    its sequence, with their number in the top byte. ``sums`` needs ``places``.
    """

    def __init__(self, column, train: np.ndarray, across: bool, places: bool = True):
        raw, starts, ends, h, per = bw.words(column, bw.NOT_SPACE)
        self.per = per
        self.document = np.repeat(np.arange(len(per), dtype=np.int32), per)
        self.key, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        self.inverse = inverse.astype(np.int32)
        s, e = starts[first], ends[first]
        del h, inverse  # a slice's token arrays are the largest part of a worker's memory
        self.train = np.bincount(self.inverse, weights=train[self.document], minlength=len(self.key)).astype(np.int64)
        self.key2 = _hash_any(raw, s, e)
        if across:
            self.text, self.at = _documents(raw, starts, ends, per)
            weight = train.astype(np.int64)
        else:
            self.text, self.at = _apart(raw, s, e)
            weight = self.train
        del raw, starts, ends
        self.text = np.concatenate([np.zeros(ORDER, dtype=np.uint8), self.text])
        self.place = np.full(len(self.text) - ORDER, ORDER, dtype=np.uint8)
        for k in range(ORDER - 1, -1, -1):
            at = self.at[:-1] + k
            self.place[at[at < self.at[1:]]] = k
        found, self.parts = [], []
        for gram, of in self.chunks():
            own, n, place = _summed(gram, weight[of], places)
            found.append((own, n))
            self.parts.append((own, place, of))
        del self.text, self.place
        self.gram, self.gram_train, _ = _summed(np.concatenate([np.zeros(0, dtype=U), *[g for g, _ in found]]),
                                                np.concatenate([np.zeros(0, dtype=np.int64), *[n for _, n in found]]))
        if not places:
            self.parts = []
        self.long = (self.gram >> U(56)) > U(1)

    def chunks(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(grams, their sequences) in order; where a sequence is cut does not depend on its neighbours."""
        cuts = [0]
        for start, end in zip(self.at[:-1].tolist(), self.at[1:].tolist()) if len(self.place) > CHUNK else ():
            if end - cuts[-1] > CHUNK and start > cuts[-1]:
                cuts.append(start)
            while end - cuts[-1] > CHUNK:
                cuts.append(cuts[-1] + CHUNK)
        cuts.append(len(self.place))
        for lo, hi in zip(cuts, cuts[1:]):
            place = self.place[lo:hi]
            gram = np.zeros(hi - lo, dtype=U)
            for back in range(ORDER, -1, -1):
                gram <<= U(8)
                gram |= self.text[ORDER + lo - back:ORDER + hi - back]
            gram &= _MASK[place]
            gram |= place.astype(U) << U(56)
            of = np.repeat(np.arange(len(self.at) - 1, dtype=np.int32), np.diff(np.clip(self.at, lo, hi)))
            keep = place > 0
            if keep.any():
                yield gram[keep], of[keep]

    def sums(self, prices: np.ndarray) -> np.ndarray:
        """Per sequence: the sum of the prices (one for each of ``gram``) of its grams."""
        out = np.zeros(len(self.at) - 1)
        for own, place, of in self.parts:
            out += np.bincount(of, weights=prices[np.searchsorted(self.gram, own)][place], minlength=len(out))
        return out


def _documents(raw, starts, ends, per) -> tuple[np.ndarray, np.ndarray]:
    """Per document: a space, then every word with a closing space, then the end symbol."""
    closed = np.concatenate([[0], np.cumsum(ends - starts + 1)])
    first = np.concatenate([[0], np.cumsum(per)])
    at = closed[first] + 2 * np.arange(len(per) + 1)
    text = np.full(at[-1], SPACE, dtype=np.uint8)
    text[at[1:] - 1] = END
    inner = np.ones(at[-1], dtype=bool)
    inner[at[:-1]] = inner[at[1:] - 1] = False
    inner[closed[1:] + 2 * np.repeat(np.arange(len(per)), per)] = False
    text[inner] = raw[bw.NOT_SPACE[raw]]
    return text, at


def _apart(raw, s, e) -> tuple[np.ndarray, np.ndarray]:
    """Per word: a space, the word and a closing space."""
    size = e - s + 2
    at = np.concatenate([[0], np.cumsum(size)])
    text = np.full(at[-1], SPACE, dtype=np.uint8)
    place = (np.arange(at[-1]) - np.repeat(at[:-1], size)).astype(np.int32)
    inner = (place > 0) & (place < np.repeat(size, size) - 1)
    text[inner] = raw[(np.repeat(s, size) + place - 1)[inner]]
    return text, at


def _summed(gram: np.ndarray, n: np.ndarray, places: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Distinct grams, sorted, the sum of ``n`` for each, and on request where each gram is among them."""
    if not len(gram):
        return gram, n, np.zeros(0, dtype=np.int32)
    order = np.argsort(gram)
    gram = gram[order]
    new = np.ones(len(gram), dtype=bool)
    new[1:] = gram[1:] != gram[:-1]
    at = np.flatnonzero(new)
    place = None
    if places:
        place = np.empty(len(gram), dtype=np.int32)
        place[order] = np.cumsum(new, dtype=np.int32) - 1
    return gram[at], np.add.reduceat(n[order], at), place


def _hash_any(raw, s, e) -> np.ndarray:
    """A second hash of spans that may stand in any order."""
    order = np.argsort(s)
    out = np.empty(len(s), dtype=np.int64)
    out[order] = (bw.hashes(raw, s[order], e[order], _BASE2, _INV2) >> U(32)).astype(np.int64)
    return out


def pairs_of(column, train: np.ndarray) -> np.ndarray:
    """256 x 256 counts of (byte before, symbol) of the training texts, with their ends."""
    raw, offsets = bw.buffer_of(column)
    raw = bw.LOWER[raw]
    out = np.zeros(65536, dtype=np.int64)
    out[SPACE * 256 + END] = int(train.sum())
    if len(raw):
        starts, ends, per = bw.spans(raw, offsets, bw.NOT_SPACE)
        keep = np.repeat(train, per)
        weight = np.zeros(len(raw) + 1, dtype=np.int8)
        np.add.at(weight, starts[keep], 1)
        np.add.at(weight, ends[keep], -1)
        inside = np.cumsum(weight[:-1]).astype(bool)
        before = np.empty_like(raw)
        before[1:] = raw[:-1]
        before[starts] = SPACE
        out += np.bincount(before[inside].astype(np.int64) * 256 + raw[inside], minlength=65536)
        out += np.bincount(raw[ends[keep] - 1].astype(np.int64) * 256 + SPACE, minlength=65536)
    return out


class Low:
    """Orders 1, 0 and -1: log10 prices after an escape from above, and for a start at order 1."""

    def __init__(self, pairs: np.ndarray):
        c1 = pairs.reshape(256, 256)
        c0 = c1.sum(axis=0)
        self.c1, self.n1, self.q1 = c1, c1.sum(axis=1), (c1 > 0).sum(axis=1)
        n0, q0 = int(c0.sum()), int((c0 > 0).sum())
        with np.errstate(divide="ignore", invalid="ignore"):
            unseen = -np.log10(max(1, 256 - q0))
            direct = np.log10(c0 / max(1, n0 + q0))
            self.zero = np.where(c0 > 0, direct, np.log10(q0 / (n0 + q0)) + unseen) if n0 else np.full(256, -np.log10(256))
            left = n0 - ((c1 > 0) * c0).sum(axis=1) + q0 - self.q1  # order 0 without the symbols of an order 1 context
            escape = np.where(q0 > self.q1, np.log10((q0 - self.q1) / left), 0.0)
            # given an escape from order 1
            self.below = np.where(c0[None, :] > 0, np.log10(c0[None, :] / left[:, None]), escape[:, None] + unseen)
            first = np.where(c1 > 0, np.log10(c1 / (self.n1 + self.q1)[:, None]), np.log10(self.q1 / (self.n1 + self.q1))[:, None] + self.below)
        self.start = np.where((self.n1 > 0)[:, None], first, self.zero[None, :])


def price(gram: np.ndarray, count: np.ndarray, low: Low) -> np.ndarray:
    """log10 probabilities of distinct grams (contexts of two bytes or more) given their counts.

    All grams with the same last two context bytes must be present.
    """
    order = (gram >> U(56)).astype(np.int64)
    symbol = (gram & U(255)).astype(np.int64)
    last = ((gram >> U(8)) & U(255)).astype(np.int64)
    logp = np.zeros(len(gram))
    done = np.zeros(len(gram), dtype=bool)
    above_n = np.zeros(len(gram))      # for the context above, per gram: counts and symbols left here
    above_q = np.zeros(len(gram))
    came = np.zeros(len(gram), dtype=bool)
    upper = None
    for k in range(ORDER, 1, -1):
        has = order >= k
        code = gram & U((1 << (8 * (k + 1))) - 1)
        edge, where = np.unique(code[has], return_inverse=True)
        c = np.bincount(where, weights=count[has], minlength=len(edge))
        node, of = np.unique(edge >> U(8), return_inverse=True)
        n = np.bincount(of, weights=c, minlength=len(node))
        q = np.bincount(of, weights=c > 0, minlength=len(node))
        cg = np.zeros(len(gram))
        ng, qg = np.zeros(len(gram)), np.zeros(len(gram))
        cg[has], ng[has], qg[has] = c[where], n[of[where]], q[of[where]]
        if upper is not None:  # what the contexts above leave of this order
            up_has, up_where, up_seen, up_of, up_nodes = upper
            own = np.zeros(up_seen.size)
            own[up_where] = cg[up_has]
            excluded = np.bincount(up_of, weights=own * up_seen, minlength=up_nodes)
            symbols = np.bincount(up_of, weights=up_seen, minlength=up_nodes)
            above_n[up_has] = ng[up_has] - excluded[up_of[up_where]]
            above_q[up_has] = qg[up_has] - symbols[up_of[up_where]]
        _step(logp, done, came, has & (ng > 0), cg, ng, qg, above_n, above_q)
        upper = (np.flatnonzero(has), where, c > 0, of, len(node))
    # order 1 and below, from the table
    up_has, up_where, up_seen, up_of, up_nodes = upper
    c1, n1, q1 = low.c1[last, symbol].astype(float), low.n1[last].astype(float), low.q1[last].astype(float)
    own = np.zeros(up_seen.size)
    own[up_where] = c1[up_has]
    above_n[up_has] = n1[up_has] - np.bincount(up_of, weights=own * up_seen, minlength=up_nodes)[up_of[up_where]]
    above_q[up_has] = q1[up_has] - np.bincount(up_of, weights=up_seen, minlength=up_nodes)[up_of[up_where]]
    had = n1 > 0
    _step(logp, done, came, had, c1, n1, q1, above_n, above_q)
    return logp + np.where(done, 0.0, np.where(had, low.below[last, symbol], low.zero[symbol]))


def _step(logp, done, came, here, c, n, q, above_n, above_q) -> None:
    """One order: symbols with a count are priced, the others escape."""
    act = here & ~done
    total = np.where(came, above_n + above_q, n + q)
    esc = np.where(came, above_q, q)
    hit = act & (c > 0)
    miss = act & ~hit & (esc > 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        logp[hit] += np.log10(c[hit] / total[hit])
        logp[miss] += np.log10(esc[miss] / total[miss])
    done |= hit
    came |= here


#: words: hashes, then second hashes (32 bits) with the count in the slice; grams: grams, then counts. All are int64, in the
#: slice's order of them
ROW = pa.schema([("bucket", pa.int32()), ("slice", pa.int32()), ("words", pa.binary()), ("grams", pa.binary())])
#: in the order asked: words: training counts (int64); grams: prices (float64). homes: words that this slice counts as one
#: of the distinct training words
BACK = pa.schema([("slice", pa.int32()), ("bucket", pa.int32()), ("words", pa.binary()), ("grams", pa.binary()), ("homes", pa.int64())])
LOW32 = (1 << 32) - 1


def _bucket(k: np.ndarray, buckets: int) -> np.ndarray:
    return (bw.mix(k ^ U(0x5851F42D4C957F2D)) % U(buckets)).astype(np.int32)


def _dealt(k: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(places of the keys bucket by bucket, where each bucket begins)."""
    bucket = _bucket(k, buckets)
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


def _unpacked(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed pairs of int64 columns: both end to end, and the number in each row."""
    rows = [np.frombuffer(b, dtype=np.int64).reshape(2, -1) for b in column.to_pylist()]
    both = np.concatenate([np.zeros((2, 0), dtype=np.int64), *rows], axis=1)
    return both[0], both[1], np.array([r.shape[1] for r in rows], dtype=np.int64)


def _packed(values: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    return [x.tobytes() for x in np.split(values, np.cumsum(sizes)[:-1])] if len(sizes) else []


def _ddl(schema: pa.Schema) -> str:
    kind = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary"}
    return ", ".join(f"{f.name} {kind[f.type]}" for f in schema)


def first_orders(d: DataFrame) -> np.ndarray:
    """Training counts of (byte before, symbol): at most 65,536 numbers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(65536, dtype=np.int64)
        for batch in batches:
            total += pairs_of(batch.column("text"), batch.column("train").to_numpy(zero_copy_only=False).astype(bool))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["at", "n"])
    out = np.zeros(65536, dtype=np.int64)
    for r in d.select("text", "train").mapInArrow(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        out[r["at"]] = r["n"]
    return out


def score(docs: DataFrame, slice_bytes: int = SLICE_BYTES, mod: int = HELD_MOD, rest: int = HELD_REST, across: bool = False) -> DataFrame:
    """Per document: held_out, n_tokens, n_known, train_tokens, base_score, score (log10).

    ``across``: contexts reach across spaces to the document's start, else to the start of the word.
    """
    held = crc_rest("doc_id", mod) == rest
    d = texts(docs).select("doc_id", "text", (~held).alias("train"))
    n = slices(text_bytes(d), slice_bytes)
    buckets = max(2 * n, int(d.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    low = Low(first_orders(d))
    d = d.withColumn("slice", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int"))
    kind = dict(d.dtypes)["doc_id"]

    def part(table: pa.Table, places: bool) -> Slice:
        return Slice(table.column("text"), table.column("train").to_numpy().astype(bool), across, places)

    def ask(table: pa.Table) -> pa.Table:
        s = part(table, False)
        packs = []
        for k, n in ((s.key, s.key2 << 32 | s.train), (s.gram[s.long], s.gram_train[s.long])):
            order, cut = _dealt(k, buckets)
            k, n = k[order].view(np.int64), n[order]
            packs.append([k[a:b].tobytes() + n[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])])
        rows = [b for b in range(buckets) if packs[0][b] or packs[1][b]]
        return pa.table([pa.array(rows, pa.int32()), pa.array(np.full(len(rows), table.column("slice")[0].as_py(), np.int32)),
                         *[pa.array([p[b] for b in rows], pa.binary()) for p in packs]], schema=ROW)

    def distinct(table: pa.Table) -> pa.Table:
        k, n, _ = _unpacked(table.column("grams"))
        g, where = np.unique(k.view(U), return_inverse=True)
        total = np.bincount(where, weights=n, minlength=len(g)).astype(np.int64)
        return pa.table({"route": pa.array(((g >> U(8)) & U(0xFFFF)).astype(np.int32)), "k1": pa.array(g.view(np.int64)), "n": pa.array(total)})

    def priced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(b.column("k1").to_numpy(), b.column("n").to_numpy()) for b in batches if b.num_rows]
        if got:
            g = np.concatenate([k for k, _ in got]).view(U)
            v = price(g, np.concatenate([c for _, c in got]).astype(float), low)
            for k in range(0, len(g), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(_bucket(g[k:k + 100_000], buckets)), pa.array(g[k:k + 100_000].view(np.int64)), pa.array(v[k:k + 100_000])],
                                                 names=["bucket", "k1", "v"])

    def answer(asked: pa.Table, prices: pa.Table) -> pa.Table:
        k1, kn, sizes = _unpacked(asked.column("words"))
        k2, c = (kn >> 32) & LOW32, kn & LOW32
        counts, home = np.zeros(len(k1), dtype=np.int64), np.zeros(len(k1), dtype=np.int64)
        order = np.lexsort((k2, k1))
        if len(order):
            new = np.ones(len(order), dtype=bool)
            new[1:] = (k1[order][1:] != k1[order][:-1]) | (k2[order][1:] != k2[order][:-1])
            of = np.cumsum(new) - 1
            total = np.bincount(of, weights=c[order]).astype(np.int64)
            counts[order] = total[of]
            home[order[new]] = total > 0
        homes = np.diff(np.concatenate([[0], np.cumsum(home)])[np.concatenate([[0], np.cumsum(sizes)])])
        gram, _, gram_sizes = _unpacked(asked.column("grams"))
        v = np.zeros(len(gram))
        if len(gram):
            at = np.argsort(prices.column("k1").to_numpy())
            own = prices.column("k1").to_numpy()[at]
            v = prices.column("v").to_numpy()[at][np.searchsorted(own, gram)]
        return pa.table([asked.column("slice"), asked.column("bucket"), pa.array(_packed(counts, sizes), pa.binary()),
                         pa.array(_packed(v, gram_sizes), pa.binary()), pa.array(homes, pa.int64())], schema=BACK)

    def total(documents: pa.Table, back: pa.Table) -> pa.Table:
        s = part(documents, True)
        counts = np.zeros(len(s.key), dtype=np.int64)
        prices = low.start[SPACE, (s.gram & U(255)).astype(np.int64)]  # order 1: only the opening space
        long = np.flatnonzero(s.long)
        (words, word_cut), (grams, gram_cut) = _dealt(s.key, buckets), _dealt(s.gram[long], buckets)
        for b, w, g in zip(*(back.column(x).to_pylist() for x in ("bucket", "words", "grams"))):
            counts[words[word_cut[b]:word_cut[b + 1]]] = np.frombuffer(w, dtype=np.int64)
            prices[long[grams[gram_cut[b]:gram_cut[b + 1]]]] = np.frombuffer(g, dtype=np.float64)
        sequence = s.sums(prices)
        docs_n = documents.num_rows
        sums = [np.bincount(s.document, weights=x[s.inverse], minlength=docs_n) for x in (np.log10(counts + 1), counts > 0)]
        scores = sequence if across else np.bincount(s.document, weights=sequence[s.inverse], minlength=docs_n) + low.start[SPACE, END]
        ends = int(low.c1[SPACE, END])
        homes = np.zeros(docs_n, dtype=np.int64)
        if docs_n:
            homes[0] = back.column("homes").to_numpy().sum()
        return pa.table([documents.column("doc_id"), pa.array(~documents.column("train").to_numpy().astype(bool)), pa.array(s.per + 1),
                         pa.array(sums[1].astype(np.int64) + (ends > 0)), pa.array(sums[0] + np.log10(ends + 1)), pa.array(scores), pa.array(homes)],
                        names=["doc_id", "held_out", "n_tokens", "n_known", "log_counts", "score", "homes"])

    asked = d.groupBy("slice").applyInArrow(ask, _ddl(ROW))
    grams = asked.groupBy("bucket").applyInArrow(distinct, "route int, k1 long, n long")
    prices = grams.repartition("route").mapInArrow(priced, "bucket int, k1 long, v double")
    back = asked.groupBy("bucket").cogroup(prices.groupBy("bucket")).applyInArrow(answer, _ddl(BACK))
    scored = stored(d.groupBy("slice").cogroup(back.groupBy("slice")).applyInArrow(
        total, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, log_counts double, score double, homes long"))
    size = scored.agg(F.coalesce(F.sum(F.when(~F.col("held_out"), F.col("n_tokens"))), F.lit(0)).alias("t"),
                      (F.coalesce(F.sum("homes"), F.lit(0)) + F.coalesce(F.max((~F.col("held_out")).cast("int")), F.lit(0))).alias("v")).first()
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(size["t"]).cast("long").alias("train_tokens"),
                         (F.col("log_counts") - F.col("n_tokens") * F.log10(F.lit(float(size["t"] + size["v"] + 1)))).alias("base_score"), "score")
