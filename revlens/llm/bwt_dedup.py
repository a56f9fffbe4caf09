"""Removal of long byte strings that occurred before, by interval expansion on a BWT.

A byte is removed if a ``LENGTH``-byte string that covers it also starts
earlier: in a document with a smaller id, or earlier in the same one.

Method. For a set of byte texts, the Burrows-Wheeler transform is built, and
intervals of rows that share a prefix are expanded breadth first: backward
extension of all intervals of prefix length l by every preceding byte gives
the intervals of length l + 1, and each new right end settles one common
prefix value, so values come in increasing order. The search stops at
``LENGTH``; rows with no settled value between them share that many bytes.

Distribution. Equal strings have equal keys (see ``segments``), so only
segments under a repeated key matter, and keys are independent of each other.

1. Each hash slice of the documents sends its distinct (key, content hash)
   pairs; a key that occurs once in the corpus ends here.
2. Slices send their first segment of each repeated (key, content); texts only
   where a key has several contents. Equal contents collapse: all but the
   first are repeats as a whole. The texts of a bucket of keys go through the
   transform, which finds the strings that different contents share.
3. Repeated starts go back to the slices, which cut their documents.

A key with more than ``HOT`` contents (a frequent line before ever different
text) is split: its segments are dealt again by each single string. A slice
reports such a key with one row, so the shuffle gets few rows of a hot key.

Defined cases: null text: empty; texts under LENGTH bytes keep all bytes; null
ids come last; rows with the same id count in order of their text's hash, as
different documents; repeated rows: the second is a repeat of the first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from collections.abc import Iterator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.llm import bytewords as bw
from revlens.llm import segments as sg
from revlens.llm.frames import slices, text_bytes, texts

LENGTH = 100
SLICE_BYTES = 8 << 20
HOT = 50_000
HOT_IN_SLICE = 64
U = np.uint64


def transform(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(row order, LF mapping) of the rotations of ``text``, sorted by at least ``depth`` symbols.

    ``text`` has symbols below 512; ranks of 7 symbols are doubled until deep enough.
    """
    n = len(text)
    key = np.zeros(n, dtype=np.int64)
    for k in range(7):
        key = (key << 9) | np.roll(text, -k)
    _, rank = np.unique(key, return_inverse=True)
    have = 7
    while have < depth:
        if rank.max() == n - 1:
            break
        _, rank = np.unique(rank * n + np.roll(rank, -have), return_inverse=True)
        have *= 2
    order = np.argsort(rank, kind="stable")
    row = np.empty(n, dtype=np.int64)
    row[order] = np.arange(n)
    # rows of equal rank must keep the order of their next rotation's rows for the mapping to be monotone in a byte
    before = text[order - 1]
    lf = np.empty(n, dtype=np.int64)
    lf[np.argsort(before, kind="stable")] = np.arange(n)
    return order, lf


def shared_prefixes(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(row order, class of each row): rows of a class share their first ``length`` symbols."""
    n = len(text)
    order, lf = transform(text, length + 8)
    before = text[order - 1]
    by_byte = np.argsort(before, kind="stable")
    nxt, prv = np.full(n, n, dtype=np.int64), np.full(n, -1, dtype=np.int64)
    same = before[by_byte[1:]] == before[by_byte[:-1]]
    nxt[by_byte[:-1][same]] = by_byte[1:][same]
    prv[by_byte[1:][same]] = by_byte[:-1][same]
    settled = np.zeros(n + 1, dtype=bool)
    settled[n] = True
    lo, hi = np.array([0]), np.array([n])
    for _ in range(length):
        size = hi - lo
        which = np.repeat(np.arange(len(lo)), size)
        rows = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo, size)
        last = nxt[rows] >= hi[which]       # the last row with its byte in its interval
        head = prv[rows] < lo[which]        # the first one
        a, b = rows[head], rows[last]
        # the same bytes head and end in each interval: pair them up
        a = a[np.lexsort((before[a], which[head]))]
        b = b[np.lexsort((before[b], which[last]))]
        lo, hi = lf[a], lf[b] + 1
        new = ~settled[hi]
        lo, hi = lo[new], hi[new]
        if not len(hi):
            break
        settled[hi] = True
    border = settled[:n].copy()
    border[0] = True
    return order, np.cumsum(border) - 1


def repeated_starts(parts: list[np.ndarray], runs: np.ndarray, place: np.ndarray, length: int) -> list[np.ndarray]:
    """For each text of ``parts``: which of its first ``runs`` strings occurs at an earlier place.

    ``place``: the place of each text's first byte in one order over all documents.
    """
    size = np.array([len(p) for p in parts])
    base = np.cumsum(size + 1) - size - 1
    text = np.full(int((size + 1).sum()), 256, dtype=np.int64)
    inner = np.ones(len(text), dtype=bool)
    inner[base + size] = False
    text[inner] = np.concatenate(parts)
    order, group = shared_prefixes(text, length)
    of = np.empty(len(text), dtype=np.int64)
    of[order] = group
    # only strings that lie inside one text count
    which = np.repeat(np.arange(len(parts)), runs)
    offset = np.arange(int(runs.sum())) - np.repeat(np.cumsum(runs) - runs, runs)
    mine, at = of[base[which] + offset], place[which] + offset
    least = np.full(int(group[-1]) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, mine, at)
    return np.split(at > least[mine], np.cumsum(runs)[:-1])


class Table:
    """A slice's documents in id order, with their segments."""

    def __init__(self, table: pa.Table, length: int):
        ids = table.column("doc_id").to_pylist()
        tie = table.column("tie").to_numpy()
        null = np.array([i is None for i in ids], dtype=bool)
        self.ids = np.array([0 if i is None else i for i in ids], dtype=np.int64)
        order = np.lexsort((tie, self.ids, null))
        self.null, self.ids, self.tie = null[order], self.ids[order], tie[order]
        self.table = table.take(pa.array(order))
        self.slice = table.column("slice")[0].as_py()
        self.raw, self.offsets = bw.buffer_of(self.table.column("text"))
        self.length = length

    def segments(self):
        found = list(sg.segments(self.raw, self.offsets, self.length))
        if not found:
            z = np.zeros(0, dtype=np.int64)
            return z, z, z, z.astype(U), z.astype(U)
        return tuple(np.concatenate(c) for c in zip(*found))


PAIR = pa.schema([("key", pa.int64()), ("content", pa.int64()), ("at", pa.int64())])
MODE = pa.schema([("slice", pa.int32()), ("key", pa.int64()), ("mode", pa.int32())])
PIECE = pa.schema([("bucket", pa.int32()), ("slice", pa.int32()), ("key", pa.int64()), ("content", pa.int64()), ("null_id", pa.bool_()), ("id", pa.int64()),
                   ("tie", pa.int64()), ("row", pa.int32()), ("start", pa.int64()), ("run", pa.int32()), ("text", pa.binary())])
FOUND = pa.schema([("slice", pa.int32()), ("row", pa.int32()), ("start", pa.int64()), ("run", pa.int32()), ("bits", pa.binary())])
ONE_CONTENT, MANY, SPLIT = 1, 2, 3


def _ddl(schema: pa.Schema) -> str:
    kind = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary", pa.bool_(): "boolean"}
    return ", ".join(f"{f.name} {kind[f.type]}" for f in schema)


def _report(table: pa.Table, length: int) -> pa.Table:
    """Distinct (key, content) of a slice; at = 4 * slice + 2 * (a split key) + (occurs again in the slice)."""
    t = Table(table, length)
    _, _, _, key, content = t.segments()
    order = np.lexsort((content, key))
    k, c = key[order], content[order]
    new_key = np.ones(len(k), dtype=bool)
    new_key[1:] = k[1:] != k[:-1]
    new = new_key.copy()
    new[1:] |= c[1:] != c[:-1]
    count = np.diff(np.append(np.flatnonzero(new), len(k)))
    k, c, new_key = k[new], c[new], new_key[new]
    of = np.cumsum(new_key) - 1
    hot = np.bincount(of, minlength=1)[of] > HOT_IN_SLICE if len(k) else new_key
    keep = ~hot | new_key
    at = t.slice * 4 + 2 * hot + (count > 1)
    return pa.table([k[keep].view(np.int64), c[keep].view(np.int64), at[keep]], schema=PAIR)


def _modes(hot: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        key, content, at = (np.concatenate([b.column(i).to_numpy() for b in got]) for i in range(3))
        order = np.lexsort((content, key))
        key, content, at = key[order], content[order], at[order]
        new_key = np.ones(len(key), dtype=bool)
        new_key[1:] = key[1:] != key[:-1]
        new = new_key.copy()
        new[1:] |= content[1:] != content[:-1]
        of = np.cumsum(new_key) - 1
        rows, contents = np.bincount(of), np.bincount(of, weights=new)
        again, split = np.bincount(of, weights=at & 1), np.bincount(of, weights=at & 2)
        mode = np.where((split > 0) | (contents > hot), SPLIT, np.where(contents > 1, MANY, np.where((rows > 1) | (again > 0), ONE_CONTENT, 0)))[of]
        use = mode > 0
        key, at, mode = key[use], at[use] >> 2, mode[use]
        order = np.lexsort((at, key))
        key, at, mode = key[order], at[order], mode[order]
        one = np.ones(len(key), dtype=bool)
        one[1:] = (key[1:] != key[:-1]) | (at[1:] != at[:-1])
        for lo in range(0, int(one.sum()), 200_000):
            cut = np.flatnonzero(one)[lo:lo + 200_000]
            yield pa.RecordBatch.from_arrays([pa.array(at[cut].astype(np.int32)), pa.array(key[cut]), pa.array(mode[cut].astype(np.int32))], schema=MODE)
    return run


def _pieces(table: pa.Table, modes: pa.Table, length: int, buckets: int) -> pa.Table:
    """The first segment of each repeated (key, content) of a slice; later ones as finished rows (null key)."""
    if not table.num_rows or not modes.num_rows:
        return PIECE.empty_table()
    t = Table(table, length)
    row, start, run, key, content = t.segments()
    known = modes.column("key").to_numpy().view(U)
    by = np.argsort(known)
    known, mode = known[by], modes.column("mode").to_numpy()[by]
    at = np.minimum(np.searchsorted(known, key), len(known) - 1)
    use = known[at] == key
    row, start, run, key, content, mode = row[use], start[use], run[use], key[use], content[use], mode[at[use]]
    split = np.flatnonzero(mode == SPLIT)
    if len(split):  # one string, one segment: key and content are its hash
        n = run[split]
        r = np.repeat(row[split], n)
        s = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[split], n)
        h = _string_hashes(t.raw, t.offsets[r] + s, length)
        stay = mode != SPLIT
        row, start, run, key, content, mode = (np.concatenate([x[stay], y]) for x, y in (
            (row, r), (start, s), (run, np.ones(len(r), dtype=run.dtype)), (key, h), (content, bw.mix(h)), (mode, np.full(len(r), ONE_CONTENT))))
    order = np.lexsort((start, row, content, key))
    first = np.ones(len(order), dtype=bool)
    first[1:] = (key[order][1:] != key[order][:-1]) | (content[order][1:] != content[order][:-1])
    lead, rest = order[first], order[~first]
    text = [t.raw[a:a + n].tobytes() if m == MANY else None
            for a, n, m in zip((t.offsets[row[lead]] + start[lead]).tolist(), (run[lead] + length - 1).tolist(), mode[lead].tolist())]
    both = np.concatenate([lead, rest])
    done = np.repeat([False, True], [len(lead), len(rest)])
    return pa.table([pa.array(np.where(done, row[both] % buckets, (bw.mix(key[both]) % U(buckets)).astype(np.int64)).astype(np.int32)), pa.array(np.full(len(both), t.slice, np.int32)),
                     pa.array(key[both].view(np.int64), mask=done), pa.array(content[both].view(np.int64)), pa.array(t.null[row[both]]), pa.array(t.ids[row[both]]),
                     pa.array(t.tie[row[both]]), pa.array(row[both].astype(np.int32)), pa.array(start[both]), pa.array(run[both].astype(np.int32)),
                     pa.array(text + [None] * len(rest), pa.binary())], schema=PIECE)


def _string_hashes(raw: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the ``length`` bytes at each place."""
    out = np.empty(len(at), dtype=U)
    for k in range(0, len(at), 4096):
        part = raw[at[k:k + 4096, None] + np.arange(length)[None, :]].astype(U) + U(1)
        out[k:k + 4096] = (part * bw._power(bw.BASE, length)[None, :length]).sum(axis=1, dtype=U)
    return bw.mix(out)


def _expand(table: pa.Table, length: int) -> pa.Table:
    """Repeated starts of the segments of a bucket of keys."""
    key = table.column("key")
    done = table.filter(pa.compute.is_null(key))
    t = table.filter(pa.compute.is_valid(key))
    out = [pa.table([done.column("slice"), done.column("row"), done.column("start"), done.column("run"), pa.nulls(done.num_rows, pa.binary())], schema=FOUND)]
    if t.num_rows:
        null, ids, tie, part, row, start, run, key, content = (t.column(c).to_numpy() for c in ("null_id", "id", "tie", "slice", "row", "start", "run", "key", "content"))
        order = np.lexsort((start, row, part, tie, ids, null, content, key))
        first = np.ones(len(order), dtype=bool)
        first[1:] = (key[order][1:] != key[order][:-1]) | (content[order][1:] != content[order][:-1])
        rest = pa.array(np.sort(order[~first]))
        later = t.take(rest)
        out.append(pa.table([later.column("slice"), later.column("row"), later.column("start"), later.column("run"), pa.nulls(len(rest), pa.binary())], schema=FOUND))
        lead = order[first]
        texts_ = t.column("text").take(pa.array(lead))
        lead = lead[texts_.is_valid().to_numpy()]
        if len(lead):
            parts = [np.frombuffer(x, np.uint8) for x in texts_.drop_null().to_pylist()]
            # one order of all places: documents by id, then bytes
            by = np.lexsort((row[lead], part[lead], tie[lead], ids[lead], null[lead]))
            name = np.stack([x[lead][by].astype(np.int64) for x in (null, ids, tie, part, row)])
            new = np.ones(len(by), dtype=bool)
            new[1:] = (name[:, 1:] != name[:, :-1]).any(axis=0)
            rank = np.empty(len(by), dtype=np.int64)
            rank[by] = np.cumsum(new) - 1
            hits = repeated_starts(parts, run[lead].astype(np.int64), (rank << 36) + start[lead], length)
            some = [k for k, h in enumerate(hits) if h.any()]
            hit = lead[some]
            out.append(pa.table([pa.array(part[hit]), pa.array(row[hit]), pa.array(start[hit]), pa.array(run[hit]),
                                 pa.array([np.packbits(hits[k]).tobytes() for k in some], pa.binary())], schema=FOUND))
    return pa.concat_tables(out)


def _cut(table: pa.Table, found: pa.Table, length: int) -> pa.Table:
    """Each document's kept bytes and removed spans."""
    t = Table(table, length)
    n = len(t.raw)
    change = np.zeros(n + 1, dtype=np.int32)
    row, start, run = (found.column(c).to_numpy().astype(np.int64) for c in ("row", "start", "run"))
    whole = found.column("bits").is_null().to_numpy() if found.num_rows else np.zeros(0, dtype=bool)
    base = t.offsets[row] + start if len(row) else row
    np.add.at(change, base[whole], 1)
    np.add.at(change, (base + run + length - 1)[whole], -1)
    for k, bits in zip(np.flatnonzero(~whole).tolist(), found.column("bits").drop_null().to_pylist()):
        hit = np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8), count=int(run[k])))
        np.add.at(change, base[k] + hit, 1)
        np.add.at(change, base[k] + hit + length, -1)
    gone = np.cumsum(change[:-1]) > 0
    kept, spans = [], []
    for a, b in zip(t.offsets[:-1].tolist(), t.offsets[1:].tolist()):
        g = gone[a:b]
        if g.any():
            edge = np.flatnonzero(np.diff(np.concatenate([[False], g, [False]]).astype(np.int8))).tolist()
            spans.append([{"start": x, "end": y} for x, y in zip(edge[::2], edge[1::2])])
            kept.append(t.raw[a:b][~g].tobytes())
        else:
            spans.append([])
            kept.append(t.raw[a:b].tobytes())
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return pa.table([t.table.column("doc_id"), pa.array(np.diff(t.offsets), pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())],
                    names=["doc_id", "n_bytes", "spans", "kept"])


def remove_repeats(docs: DataFrame, length: int = LENGTH, slice_bytes: int = SLICE_BYTES, hot: int = HOT) -> DataFrame:
    """Per document: doc_id, n_bytes, spans (removed byte ranges), kept (remaining bytes)."""
    d = texts(docs)
    n = slices(text_bytes(d), slice_bytes)
    buckets = 2 * n
    d = d.select("doc_id", "text", F.xxhash64("text").alias("tie")).withColumn("slice", F.pmod(F.xxhash64("doc_id", "tie"), F.lit(n)).cast("int"))
    kind = dict(d.dtypes)["doc_id"]
    # every step deals the documents the same way, so they are shuffled once
    pairs = d.groupBy("slice").applyInArrow(lambda t: _report(t, length), _ddl(PAIR))
    modes = pairs.repartition("key").mapInArrow(_modes(hot), _ddl(MODE))
    pieces = d.groupBy("slice").cogroup(modes.groupBy("slice")).applyInArrow(lambda t, m: _pieces(t, m, length, buckets), _ddl(PIECE))
    found = pieces.groupBy("bucket").applyInArrow(lambda t: _expand(t, length), _ddl(FOUND))
    return d.groupBy("slice").cogroup(found.groupBy("slice")).applyInArrow(
        lambda t, f: _cut(t, f, length), f"doc_id {kind}, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")


def report(docs: DataFrame, length: int = LENGTH, slice_bytes: int = SLICE_BYTES, hot: int = HOT) -> DataFrame:
    """Per document: n_bytes, n_removed, n_spans, kept_sha256."""
    out = remove_repeats(docs, length, slice_bytes, hot)
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"))
