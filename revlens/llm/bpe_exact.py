"""Exact merge-type SentencePiece encoding by backtracking, and decoding.

A sequence of pieces is the merge result of its text exactly when every two
adjacent pieces are the merge result of their joint text. So a pre-token is
encoded left to right: Aho-Corasick gives the longest piece that starts at
each position; a piece is taken if it is compatible with the one before
(checked by re-merging the pair's characters, kept per pair) and its end is
not known to fail; else its longest prefix that is a piece is tried; when none
is left, the position is marked as failed in a bitfield and the previous
piece is shortened. Characters outside the vocabulary become byte pieces and
separate what is around them. Runs of two or more space marks have pieces of
equal score, for which pair checks do not decide; such a run is merged by the
plain rule (best score, then leftmost).

Scale: ``mapInArrow`` over documents, no shuffle. A worker keeps encodings of
distinct pre-tokens in a cache of bounded size.

Defined cases: null and empty texts have no ids and decode to the empty text;
null ids decode to null in ``decode``; repeated documents: row by row.
"""

from __future__ import annotations

import hashlib
import heapq
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.llm import pieces as pc
from revlens.llm.frames import resident, texts, tidy

#: memory that a worker may take for encodings it has seen; it changes no result
CACHE_BYTES = 256 << 20
#: the same where other operators' workers share the executor, as in a pipeline
SHARED_CACHE_BYTES = 64 << 20


class Encoder:
    def __init__(self, model: bytes, cache_bytes: int = CACHE_BYTES):
        import ahocorasick
        self.v = pc.vocabulary(model)
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.v.ids.items():
            if len(piece) > 1:  # single characters are looked up
                self.automaton.add_word(piece, (i, len(piece) - 1))
        self.automaton.make_automaton()
        self.known = frozenset(p for p in self.v.ids if len(p) == 1)
        self.size = [len(p) for p in self.v.pieces]
        self.pairs: dict[int, bool] = {}
        self.shorter: dict[int, int] = {}
        self.words = pc.Cache(self._pretoken, cache_bytes // 160, cache_bytes)
        self.most_pairs = cache_bytes // 256  # compatibility answers, about 100 bytes each

    def merge(self, text: str) -> list[int]:
        """The plain rule: join the neighbours whose piece scores best, leftmost first."""
        ids, scores = self.v.ids, self.v.scores
        if len(text) <= 24:
            return self._merge_short(text)
        part: list[str | None] = list(text)
        after, before = list(range(1, len(part) + 1)), list(range(-1, len(part) - 1))
        heap: list = []

        def offer(a: int) -> None:
            b = after[a]
            if b < len(part):
                i = ids.get(part[a] + part[b])
                if i is not None:
                    heapq.heappush(heap, (-scores[i], a, b, self.v.pieces[i]))
        for a in range(len(part) - 1):
            offer(a)
        while heap:
            _, a, b, piece = heapq.heappop(heap)
            if part[a] is None or b >= len(part) or part[b] is None or after[a] != b or part[a] + part[b] != piece:
                continue
            part[a], part[b] = piece, None
            after[a] = after[b]
            if after[b] < len(part):
                before[after[b]] = a
            offer(a)
            if before[a] >= 0:
                offer(before[a])
        out: list[int] = []
        for p in part:
            if p is not None:
                out += [ids[p]] if p in ids else [self.v.bytes_[x] for x in p.encode("utf-8")]
        return out

    def _merge_short(self, text: str) -> list[int]:
        ids, scores = self.v.ids, self.v.scores
        none = float("-inf")
        part = list(text)
        joined = [ids.get(a + b, -1) for a, b in zip(part, part[1:])]
        gain = [scores[i] if i >= 0 else none for i in joined]
        while gain:
            best = max(gain)
            if best == none:
                break
            k = gain.index(best)
            part[k:k + 2] = [self.v.pieces[joined[k]]]
            del gain[k], joined[k]
            for j in (k - 1, k):
                if 0 <= j < len(gain):
                    joined[j] = i = ids.get(part[j] + part[j + 1], -1)
                    gain[j] = scores[i] if i >= 0 else none
        out: list[int] = []
        for p in part:
            out += [ids[p]] if p in ids else [self.v.bytes_[x] for x in p.encode("utf-8")]
        return out

    def compatible(self, a: int, b: int) -> bool:
        if len(self.pairs) >= self.most_pairs:  # bounded memory
            self.pairs.clear()
        ok = self.pairs[a << 32 | b] = self.merge(self.v.pieces[a] + self.v.pieces[b]) == [a, b]
        return ok

    def prefix(self, i: int) -> int:
        """The longest piece that begins piece ``i`` and is shorter; -1: none."""
        s = self.shorter.get(i)
        if s is None:
            p = self.v.pieces[i]
            s = self.shorter[i] = next((self.v.ids[p[:k]] for k in range(len(p) - 1, 0, -1) if p[:k] in self.v.ids), -1)
        return s

    def fragment(self, text: str) -> list[int]:
        """Ids of a text whose characters are all pieces, without runs of space marks."""
        n = len(text)
        longest = list(map(self.v.ids.__getitem__, text))
        for end, (i, k) in self.automaton.iter(text):
            longest[end - k] = i  # a later end is a longer piece
        size, pairs, compatible = self.size, self.pairs, self.compatible
        open_ = bytearray(b"\1") * (n + 1)
        out: list[int] = []
        pos = 0
        nxt = longest[0]
        while True:
            last = out[-1] if out else -1
            while True:
                end = pos + size[nxt]
                if open_[end] and (last < 0 or (pairs.get(last << 32 | nxt) if last << 32 | nxt in pairs else compatible(last, nxt))):
                    out.append(nxt)
                    pos = end
                    if pos == n:
                        return out
                    nxt = longest[pos]
                    break
                nxt = self.prefix(nxt)
                if nxt < 0:
                    open_[pos] = 0
                    if not out:
                        raise AssertionError("every text has an encoding")
                    nxt = out.pop()
                    pos -= size[nxt]
                    break

    def _pretoken(self, word: str) -> bytes:
        return array("i", self.encode_marked(pc.marked(word))).tobytes()

    def encode_marked(self, text: str) -> list[int]:
        if text.startswith(pc.MARK * 2):
            return self.merge(text)
        if self.known.issuperset(text):
            return self.fragment(text)
        ids, out, start = self.v.ids, [], 0
        for k, c in enumerate(text):
            if c not in ids:  # byte pieces; nothing merges across them
                if k > start:
                    out += self.fragment(text[start:k])
                out += [self.v.bytes_[x] for x in c.encode("utf-8")]
                start = k + 1
        if start < len(text):
            out += self.fragment(text[start:])
        return out

    def encode(self, text: str) -> bytes:
        """Ids of a whole text, as int32 bytes."""
        return b"".join(self.words.all(pc.pretokens(text)))

    def decode(self, ids: list[int]) -> str:
        surface = self.v.surface
        try:
            out = "".join([surface[i] for i in ids])
        except TypeError:  # byte pieces or control pieces
            raw = b"".join(bytes((s,)) if isinstance(s, int) else (s or "").encode("utf-8") for s in map(surface.__getitem__, ids))
            out = raw.decode("utf-8", "replace")
        return out[1:] if out[:1] == " " else out


def encoder(model: bytes, cache_bytes: int = CACHE_BYTES) -> Encoder:
    return resident(f"bpe_exact {cache_bytes}", model, lambda data: Encoder(data, cache_bytes))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``docs`` (with a string column ``text``) plus ``_ids`` array<int>; no begin or end ids."""
    sent = docs.sparkSession.sparkContext.broadcast(pc.load(path))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(sent.value)
        for batch in batches:
            coded = [e.encode(t or "") for t in batch.column("text").to_pylist()]
            ends = np.cumsum([0, *(len(c) // 4 for c in coded)]).astype(np.int32)
            values = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(coded))])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(ends), values)],
                                             names=[*batch.schema.names, "_ids"])
    return docs.mapInArrow(run, docs.withColumn("_ids", F.array().cast("array<int>")).schema)


def decode(coded: DataFrame, path: str) -> DataFrame:
    """``coded`` (with ``_ids``) plus ``_decoded`` string."""
    sent = coded.sparkSession.sparkContext.broadcast(pc.load(path))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(sent.value)
        for batch in batches:
            out = [None if ids is None else e.decode(ids) for ids in batch.column("_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*batch.schema.names, "_decoded"])
    return coded.mapInArrow(run, coded.withColumn("_decoded", F.lit("").cast("string")).schema)


def report(docs: DataFrame, path: str) -> DataFrame:
    """Per document: n_tokens, ids_sha256, decoded_sha256; one worker encodes and decodes, so ids stay in it."""
    d = texts(docs)
    sent = d.sparkSession.sparkContext.broadcast(pc.load(path))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(sent.value)
        decimal = [str(i) for i in range(len(e.v.pieces))]
        sha = hashlib.sha256
        for batch in batches:
            counts, ids_sha, text_sha = [], [], []
            for text in batch.column("text"):
                ids = np.frombuffer(e.encode(text.as_py() or ""), dtype=np.int32).tolist()
                counts.append(len(ids))
                ids_sha.append(sha(",".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
                text_sha.append(sha(e.decode(ids).encode("utf-8")).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()),
                                              pa.array(text_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    return d.mapInArrow(run, f"doc_id {dict(d.dtypes)['doc_id']}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def token_rows(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids, n_tokens and the digest of the text that the ids decode to, of every row of ``docs``."""
    d = texts(docs)
    sent = d.sparkSession.sparkContext.broadcast(pc.load(path))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(sent.value, SHARED_CACHE_BYTES)  # one worker holds one encoder for both directions
        for batch in batches:
            coded = [np.frombuffer(e.encode(t or ""), dtype=np.int32) for t in batch.column("text").to_pylist()]
            digests = [hashlib.sha256(e.decode(ids.tolist()).encode("utf-8")).hexdigest() for ids in coded]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(coded, pa.list_(pa.int32())), pa.array([len(ids) for ids in coded], pa.int64()),
                                              pa.array(digests, pa.string())], names=["doc_id", "ids", "n_tokens", "decoded_sha256"])
    return d.mapInArrow(run, f"doc_id {dict(d.dtypes)['doc_id']}, ids array<int>, n_tokens long, decoded_sha256 string")
