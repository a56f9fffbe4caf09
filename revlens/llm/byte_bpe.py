"""Byte-level BPE encoding and decoding with a contiguous rank array.

A text is cut at the vocabulary's added tokens, the rest into words by the
vocabulary's pattern. A short word is merged in place: one array holds the
boundaries of its parts, a second, as long as there are neighbours, the rank at
which each pair of neighbours merges. The least rank (leftmost of equals) is
found by a scan, its inner boundary is deleted, and the ranks of the two
neighbouring pairs are refreshed, until no pair has a rank. A rank counts only
for the very pair that the vocabulary lists: its table maps the joint bytes to
the rank and the length of the left part. For words over ``SHORT`` bytes, where
a scan a merge would grow with the square of the length, the same pairs wait in
a heap and the boundaries are linked, with the same result.

Words are cut by the installed ``regex`` module, whose Unicode tables can be
newer than those of the library to match; ``newer_letters`` lists the letters
and numbers that only the former knows, and they are masked before the cut.

Scale: ``mapInArrow`` over documents, no shuffle. The vocabulary file is read
on the driver (its path is a parameter) and broadcast, a fixed few MB. A worker
keeps the encodings of distinct words in a cache bounded by bytes.

Defined cases: null and empty texts have no ids and decode to the empty text;
null ids decode to null in ``decode``; repeated documents: row by row; long
texts and words: whole, a word of n bytes in O(n log n). Further columns of the
input, of any name, do not matter to ``report``, and pass through ``encode``.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.llm.frames import resident, small_batches, texts

#: the pattern that the vocabulary's words are cut by (fixed value)
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SHORT = 96
CACHE_BYTES = 128 << 20
NONE = sys.maxsize  # no rank; its low bits are no length of a left part


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it prints, else the next one from 256 on."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return {chr(b if b in prints else next(spare)): b for b in range(256)}


def newer_letters(split) -> str:
    """Letters and numbers of the ``regex`` module's Unicode that ``split`` (text to words) takes for neither, as ranges of a character class."""
    known = regex.compile(r"[\p{L}\p{N}]")
    ranges: list[list[int]] = []
    for i in range(sys.maxunicode + 1):
        c = chr(i)
        if unicodedata.category(c) == "Cn" and known.match(c) and len(split("." + c)) == 1:
            if ranges and ranges[-1][1] == i - 1:
                ranges[-1][1] = i
            else:
                ranges.append([i, i])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges)


@lru_cache(maxsize=2)
def load(path: str) -> bytes:
    """What workers need of a byte-level vocabulary file, as JSON; raises for files of another kind."""
    from tokenizers import Tokenizer
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec["pre_tokenizer"] or {}
    plain = not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges"))
    added = spec["added_tokens"]
    if model["type"] != "BPE" or not plain or spec["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") \
            or not pre.get("use_regex", True) or any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
        raise ValueError("needs a byte-level BPE vocabulary without normaliser, prefix space or stripping tokens")
    split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
    return json.dumps({"vocab": model["vocab"], "merges": [m.split(" ") if isinstance(m, str) else m for m in model["merges"]],
                       "added": {t["content"]: t["id"] for t in added}, "newer": newer_letters(split)}).encode()


class WordCache(dict):
    """Word to ids as bytes, made when first asked for.

    Holds two generations of ``limit`` / 2 bytes at most: when the newer is
    full, it becomes the older, and words that are asked for again come back.
    """

    def __init__(self, make, limit: int = CACHE_BYTES):
        super().__init__()
        self.make, self.limit, self.held = make, limit, 0
        self.older: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = self.make(word)
        if len(word) <= SHORT:
            self.held += len(ids) + len(word) + 200  # two objects and their slot
            if 2 * self.held > self.limit:
                self.older = dict(self)
                self.clear()
                self.held = 0
            self[word] = ids
        return ids


class Encoder:
    def __init__(self, data: bytes):
        spec = json.loads(data)
        letters = byte_letters()
        raw = {t: bytes(letters[c] for c in t) for t in spec["vocab"]}
        self.ids = {raw[t]: i for t, i in spec["vocab"].items()}
        #: joint bytes -> rank << 16 | length of the left part
        self.ranks = {raw[a] + raw[b]: r << 16 | len(raw[a]) for r, (a, b) in enumerate(spec["merges"])}
        self.packed = {t: i.to_bytes(4, "little") for t, i in self.ids.items()}
        self.tokens: list[bytes] = [b""] * (1 + max([*self.ids.values(), *spec["added"].values()], default=0))
        for t, i in self.ids.items():
            self.tokens[i] = t
        for t, i in spec["added"].items():
            self.tokens[i] = t.encode("utf-8")
        self.added = {t: i.to_bytes(4, "little") for t, i in spec["added"].items()}
        longest_first = sorted(self.added, key=len, reverse=True)
        self.cut_added = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")") if self.added else None
        self.words = regex.compile(PATTERN)
        self.newer = re.compile("[" + spec["newer"] + "]") if spec["newer"] else None
        self.cache = WordCache(self.word)

    def word(self, word: str) -> bytes:
        raw = word.encode("utf-8")
        known = self.packed.get(raw)
        if len(raw) == 1 and known:
            return known
        cut = self.short(raw) if len(raw) <= SHORT else self.long(raw)
        return b"".join([self.packed[raw[a:b]] for a, b in zip(cut, cut[1:])])

    def short(self, raw: bytes) -> list[int]:
        """Boundaries of the parts of a short word: scan for the least rank, delete its boundary, refresh its neighbours."""
        table, n = self.ranks.get, len(raw)
        cut = list(range(n + 1))
        ranks = [table(raw[k:k + 2], NONE) for k in range(n - 1)]  # of the parts that meet at boundary k + 1
        while ranks:
            least = min(ranks)
            if least == NONE:
                break
            k = ranks.index(least)
            del cut[k + 1], ranks[k]
            if k:
                start = cut[k - 1]
                found = table(raw[start:cut[k + 1]], NONE)
                ranks[k - 1] = found if found & 0xFFFF == cut[k] - start else NONE
            if k < len(ranks):
                start = cut[k]
                found = table(raw[start:cut[k + 2]], NONE)
                ranks[k] = found if found & 0xFFFF == cut[k + 1] - start else NONE
        return cut

    def long(self, raw: bytes) -> list[int]:
        """Boundaries of the parts of a long word: the waiting pairs in a heap, boundaries linked both ways."""
        n, table = len(raw), self.ranks.get
        after, before = array("q", range(1, n + 2)), array("q", range(-1, n))
        heap: list[int] = []  # rank above the 40 bits of the left part's start

        def rank(a: int) -> int:
            """Rank of the part that starts at ``a`` with the next one."""
            b = after[a]
            if b >= n:
                return NONE
            found = table(raw[a:after[b]], NONE)
            return found >> 16 if found & 0xFFFF == b - a else NONE

        def offer(a: int) -> None:
            r = rank(a)
            if r != NONE:
                heapq.heappush(heap, r << 40 | a)
        for a in range(n - 1):
            offer(a)
        gone = bytearray(n + 1)
        while heap:
            least = heapq.heappop(heap)
            a = least & (1 << 40) - 1
            if gone[a] or rank(a) != least >> 40:
                continue  # one of the two parts has grown since
            b = after[a]
            gone[b] = 1
            after[a] = after[b]
            before[after[a]] = a
            offer(a)
            if before[a] >= 0:
                offer(before[a])
        return [k for k in range(n + 1) if not gone[k]]

    def split(self, text: str) -> list[str]:
        """Words of a text without added tokens."""
        if self.newer is not None and not text.isascii() and self.newer.search(text):
            masked = self.newer.sub("", text)  # private use: no letter, number or space
            return [text[m.start():m.end()] for m in self.words.finditer(masked)]
        return self.words.findall(text)

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        cached = self.cache.__getitem__
        if self.cut_added is None or not self.cut_added.search(text):
            return b"".join(map(cached, self.split(text)))
        out: list[bytes] = []
        for k, part in enumerate(self.cut_added.split(text)):
            out += [self.added[part]] if k % 2 else map(cached, self.split(part))
        return b"".join(out)

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.tokens.__getitem__, ids)).decode("utf-8", "replace")


def encoder(data: bytes) -> Encoder:
    return resident("byte_bpe", data, Encoder)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``docs`` (with a string column ``text``) plus ``_ids`` array<int>; no special tokens are added."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(load(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(sent.value)
        for batch in batches:
            coded = [np.frombuffer(e.encode(t or ""), dtype="<i4") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(coded, pa.list_(pa.int32()))], names=[*batch.schema.names, "_ids"])
    return docs.mapInArrow(run, docs.withColumn("_ids", F.array().cast("array<int>")).schema)


def decode(coded: DataFrame, path: str) -> DataFrame:
    """``coded`` (with ``_ids``) plus ``_decoded`` string."""
    small_batches(coded.sparkSession)
    sent = coded.sparkSession.sparkContext.broadcast(load(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(sent.value)
        for batch in batches:
            out = [None if ids is None else e.decode(ids) for ids in batch.column("_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*batch.schema.names, "_decoded"])
    return coded.mapInArrow(run, coded.withColumn("_decoded", F.lit("").cast("string")).schema)


def report(docs: DataFrame, path: str) -> DataFrame:
    """Per document: n_tokens, ids_sha256, decoded_sha256; encoded and decoded by one worker, so ids stay in it."""
    d = texts(docs)
    sent = d.sparkSession.sparkContext.broadcast(load(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(sent.value)
        sha = hashlib.sha256
        for batch in batches:
            counts, ids_sha, text_sha = [], [], []
            for text in batch.column("text"):
                coded = e.encode(text.as_py() or "")
                counts.append(len(coded) // 4)
                ids_sha.append(sha(coded).hexdigest())
                text_sha.append(sha(e.decode(np.frombuffer(coded, dtype="<u4").tolist()).encode("utf-8")).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()),
                                              pa.array(text_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    return d.mapInArrow(run, f"doc_id {dict(d.dtypes)['doc_id']}, n_tokens long, ids_sha256 string, decoded_sha256 string")
