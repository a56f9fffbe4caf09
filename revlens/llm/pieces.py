"""A SentencePiece vocabulary in a worker: pieces, scores, byte pieces, pre-tokens.

The model file is read once on the driver (its path is a parameter) and its
bytes, a fixed file of under a few MB, are broadcast; executors need no path.
No piece has a space mark after another character, so a text falls into
pre-tokens (a run of space marks and what follows up to the next one) that
are encoded one by one. ``vocabulary`` raises for models that break this or
normalise their input.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from sys import getsizeof

MARK = "▁"
PRETOKEN = re.compile(r" +[^ \n]*|\n[^ \n]*")


@dataclass
class Vocabulary:
    pieces: list[str]
    scores: list[float]
    ids: dict[str, int]      # ordinary pieces
    bytes_: list[int]        # id of each byte piece
    surface: list[str | int | None]  # text, byte value, or None for control pieces


def load(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def vocabulary(model: bytes) -> Vocabulary:
    """The vocabulary; raises unless the rules above hold for the model."""
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    n = sp.get_piece_size()
    pieces = [sp.id_to_piece(i) for i in range(n)]
    plain = {i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))}
    ids = {pieces[i]: i for i in plain}
    by_byte = {int(pieces[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
    if len(by_byte) != 256 or any(MARK in p.lstrip(MARK) or "\n" in p for p in ids) or sp.encode("a  ﬁ") != sp.encode("a" + MARK * 2 + "ﬁ") \
            or sp.decode(sp.encode(" ﬁ  ")) != " ﬁ  ":
        raise ValueError("needs byte fallback, no normalisation and space marks only at the start of pieces")
    to_byte = {i: b for b, i in by_byte.items()}
    surface = [p.replace(MARK, " ") if i in plain else to_byte.get(i) for i, p in enumerate(pieces)]
    return Vocabulary(pieces, [sp.get_score(i) for i in range(n)], ids, [by_byte[b] for b in range(256)], surface)


def pretokens(text: str) -> list[str]:
    """Pre-tokens of a text with its dummy prefix.

    A bare word stands for one space mark and the word; a leading space marks a
    run of space marks as written; a leading newline (a byte piece, which
    nothing merges across) has no space mark.
    """
    if not text:
        return []
    if MARK in text:
        text = text.replace(MARK, " ")
    if "  " not in text and " \n" not in text and text[0] != " " and text[-1] != " ":
        return text.replace("\n", " \n").split(" ")
    return [t[1:] if t[0] == " " and t[1:2] not in ("", " ") else t for t in PRETOKEN.findall(" " + text)]


def marked(pretoken: str) -> str:
    """The pre-token with its space marks."""
    return pretoken.replace(" ", MARK) if pretoken[:1] in (" ", "\n") and pretoken else MARK + pretoken


class Cache:
    """A dictionary bounded by entries and bytes: two generations of half of ``held`` bytes, the older is dropped when the newer is full."""

    def __init__(self, make, limit: int = 400_000, held: int = 64 << 20):
        self.make, self.limit, self.half, self.held = make, limit, held // 2, 0
        self.new: dict = {}
        self.old: dict = {}

    def all(self, keys: list) -> list:
        found = list(map(self.new.get, keys))
        if None in found:
            for i, v in enumerate(found):
                if v is None:
                    found[i] = self[keys[i]]
        return found

    def __getitem__(self, key):
        v = self.new.get(key)
        if v is None:
            v = self.old.get(key)
            if v is None:
                v = self.make(key)
            if len(key) <= 64:  # long strings are not worth their memory
                self.held += getsizeof(key) + getsizeof(v) + 100  # two objects and their slot
                if len(self.new) >= self.limit or self.held > self.half:
                    self.old, self.new, self.held = self.new, {}, 0
                self.new[key] = v
        return v
