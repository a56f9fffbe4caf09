"""Token counts under a unigram vocabulary, by dynamic programming on a trie.

The distinct pre-tokens of a task go into a trie. Each trie node holds the
forward score of its string: the best sum of piece scores over all
segmentations, and the number of tokens of that best segmentation. A node is
computed once, from nodes above it, whatever number of pre-tokens share the
prefix: the pieces that end at the node are the outputs of an Aho-Corasick
state, and each leads back to the node where the piece starts. The terminal
node of a pre-token has its count; a document's count is the sum.

Ties: the segmentation whose last piece is longest. A character that is no
piece costs the least score less 10 and counts as its UTF-8 bytes.

Scale: one ``mapInArrow``, no shuffle. A worker's trie is emptied when it
reaches ``NODES`` nodes, which bounds memory and changes no result. A pre-token
of more than ``LONG`` characters, which few others can share, gets no nodes:
its forward scores are held for the length of the longest piece only.

Defined cases: null and empty texts count 0 tokens and score 0; repeated
documents: row by row. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.llm import pieces as pc
from revlens.llm.frames import resident, texts

NODES = 400_000
LONG = 256
UNKNOWN = 10.0


class PieceStates:
    """Aho-Corasick states over the pieces: one step per character, pieces that end there longest first."""

    def __init__(self, v: pc.Vocabulary):
        self.go: list[dict[str, int]] = [{}]
        own: list[tuple[int, float] | None] = [None]
        for piece, i in v.ids.items():
            s = 0
            for c in piece:
                t = self.go[s].get(c)
                if t is None:
                    t = self.go[s][c] = len(self.go)
                    self.go.append({})
                    own.append(None)
                s = t
            own[s] = (len(piece), v.scores[i])
        self.fail = [0] * len(self.go)
        self.out: list[tuple] = [()] * len(self.go)
        queue = list(self.go[0].values())
        for s in queue:  # grows while it is read: breadth first
            self.out[s] = ((own[s],) if own[s] else ()) + self.out[self.fail[s]]
            for c, t in self.go[s].items():
                self.fail[t] = self.step(self.fail[s], c)
                queue.append(t)

    def step(self, s: int, c: str) -> int:
        go = self.go
        while c not in go[s]:
            if not s:
                return 0
            s = self.fail[s]
        return go[s][c]


class Trie:
    """Forward scores and token counts of strings, shared by prefix."""

    def __init__(self, model: bytes):
        v = pc.vocabulary(model)
        self.states = PieceStates(v)
        self.unknown = min(v.scores[i] for i in v.ids.values()) - UNKNOWN
        self.single = {p for p in v.ids if len(p) == 1}
        self.longest = max(map(len, v.ids))
        self.terminals: dict[str, tuple[int, float]] = {}
        self.clear()

    def clear(self) -> None:
        self.children: list[dict[str, int]] = [{}]
        self.score, self.count, self.state = [0.0], [0], [0]
        self.terminals.clear()

    def _node(self, path: list[int], c: str) -> int:
        s = self.states.step(self.state[path[-1]], c)
        depth = len(path)
        best, count = None, 0
        for length, value in self.states.out[s]:
            above = path[depth - length]
            total = self.score[above] + value
            if best is None or total > best:
                best, count = total, self.count[above] + 1
        if c not in self.single:
            total = self.score[path[-1]] + self.unknown
            if best is None or total > best:
                best, count = total, self.count[path[-1]] + len(c.encode("utf-8"))
        node = len(self.score)
        self.score.append(best)
        self.count.append(count)
        self.state.append(s)
        self.children.append({})
        self.children[path[-1]][c] = node
        return node

    def rolled(self, text: str) -> tuple[int, float]:
        """(count, score) of a string without nodes; what is held reaches one longest piece back."""
        step, out, width = self.states.step, self.states.out, self.longest + 1
        scores, counts = [0.0] * width, [0] * width  # by depth, modulo width
        s = 0
        for depth, c in enumerate(text, 1):
            s = step(s, c)
            best, count = None, 0
            for length, value in out[s]:
                above = (depth - length) % width
                total = scores[above] + value
                if best is None or total > best:
                    best, count = total, counts[above] + 1
            if c not in self.single:
                above = (depth - 1) % width
                total = scores[above] + self.unknown
                if best is None or total > best:
                    best, count = total, counts[above] + len(c.encode("utf-8"))
            scores[depth % width], counts[depth % width] = best, count
        return counts[len(text) % width], scores[len(text) % width]

    def insert(self, text: str) -> int:
        """The terminal node of a string; only its new nodes are computed."""
        path = [0]
        for c in text:
            node = self.children[path[-1]].get(c)
            path.append(self._node(path, c) if node is None else node)
        return path[-1]

    def values(self, words: list[str]) -> list[tuple[int, float]]:
        found = list(map(self.terminals.get, words))
        if None in found:
            for k, f in enumerate(found):
                if f is None:
                    f = self.terminals.get(words[k])
                    if f is None:
                        if len(words[k]) > LONG:
                            f = self.rolled(pc.marked(words[k]))
                        else:
                            if len(self.score) >= NODES:
                                self.clear()
                            node = self.insert(pc.marked(words[k]))
                            f = self.terminals[words[k]] = (self.count[node], self.score[node])
                    found[k] = f
        return found


def trie(model: bytes) -> Trie:
    return resident("token_counts", model, Trie)


def count(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_pretokens, n_tokens long and score double (the sum of piece scores) of every row."""
    d = texts(docs)
    sent = d.sparkSession.sparkContext.broadcast(pc.load(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = trie(sent.value)
        for batch in batches:
            rows = [t.values(pc.pretokens(x)) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(r) for r in rows], pa.int64()), pa.array([sum([c for c, _ in r]) for r in rows], pa.int64()),
                 pa.array([sum([s for _, s in r], 0.0) for r in rows], pa.float64())],
                names=["doc_id", "n_pretokens", "n_tokens", "score"])
    schema = d.select("doc_id", F.lit(0).cast("long").alias("n_pretokens"), F.lit(0).cast("long").alias("n_tokens"), F.lit(0.0).cast("double").alias("score")).schema
    return d.mapInArrow(run, schema)
