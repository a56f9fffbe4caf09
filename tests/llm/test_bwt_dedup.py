import hashlib
import random

import numpy as np
import pytest

from revlens.llm import bwt_dedup as D
from revlens.llm import segments as S


def brute(docs, length):
    seen, out = {}, []
    for k, (i, t) in enumerate(docs):
        b = (t or "").encode()
        gone = [False] * len(b)
        for s in range(len(b) - length + 1):
            if b[s:s + length] in seen:
                gone[s:s + length] = [True] * length
            else:
                seen[b[s:s + length]] = 1
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(g and (not p or not gone[p - 1]) for p, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed):
    r = random.Random(seed)
    text = lambda n: "".join(r.choice("abcdeé \n") for _ in range(n))
    shared = [text(300), text(130), text(60)]
    docs = []
    for i in range(60):
        parts = [text(r.choice([0, 10, 150, 400]))]
        for s in r.sample(shared, r.randint(0, 3)):
            a = r.randrange(20)
            parts += [s[a:], text(r.choice([0, 3, 200]))]
        docs.append((i, "".join(parts)))
    long = text(700)
    for i in range(8):
        c = list(long)
        for _ in range(i):
            c[r.randrange(len(c))] = "X"
        docs.append((100 + i, "".join(c)))
    return docs + [(200, None), (201, ""), (202, "ab" * 900), (203, "For " * 300), (204, long), (205, "z" * 99), (206, "z" * 100), (207, "z" * 101)]


@pytest.mark.parametrize("seed,slice_bytes,hot", [(1, 1 << 30, 50_000), (2, 3000, 50_000), (3, 3000, 2)])
def test_against_brute_force(spark, seed, slice_bytes, hot):
    docs = corpus(seed)
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as slice", "'x' as tie").orderBy("text").repartition(3)
    assert sorted(tuple(r) for r in D.report(d, slice_bytes=slice_bytes, hot=hot).collect()) == sorted(brute(docs, 100))


def test_repeated_and_null_ids(spark):
    t = "".join(chr(97 + k * 7 % 26) for k in range(150)) + "!" * 20
    d = spark.createDataFrame([(1, t), (1, t), (None, t), (2, "y" + t)], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_removed) for r in D.report(d).collect())
    assert [g[0] for g in got] == ["1", "1", "2", "None"]
    assert got[0][1] < got[1][1] == got[2][1] == got[3][1] == len(t)
    assert D.report(d.limit(0)).count() == 0


def test_long_texts_are_cut_into_blocks(monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 500)
    r = random.Random(4)
    raw = np.frombuffer(bytes(r.choice(b"ab") for _ in range(3000)), np.uint8)
    offsets = np.array([0, 2500, 2550, 3000])
    starts = []
    for row, start, run, _, _ in S.segments(raw, offsets, 100):
        starts += [(int(a), int(s) + k) for a, s, n in zip(row, start, run) for k in range(n)]
    assert sorted(starts) == [(0, s) for s in range(2401)] + [(2, s) for s in range(351)]


def test_classes_of_shared_prefixes():
    r = random.Random(8)
    for n in (1, 2, 30, 400):
        text = np.array([r.choice([1, 2, 256]) for _ in range(n)])
        order, group = D.shared_prefixes(text, 6)
        twice = np.concatenate([text] * 8)
        prefix = [tuple(twice[p:p + 6]) for p in order]
        for a in range(n):
            for b in range(n):
                assert (group[a] == group[b]) == (prefix[a] == prefix[b])
