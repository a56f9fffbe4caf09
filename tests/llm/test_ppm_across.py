"""Contexts that cross spaces: the model of op2_ppm_scores."""

import math
import zlib
from collections import Counter, defaultdict

import pytest

from revlens.llm import ppm, queries
from test_ppm import cost, rows, tokens


def symbols(text):
    return b"".join([b" ", *(w + b" " for w in tokens(text)), b"\xff"])


def contexts(s):
    return [(s[max(0, p - ppm.ORDER):p], s[p]) for p in range(1, len(s))]


def brute(data):
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 if i is not None else False for i, _ in data}
    learn = [t for i, t in data if not held[i]]
    counts = defaultdict(Counter)
    for t in learn:
        for context, symbol in contexts(symbols(t)):
            for k in range(len(context) + 1):
                counts[context[len(context) - k:]][symbol] += 1
    c = Counter(w for t in learn for w in tokens(t))
    c["end"] = len(learn)
    n, v = sum(c.values()), len([x for x in c.values() if x])
    out = []
    for i, t in data:
        all_ = [*tokens(t), "end"]
        out.append((i, held[i], len(all_), sum(c[w] > 0 for w in all_), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in all_),
                    sum(cost(counts, context, symbol) for context, symbol in contexts(symbols(t)))))
    return out


@pytest.mark.parametrize("slice_bytes", [1 << 30, 2000])
def test_scores_across_words_against_brute_force(spark, slice_bytes):
    data = rows(2)
    d = spark.createDataFrame(data, "doc_id long, text string").selectExpr("*", "'x' as slice", "1 as score").repartition(3)
    got = sorted((tuple(r) for r in ppm.score(d, slice_bytes, across=True).collect()), key=str)
    want = sorted(brute(data), key=str)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert g[5:] == pytest.approx(w[5:], rel=1e-9), g


@pytest.mark.parametrize("chunk", [1 << 20, 7, 40])
def test_chunks_give_the_same_grams_and_sums(monkeypatch, chunk):
    import numpy as np
    import pyarrow as pa

    texts = [t for _, t in rows(3, 12)]
    monkeypatch.setattr(ppm, "CHUNK", chunk)
    s = ppm.Slice(pa.array(texts), np.ones(len(texts), dtype=bool), True)
    want = Counter((min(p, ppm.ORDER), x[max(0, p - ppm.ORDER):p + 1]) for x in map(symbols, texts) for p in range(1, len(x)))
    got = {(int(g >> 56), int(g & ((1 << 48) - 1)).to_bytes(6)[5 - int(g >> 56):]): int(n) for g, n in zip(s.gram.tolist(), s.gram_train)}
    assert got == want
    assert s.sums(np.ones(len(s.gram))).tolist() == [len(symbols(t)) - 1 for t in texts]


def test_the_registered_query_tells_orders_of_the_same_words_apart(spark, tmp_path):
    free = [i for i in range(100) if zlib.crc32(str(i).encode()) % 7 != 2]
    held = [i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2]
    data = [(i, "the cat sat on the mat") for i in free] + [(held[0], "the cat sat on the mat"), (held[1], "mat the on sat cat the")]
    spark.createDataFrame(data, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.score for r in queries.QUERIES["op2_ppm_scores"](spark, str(tmp_path)).collect()}
    assert got[held[0]] > got[held[1]] + 1
