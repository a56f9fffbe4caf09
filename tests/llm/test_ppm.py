import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from revlens.llm import ppm

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    return [w.encode() for w in WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))]


def train(docs):
    counts = defaultdict(Counter)
    for text in docs:
        for w in tokens(text):
            s = b" " + w + b" "
            for p in range(1, len(s)):
                for k in range(0, min(p, ppm.ORDER) + 1):
                    counts[s[p - k:p]][s[p]] += 1
        counts[b" "][255] += 1
        counts[b""][255] += 1
    return counts


def cost(counts, context, symbol):
    excluded, p = set(), 1.0
    for k in range(len(context), -1, -1):
        seen = {s: c for s, c in counts.get(context[len(context) - k:], {}).items() if s not in excluded}
        if not counts.get(context[len(context) - k:]):
            continue
        n, q = sum(seen.values()), len(seen)
        if symbol in seen:
            return math.log10(p * seen[symbol] / (n + q))
        if q:
            p *= q / (n + q)
        excluded |= set(seen)
    return math.log10(p / (256 - len(excluded)))


def brute(rows):
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 if i is not None else False for i, _ in rows}
    learn = [t for i, t in rows if not held[i]]
    counts = train(learn)
    c = Counter(w for t in learn for w in tokens(t))
    c["end"] = len(learn)
    n, v = sum(c.values()), len([x for x in c.values() if x])
    out = []
    for i, t in rows:
        words = tokens(t)
        score = cost(counts, b" ", 255)
        for w in words:
            s = b" " + w + b" "
            score += sum(cost(counts, s[max(0, p - ppm.ORDER):p], s[p]) for p in range(1, len(s)))
        all_ = [*words, "end"]
        out.append((i, held[i], len(all_), sum(c[w] > 0 for w in all_), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in all_), score))
    return out


def rows(seed, n=60):
    r = random.Random(seed)
    syllables = ["the", "on", "é", "in", "A", "x"]
    return [(i, " ".join("".join(r.choice(syllables) for _ in range(r.randint(1, 4))) + r.choice(["", "", "\n", "\t."]) for _ in range(r.randint(0, 40)))) for i in range(n)] + [
        (900, None), (901, ""), (902, "\x00\x01 zzz" * 50), (903, "q" * 3000), (3, "again the"), (None, "the on"), (904, "\U0001F600 日本")]


@pytest.mark.parametrize("slice_bytes", [1 << 30, 2000])
def test_scores_against_brute_force(spark, slice_bytes):
    data = rows(1)
    d = spark.createDataFrame(data, "doc_id long, text string").selectExpr("*", "'x' as slice", "1 as score").repartition(3)
    got = sorted((tuple(r) for r in ppm.score(d, slice_bytes).collect()), key=str)
    want = sorted(brute(data), key=str)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert g[5:] == pytest.approx(w[5:], rel=1e-9), g


def test_a_proper_distribution():
    counts = train(["the theme thane", "on on", "then"])
    for context in (b" ", b" t", b" th", b" the", b"q", b" theme"[-5:], b"n"):
        assert sum(10 ** cost(counts, context, s) for s in range(256)) == pytest.approx(1.0)


def test_nothing_to_learn_from_and_empty(spark):
    d = spark.createDataFrame([(i, "the") for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 2], "doc_id long, text string")
    for r in ppm.score(d).collect():
        assert r.score == pytest.approx(-5 * math.log10(256)) and (r.n_known, r.train_tokens, r.base_score) == (0, 0, 0.0)
    assert ppm.score(d.limit(0)).count() == 0
