import hashlib
import random

import pytest

from revlens.llm import fingerprints as FP


def corpus(seed=1, n=60):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeéÉ") for _ in range(4))
    docs = [(i * 3 - 20, " ".join(word() for _ in range(r.choice([0, 1, 3, 30, 200])))) for i in range(n)]
    return docs + [(500, docs[7][1]), (501, None), (502, "x\U0001F600" * 4000), (502, "a b c"), (None, "last one"), (None, "last one")]


def ordered(docs):
    out = sorted(docs, key=lambda d: d[1] or "")
    return sorted(out, key=lambda d: -d[0] if d[0] is not None else 10**9)


@pytest.mark.parametrize("target", [1 << 30, 900])
def test_edited_against_brute_force(spark, target):
    docs = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as part", "'x' as ghost").repartition(5)
    got = FP.edited_report(d, target).collect()
    seq = [(i, t or "") for i, t in ordered(docs)]
    want = []
    for k, (i, t) in enumerate(seq):
        nxt = seq[(k + 1) % len(seq)][1]
        e = t[:len(t) - len(t) // 3] + nxt[:len(t) // 3]
        want.append((i, len(t), hashlib.sha256(e.encode()).hexdigest()))
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=str) == sorted(want, key=str)
    print_of = {}
    text = {(i, len(t)): t for i, t in seq}
    for r in got:
        t = text[r.doc_id, r.n_chars]
        assert print_of.setdefault(t.lower() if t.isascii() else t, r.fingerprint) == r.fingerprint or not t.isascii()
        assert 0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1 and len(r.fingerprint) == len(r.edited_fingerprint) == 512
    long = [r for r in got if r.n_chars > 800]
    assert long and all(0.3 < r.near_edited < 0.75 and r.near_next < 0.2 for r in long if r.doc_id != 502)
    same = {r.doc_id: r.fingerprint for r in got}
    assert same[500] == same[docs[7][0]]


def test_likeness_estimates_jaccard():
    import numpy as np
    import pyarrow as pa
    r = random.Random(4)
    w = [str(r.random()) for _ in range(900)]
    a, b = FP.signatures(pa.array([" ".join(w[:600]), " ".join(w[150:])]))
    assert abs(float(np.mean(a == b)) - 446 / 904) < 0.2


def test_near_duplicates_and_empty(spark):
    r = random.Random(2)
    base = [" ".join(str(r.randrange(10**6)) for _ in range(120)) for _ in range(4)]
    docs = [(g * 10 + k, b if not k else b.replace(b.split()[k * 9], "new")) for g, b in enumerate(base) for k in range(4)] + [(90, None), (91, "")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    got = {x.doc_id: x.component_id for x in FP.near_duplicates(d).collect()}
    assert got == {i: i // 10 * 10 for i, _ in docs[:-2]} | {90: 90, 91: 91}
    assert FP.edited_report(d.limit(0)).count() == 0
    assert [x.near_next for x in FP.edited_report(d.where("doc_id = 91")).collect()] == [1.0]
