import random
import re

import pytest

from revlens.llm import minhash_tensor as M
from revlens.llm import near_groups as G

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text, k):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(docs, k):
    sets = [shingle_set(t, k) for _, t in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in range(len(docs)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    out = []
    for a, (i, _) in enumerate(docs):
        same = [docs[b][0] for b in range(len(docs)) if find(b) == find(a) and docs[b][0] is not None]
        c = i if not sets[a] else min(same, default=None)
        out.append((i, len(sets[a]), c, i == c))
    return sorted(out, key=str)


def corpus(seed, groups=12, copies=9):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(4))
    shared = " ".join(word() for _ in range(30))
    docs = []
    for g in range(groups):
        base = [word() for _ in range(r.choice([3, 12, 80, 150]))]
        for _ in range(copies):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 3, 8])):
                w[r.randrange(len(w))] = word()
            docs.append((len(docs) * 7 % 1000, (shared + " " if g % 3 == 0 else "") + r.choice([" ", "\n"]).join(w)))
    return docs + [(2000, None), (2001, ""), (2002, " \n"), (2003, docs[0][1].upper()), (docs[5][0], docs[5][1]), (None, docs[7][1]), (2004, "x " * 9000)]


@pytest.mark.parametrize("seed", [1, 2])
def test_components_against_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(G, "BLOCK", 4)  # several blocks of the keys that stay open
    docs = corpus(seed)
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' as n", "1 as cid").repartition(4)
    got = sorted((tuple(r) for r in M.report(d).collect()), key=str)
    assert got == brute(docs, 4)


def test_one_document_of_each_group_stays(spark):
    docs = [(i, t) for i, t in corpus(3) if i is not None] + [(2001, "")]
    d = spark.createDataFrame([(i, t, "s") for i, t in docs], "doc_id long, text string, root string")
    want = {(i, c) for i, n, c, kept in brute(docs, 5) if n and kept}
    left = M.one_of_each(d)
    assert left.columns == d.columns
    got = [r.doc_id for r in left.collect()]
    assert sorted(got) == sorted([i for i, _ in want] + [2000, 2001, 2001, 2002])
    assert M.report(d.limit(0)).count() == 0 and M.one_of_each(d.limit(0)).count() == 0


def test_tables_need_a_square_root_of_the_values():
    import numpy as np
    x = np.arange(1, 500, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    keys = M.table_keys(np.stack([M.minhash(x), M.minhash(x[20:])]))
    assert keys.shape == (2, 100) and M.WIDTH == 40
    assert len(set(keys[0].tolist()) & set(keys[1].tolist())) > 30
