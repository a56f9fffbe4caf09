import hashlib
import random
import re

import pytest

from revlens.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return WORD.findall(low)


def brute(docs, items, window=10):
    out = {}
    for i, text in docs:
        w, hit, met = words(text), set(), set()
        for item, it in items:
            x = words(it)
            k = min(window, len(x))
            for a in range(len(x) - k + 1) if k else ():
                for b in range(len(w) - k + 1):
                    if w[b:b + k] == x[a:a + k]:
                        hit.update(range(b, b + k))
                        met.add(str(item))
        out[i] = (len(w), len(hit), len(met), hashlib.sha256(",".join(sorted(met)).encode()).hexdigest(), bool(hit))
    return out


def case(seed):
    r = random.Random(seed)
    vocab = ["a", "b", "c", "Été", "D9", "x"]
    text = lambda n: "".join(r.choice(vocab) + r.choice([" ", ", ", "\n", "--"]) for _ in range(n))
    items = [(i, text(r.choice([0, 2, 3, 10, 14, 30]))) for i in range(8)] + [(3, "a b c x x"), (99, None)]
    docs = [(i, text(r.choice([0, 1, 9, 40, 200]))) for i in range(12)]
    docs += [(20 + i, text(5) + (it or "") + text(4)) for i, (_, it) in enumerate(items)] + [(90, None), (91, ""), (92, "A" * 5000 + " a b")]
    return docs, items


@pytest.mark.parametrize("seed,shard", [(1, 200_000), (2, 200_000), (3, 130)])
def test_report_against_brute_force(spark, seed, shard):
    docs, items = case(seed)
    d = spark.createDataFrame([(i, t, 7, "x") for i, t in docs], "doc_id long, text string, n_words int, _x string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in D.report(d, b, shard_words=shard).collect()}
    assert got == brute(docs, items)


def test_clean_cuts_spans_and_drops_covered(spark):
    item = " ".join(f"w{i}" for i in range(12))
    rest = " ".join(f"z{i}" for i in range(20))
    d = spark.createDataFrame([(1, f"{rest} {item}. {rest}", "s"), (2, item, None), (3, rest, "s"), (4, None, "s"), (4, None, "s")],
                              "doc_id long, text string, _gone string")
    b = spark.createDataFrame([(1, item.upper())], "item_id long, text string")
    got = sorted((r.doc_id, r.text, r["_gone"]) for r in D.clean(d, b).collect() if r.text is not None)
    assert got == [(1, f"{rest} . {rest}", "s"), (3, rest, "s")]
    assert D.clean(d, b).where("doc_id = 4").count() == 2
    assert D.clean(d, b).columns == ["doc_id", "text", "_gone"]


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    b = spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r)[:4] for r in D.report(d, b).collect()] == [(1, 2, 0, 0)]
    assert D.report(d.limit(0), b).count() == 0
