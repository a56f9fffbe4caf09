"""Benchmarks larger than one shard."""

import random
import sys

from revlens.llm import decontaminate as D

sys.path.insert(0, __file__.rsplit("/", 1)[0])
from test_decontaminate import brute, case, words  # noqa: E402


def test_copies_of_an_item_beyond_one_shard(spark):
    item = " ".join(f"w{i}" for i in range(40))
    docs = [(1, "x " + item + " y"), (2, "none of it")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame([(7, item)] * 30, "item_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in D.report(d, b, shard_words=130).collect()}
    assert got == brute(docs, [(7, item)])


def test_many_shards_are_bounded_whole_and_read_one_by_one(spark, monkeypatch):
    monkeypatch.setattr(D, "SHARDS_AT_ONCE", 3)
    docs, items = case(5)
    r = random.Random(6)
    items += [(200 + i, " ".join(r.choice("abcx") for _ in range(r.randint(1, 40)))) for i in range(40)]
    items += items[:20] + [(None, "a b c a b c a b c a")]
    docs += [(500 + i, f"{t} {items[i][1]} c {items[40][1]}") for i, (_, t) in enumerate(docs[:8])] + docs[:2]
    b = spark.createDataFrame(items, "item_id long, text string").repartition(3)
    shards = [shard() for shard in D.benchmark_shards(b, 10, 130)]
    pieces = [p for shard in shards for p in shard]
    assert len(shards) > 6 and all(sum(len(w.split(b" ")) for _, w, _ in shard) <= 130 for shard in shards)
    assert sorted(pieces, key=str) == sorted({(None if i is None else str(i), " ".join(words(t)).encode(), len(words(t)) < 10) for i, t in items if words(t)}, key=str)
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, _x string").repartition(3)
    many = sorted(map(tuple, D.report(d, b, shard_words=130).collect()), key=str)
    assert many == sorted(map(tuple, D.report(d, b).collect()), key=str)
    named, every = brute(docs, [x for x in items if x[0] is not None]), brute(docs, items)
    assert {(i, n, hit, met, sha, c) for i, n, hit, met, sha, c in many} == {(i, *every[i][:2], *named[i][2:4], every[i][4]) for i in named}


def test_items_longer_than_a_shard(spark):
    r = random.Random(8)
    items = [(i, " ".join(f"w{r.randint(0, 400)}" for _ in range(300))) for i in range(3)]
    docs = [(i, "x " + t[200:900] + " y") for i, t in items] + [(9, "z")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    assert [len(shard()) for shard in D.benchmark_shards(b, 10, 130)] == [1, 1, 1]
    assert {r.doc_id: tuple(r)[1:] for r in D.report(d, b, shard_words=130).collect()} == brute(docs, items)
