import random

from revlens.llm import toxicity as T

WORDS = "the a river house green walked slowly under bright morning lamp table of to".split()


def corpus(n=400, seed=1):
    r = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        w = [r.choice(WORDS) for _ in range(r.randint(5, 60))]
        bad = i % 4 == 0
        for _ in range(2 if bad else 0):
            w.insert(r.randrange(len(w)), r.choice(["moron", "M0R0N", "scumbag", "sсumbаg!"]))
        docs.append((i, " ".join(w)))
        labels.append((i, 1, int(bad)))
    return docs, labels


def test_learns_scores_and_holds_out(spark):
    docs, labels = corpus()
    extra = [(9001, None), (9002, ""), (9003, "moron " * 50000), (9003, "moron " * 50000), (None, "the river")]
    d = spark.createDataFrame(docs + extra, "doc_id long, text string").selectExpr("*", "'x' as score", "1 as _score")
    lab = spark.createDataFrame(labels + [(1, 1, None), (None, 1, 1), (2, 1, 0)], "doc_id long, quality int, toxic int")
    rows = T.report(d, lab).collect()
    assert len(rows) == len(docs) + len(extra)
    truth = {i: t for i, _, t in labels}
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert len(held) > 40 and all(r.predicted == truth[r.doc_id] for r in held)
    by = {r.doc_id: r for r in rows}
    assert by[9001].predicted == by[9002].predicted == by[None].predicted == 0 and by[9001].score == by[9002].score
    assert by[9003].predicted == 1 and all(0 <= r.score <= 1 for r in rows)
    kept = T.accepted(d, lab)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in rows if not r.predicted}


def test_held_out_rows_are_not_learned_from(spark):
    docs, labels = corpus(60)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    import zlib
    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in labels]
    assert T.fit(d, lab).weights == T.fit(d, spark.createDataFrame(flipped, lab.schema)).weights


def test_no_labels(spark):
    d = spark.createDataFrame([(1, "moron")], "doc_id long, text string")
    lab = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [(r.score, r.predicted) for r in T.report(d, lab).collect()] == [(0.0, 0)]
    assert T.report(d.limit(0), lab).count() == 0


def test_folding_and_exceptions():
    assert T.fold("M0rоn") == T.fold("moron") and T.fold("1D10T").strip() == T.fold("idiot").strip()
    assert T.fold("ｍｏｒｏｎ") == T.fold("moron") == T.fold("mo​ron")
    m = T.Model({" trash ": 3.0}, ("trash can",), (-2.0, 1.0, 1.0, 1.0, 1.0))
    a = m.automaton()
    assert m.features(a, "put it in the trash can now")[3] == 0.0
    assert m.features(a, "you are trash. trash can")[3] == 1.0
    assert m.features(a, "trash")[0] > m.features(a, "trash" + " word" * 500)[0]
