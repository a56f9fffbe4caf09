import random
import sys

import pytest

import corpus_pipeline as CP
from revlens.llm import pieces as pc
from revlens.llm import bpe_exact
from revlens.llm.queries import QUERIES, piece_model

sys.path.insert(0, __file__.rsplit("/", 1)[0])
import test_decontaminate as TD  # noqa: E402
import test_minhash_tensor as TM  # noqa: E402


def corpus():
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    item = " ".join(word() for _ in range(14))
    docs, labels = [], []
    for i in range(150):
        w = [word() for _ in range(r.randint(30, 60))]
        if i % 5 == 0:
            w[3], w[9] = "moron", "scumbag"
        docs.append((i, " ".join(w), "en", f"s{i % 3}", 0))
        labels.append((i, 1, int(i % 5 == 0)))
    clean = [t for i, t, *_ in docs if i % 5]
    docs += [(200, clean[0], "en", "s", 1), (201, clean[1].rsplit(" ", 1)[0] + " other", "en", "s", 1), (202, clean[2] + " " + item + ". end", "en", "s", 1), (203, item, "en", "s", 1),
             (204, " ".join(word() for _ in range(40)) + " write me: anna.34@mail7.example.com", "en", "s", 1), (205, None, None, None, None), (206, "", "en", "s", 0)]
    return docs, labels, [(1, item)]


def test_stages_against_brute_force(spark, tmp_path):
    docs, labels, items = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [n for n, _ in CP.STAGES] == ["toxicity", "near_duplicates", "decontamination", "pii", "sentencepiece"]
    got, docs_ = {}, d
    for k, (name, stage) in enumerate(CP.STAGES):
        docs_ = stage(spark, docs_, str(tmp_path))
        if k < 4:
            assert docs_.columns == d.columns
        docs_.write.parquet(f"{tmp_path}/out{k}")
        docs_ = spark.read.parquet(f"{tmp_path}/out{k}")
        got[name] = docs_.collect()
    toxic = {i for i, _, t in labels if t}
    text = {i: t for i, t, *_ in docs}
    assert {r.doc_id for r in got["toxicity"]} == set(text) - toxic
    left = [(i, t) for i, t in text.items() if i not in toxic]
    alive = {i for i, n, c, kept in TM.brute(left, 5) if kept}
    assert {r.doc_id for r in got["near_duplicates"]} == alive and not {200, 201} & alive
    hits = TD.brute([(i, text[i]) for i in alive], items)
    assert {r.doc_id for r in got["decontamination"]} == {i for i, (n, hit, *_) in hits.items() if hit <= n / 2}
    after = {r.doc_id: r.text for r in got["decontamination"]}
    assert all(after[i] == text[i] for i in after if not hits[i][1]) and 202 in after and not TD.brute([(202, after[202])], items)[202][1]
    pii = {r.doc_id: r.text for r in got["pii"]}
    assert pii.keys() == after.keys() and {i for i in pii if pii[i] != after[i]} == {204} and "anna.34" not in pii[204]
    e = bpe_exact.Encoder(pc.load(piece_model()))
    assert {r.doc_id: e.decode(list(r.ids)) for r in got["sentencepiece"]} == {i: t or "" for i, t in pii.items()}
    end = CP.run(spark, str(tmp_path))
    assert sorted(map(str, end.collect())) == sorted(map(str, got["sentencepiece"]))


def test_empty_documents(spark, tmp_path):
    docs, labels, items = corpus()
    d = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in CP.STAGES:
        assert stage(spark, d, str(tmp_path)).count() == 0


def test_registered():
    import __spark_entry__ as E
    names = set(E.queries())
    assert {"pipeline"} <= names and {f"op{n}_" for n in range(1, 14)} == {q[:q.index("_") + 1] for q in QUERIES} and set(QUERIES) <= names


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_run_over_whole_tables(spark, sf_small, name):
    rows = QUERIES[name](spark, sf_small)
    table, key = {"op11_conversation_repair": ("conversations", ["conv_id"]), "op13_part_codes": ("embeddings", None)}.get(name, ("documents", None))
    assert rows.count() == (lambda t: t.dropDuplicates(key) if key else t)(spark.read.parquet(f"{sf_small}/{table}.parquet")).count()
