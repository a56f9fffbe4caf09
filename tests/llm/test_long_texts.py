"""Texts that are one very long run: linear work and bounded memory."""

import random
import time
import tracemalloc

import pytest

from revlens.llm import secret_scan as S
from revlens.llm import surrogates as U

N = 200_000


@pytest.mark.parametrize("text", ["x@" + "a." * N + "com", "a" * N + "@b.com", "x@" + "a" * N + ".com", "1" * N, "Mr. " + "A" * N, "A" * N, "-" * N, "Mr " * N,
                                  "x@a." * N, "1.1." * N, "+1 " * N, "1234 " * N, "AB12 " * N, "Anna " * N, "Mr. " + "Ab-" * N])
def test_surrogates_of_long_runs(spark, text):
    d = spark.createDataFrame([(1, text), (2, "Mail to anna.b@mail.example.com now")], "doc_id long, text string")
    out = {r.doc_id: r.text for r in U.replace(d).collect()}
    assert "anna.b@" not in out[2] and len(out[1]) >= len(text) // 2


def test_address_limits(spark):
    good = ["a@b.co", "x.y@1.b.com", "u@" + "a." * 29 + "com", "a" * 64 + "@b.org", "x@foo.com.", "x@b.co.1"]
    bad = ["a" * 65 + "@b.org", "a@b", "a@b.c"]
    d = spark.createDataFrame(list(enumerate(good + bad)), "doc_id long, text string")
    found = {r.doc_id: r.n_entities for r in U.report(d).collect()}
    assert [found[i] for i in range(len(good + bad))] == [1] * len(good) + [0] * len(bad)


def old_property(text):
    import re
    return [(m.group(1), m.group(2), m.span(2)) for m in
            re.finditer(r"""<[^<>\n]*?\b(?:key|name)="([\w.-]+)"[^<>\n]*?\bvalue="([^"\n]+)\"""", text)]


def test_properties_are_the_patterns_matches():
    r = random.Random(1)
    bits = ['<', '>', ' ', 'key="a"', 'name="b.c"', 'value="x"', 'value="', 'value=""', 'xvalue="q"', 'key="!"', '\n', 'add', '"', 'value="a<b>c"']
    for _ in range(3000):
        text = "".join(r.choice(bits) + r.choice(["", " "]) for _ in range(r.randrange(14)))
        assert [(p.name, p.parts[0][1], p.parts[0][2:]) for p in S._properties(text)] == old_property(text), text


def test_one_long_line_of_properties():
    start = time.time()
    S.lexed("<add " + 'key="a" ' * 125_000 + ' secret\n<x value="y"')
    assert time.time() - start < 5


def test_a_long_word_is_counted_without_nodes():
    P = pytest.importorskip("public_tokenizers")
    from revlens.llm import pieces as pc
    from revlens.llm import token_counts as T
    t = T.Trie(pc.load(P.path("piece_bpe_32k.model")))
    r = random.Random(4)
    for _ in range(30):
        w = "".join(r.choice(["the", "a", "中", "é", "\U0001F600", "ing", "z"]) for _ in range(r.randrange(1, 80)))
        node = t.insert(pc.marked(w))
        assert t.rolled(pc.marked(w)) == (t.count[node], t.score[node])
    before = len(t.score)
    word = "中文z" * 100_000
    tracemalloc.start()
    t.values([word])
    assert tracemalloc.get_traced_memory()[1] < 20 << 20 and len(t.score) == before
    tracemalloc.stop()
