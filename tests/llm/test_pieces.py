import hashlib
import random

import pytest

sentencepiece = pytest.importorskip("sentencepiece")
import public_tokenizers as P  # noqa: E402

from revlens.llm import bpe_exact as X  # noqa: E402
from revlens.llm import pieces as pc  # noqa: E402
from revlens.llm import token_counts as T  # noqa: E402

PATH = P.path("piece_bpe_32k.model")
ODD = ["", "a", " ", "  ", "   a", "  a  b", "a\nb", "\n", "\n\n a", " \n ", "a \n b\n", "\x00x", "▁a ▁", "日本 \U0001F600", "é́", "<s> </s><unk>", "<0x41>",
       "a　b\xa0c", " " * 33 + "x", "the" * 60, "ab" * 200, "�", "x" * 3000]


@pytest.fixture(scope="module")
def sp():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def texts(n, seed=5):
    r = random.Random(seed)
    e = list(pc.vocabulary(pc.load(PATH)).ids)
    return [" ".join("".join(r.choice(e).replace("▁", "") for _ in range(r.randint(1, 3))) + r.choice(["", "\n", ".", "  ", "\U0001F600"])
                     for _ in range(r.randint(0, 30))) for _ in range(n)]


def test_encoding_equals_the_library(spark, sp):
    rows = list(enumerate(ODD + texts(300))) + [(9999, None), (0, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as _ids", "2 as n_tokens")
    got = sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in X.report(d, PATH).collect())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    ids = [(i, sp.encode(t or "")) for i, t in rows]
    assert got == sorted((i, len(x), sha(",".join(map(str, x))), sha(sp.decode(x))) for i, x in ids)
    assert X.report(d.limit(0), PATH).count() == 0
    assert {r.doc_id: list(r.ids) for r in X.token_rows(d, PATH).collect()} == dict(ids)


def brute(v, text):
    """Best segmentation of a whole text by plain dynamic programming."""
    worst = min(v.scores[i] for i in v.ids.values()) - 10
    s = pc.MARK + text.replace(" ", pc.MARK) if text else ""
    best = [(0.0, 0)] + [None] * len(s)
    for e in range(1, len(s) + 1):
        options = [(best[b][0] + v.scores[v.ids[s[b:e]]], best[b][1] + 1, b) for b in range(max(0, e - 20), e) if s[b:e] in v.ids]
        if s[e - 1] not in v.ids:
            options.append((best[e - 1][0] + worst, best[e - 1][1] + len(s[e - 1].encode()), e - 1))
        top = max(options, key=lambda o: (o[0], -o[2]))
        best[e] = top[:2]
    return best[-1]


def test_counts_against_brute_force_and_library(spark, sp, monkeypatch):
    rows = list(enumerate(ODD + texts(80, 6))) + [(9999, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as score")
    v = pc.vocabulary(pc.load(PATH))
    got = {r.doc_id: (r.score, r.n_tokens) for r in T.count(d, PATH).collect()}
    assert got == {i: brute(v, t or "") for i, t in rows}
    # the library, told that the same pieces and scores are a unigram model
    from sentencepiece import sentencepiece_model_pb2 as pb
    m = pb.ModelProto()
    m.ParseFromString(pc.load(PATH))
    m.trainer_spec.model_type = 1
    uni = sentencepiece.SentencePieceProcessor(model_proto=m.SerializeToString())
    for i, t in rows:
        if t and "  " not in t and len(t) < 200 and t.isascii() and t.isprintable():
            assert got[i][1] == len(uni.encode(t)), t


def test_small_trie_gives_the_same(monkeypatch):
    model = pc.load(PATH)
    words = [w for t in texts(40, 7) for w in pc.pretokens(t)]
    whole = T.Trie(model).values(words)
    monkeypatch.setattr(T, "NODES", 50)
    assert T.Trie(model).values(words) == whole


def test_cache_is_bounded():
    c = pc.Cache(len, 10)
    assert c.all([str(k) for k in range(100)]) == [len(str(k)) for k in range(100)]
    assert len(c.new) <= 10 and len(c.old) <= 10
