import hashlib
import random
import struct

import pytest

tokenizers = pytest.importorskip("tokenizers")
import public_tokenizers as P  # noqa: E402

from revlens.llm import byte_bpe as B  # noqa: E402

PATH = P.path("byte_bpe_50k.json")
ODD = ["", "a", " ", "  ", "a  b", " \n\t x", "it's 'll 'S we've", "<|endoftext|>", "a<|endoftext|> b<|endoftext|><|endoftext|", "日本 \U0001F600é́",
       "\x00\x1c\x85\xa0  　x", "²٣Ⅷ½ 12a3", "Ᲊ՘a \U000323b0b1", "the" * 60, "ab" * 200, " " * 300 + "x", "x" * 3000, "中文" * 700]


@pytest.fixture(scope="module")
def lib():
    t = tokenizers.Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def noise(n, seed=3):
    r = random.Random(seed)
    some = ["the", " and", "ing", "'ll", "  ", "\n", "<|endoftext|>", "é", "中", "123", "!?", "\t"]
    for _ in range(n):
        yield "".join(r.choice([*some, chr(r.choice([r.randrange(0xD800), r.randrange(0xE000, 0x110000)]))]) for _ in range(r.randrange(40)))


def test_report_equals_the_library(spark, lib):
    rows = list(enumerate([*ODD, *noise(400)])) + [(9999, None), (None, "null id"), (0, ""), (0, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as _ids", "2 as n_tokens", "3 as ids_sha256")
    got = sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in B.report(d, PATH).collect()), key=str)
    want = []
    for i, t in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(),
                     hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert B.report(d.limit(0), PATH).count() == 0


def test_encode_and_decode_frames(spark, lib):
    d = spark.createDataFrame([(i, t) for i, t in enumerate([*ODD, None])], "k int, text string")
    both = B.decode(B.encode(d, PATH), PATH).collect()
    assert all(r._ids == lib.encode(r.text or "", add_special_tokens=False).ids and r._decoded == (r.text or "") for r in both)


def test_decode_of_parts_of_characters(spark, lib):
    e = B.encoder(B.load(PATH))
    r = random.Random(2)
    for _ in range(300):
        ids = [r.randrange(50257) for _ in range(r.randrange(8))]
        assert e.decode(ids) == lib.decode(ids, skip_special_tokens=False)


def test_short_and_long_words_merge_alike():
    e = B.encoder(B.load(PATH))
    r = random.Random(7)
    for _ in range(300):
        w = "".join(r.choice(["a", "b", "the", "er", "é", "z"]) for _ in range(r.randrange(1, 40))).encode()
        assert e.short(w) == e.long(w)


def test_a_long_word_is_linear_and_whole(lib):
    word = "".join(random.Random(1).choice("abcdeth") for _ in range(200_000))
    e = B.encoder(B.load(PATH))
    assert e.encode(word) == struct.pack(f"<{len(ids := lib.encode(word, add_special_tokens=False).ids)}I", *ids)


def test_cache_is_bounded_by_bytes():
    cache = B.WordCache(lambda w: b"\0" * 8, limit=10_000)
    for k in range(1000):
        assert cache[str(k)] == b"\0" * 8 and len(cache) + len(cache.older) <= 50
    cache["x" * (B.SHORT + 1)]
    assert "x" * (B.SHORT + 1) not in cache


def test_every_letter_class_is_the_librarys(lib):
    e = B.encoder(B.load(PATH))
    split = lib.pre_tokenizer.pre_tokenize_str
    for i in range(0x80, 0x110000):
        if not 0xD800 <= i < 0xE000 and (i < 0x3000 or i % 7 == 0 or i > 0x323AF):
            s = f"a{chr(i)}1{chr(i)}.{chr(i)}{chr(i)}b"
            assert len(e.split(s)) == len(split(s)), hex(i)


def test_other_kinds_of_vocabulary_raise():
    with pytest.raises(ValueError):
        B.load(P.path("word_bpe_49k.json"))
