"""Further mentions of a text's names: bare, upper-case, possessive; nothing else changes."""

import re

from revlens.llm import surrogates as S


def run(spark, texts, **kw):
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    return {r.doc_id: (r.text, r.n_entities) for r in S.report(d, **kw).collect()}


def test_bare_upper_case_and_possessive_mentions(spark):
    got = run(spark, ["Mr. John Smith met Mary Jones. Later Smith left; JOHN SMITH and Jones's car, O'Neill. A smith stayed.",
                      "Later Smith left; JOHN SMITH stays.",
                      "Mrs. O'Brien's house. O'Brien and O'BRIEN wrote to O'Brien@mail.example.com.",
                      "Dr. Иван Петров. Петров и ПЕТРОВ, Иван."])
    m = re.fullmatch(r"Mr\. (\w+) (\w+) met (\w+) (\w+)\. Later (\w+) left; (\w+) (\w+) and (\w+)'s car, O'Neill\. A smith stayed\.", got[0][0])
    given, sur, _, other, later, up_given, up_sur, owner = m.groups()
    assert later == sur != "Smith" and (up_given, up_sur) == (given.upper(), sur.upper()) and given in S.GIVEN["latin", "m"]
    assert owner == other != "Jones" and other != sur and got[0][1] == 6
    assert got[1] == ("Later Smith left; JOHN SMITH stays.", 0)  # a text without names of its own
    m = re.fullmatch(r"Mrs\. (\w+)'s house\. (\w+) and (\w+) wrote to O'(\w+)@\w+\.\w+\.com\.", got[2][0])
    assert m[1] == m[2] == m[3].title() and m[3].isupper() and m[4] != "Brien" and got[2][1] == 4
    m = re.fullmatch(r"Dr\. (\w+) (\w+)\. (\w+) и (\w+), (\w+)\.", got[3][0])
    assert m[2] == m[3] != "Петров" and m[4] == m[2].upper() and m[5] == m[1] and got[3][1] == 4


def test_entities_inside_joined_words_are_still_found(spark):
    got = run(spark, ["Mr. Lee, X-John Smith and O'Anna Miller; X-DE89 3704 0044 0532 0130 00; Lee."])
    assert not re.search("Smith|Miller|Lee|0440", got[0][0]) and "X-" in got[0][0] and got[0][1] == 5


def test_repeats_ties_and_long_texts(spark):
    long = "Mr. Smith. " + "Smith Word " * 60_000 + "A" * 300_000 + "'A" * 100_000
    got = run(spark, [long, "Mr. Smith", "Mr. Smith", ""])
    new = got[1][0].split()[1]
    assert got[1] == got[2] == (f"Mr. {new}", 1) and got[3] == ("", 0)
    assert got[0][0] == long.replace("Smith", new) and got[0][1] == 60_001


def test_key_comes_from_the_setting(spark):
    text = ["Mr. Smith"]
    assert run(spark, text) == run(spark, text, key=S.KEY)
    spark.conf.set(S.KEY_SETTING, "other key")
    try:
        assert run(spark, text) == run(spark, text, key="other key") != run(spark, text, key=S.KEY)
    finally:
        spark.conf.unset(S.KEY_SETTING)
