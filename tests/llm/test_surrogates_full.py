"""Formats with fewer values than entities."""

import re
from itertools import product
from string import ascii_lowercase

from revlens.llm import surrogates as S


def test_all_short_addresses_and_numbers_of_one_shape(spark):
    mails = [f"{a}@{b}.co" for a, b in product(ascii_lowercase, ascii_lowercase[:14])]  # 364 of 676
    d = spark.createDataFrame([(i, f"x {m} y") for i, m in enumerate(mails)], "doc_id long, text string")
    new = [r.text.split()[1] for r in S.report(d).collect()]
    assert len(set(new)) == len(mails) and not set(new) & set(mails)
    assert all(re.fullmatch(r"[a-z]+@[a-z]\.co", n) for n in new)


def test_longer_numbers_are_rendered_whole(spark):
    c = spark.createDataFrame([("phone", "12345", "+1 23 45"), ("card", "4111111111111111", "4111 1111 1111 1111"), ("ssn", "078051120", "078-05-1120")],
                              "kind string, canon string, entity string").selectExpr("*", "'' as gender")
    for attempt, more in ((S.LONGER - 1, 0), (S.LONGER, 1), (S.LONGER + 3, 4)):
        out = c.withColumn("s", S.candidate(c["kind"], c["canon"], c["gender"], "k", attempt))
        for r in out.withColumn("new", S.render(out["kind"], out["entity"], out["s"])).collect():
            assert len(r.s) == len(r.canon) + more and re.sub(r"\D", "", r.new) == r.s, r
            if r.kind == "card":
                assert sum(sum(divmod(int(x) * (1 + k % 2), 10)) for k, x in enumerate(reversed(r.s))) % 10 == 0
