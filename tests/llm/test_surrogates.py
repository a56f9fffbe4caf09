import re

from revlens.llm import surrogates as S

TEXTS = {
    1: "Write to anna.34@mail7.example.com, or ANNA.34@mail7.example.com! Not to bob.35@mail7.example.com.",
    2: "call +1 (017) 555-7713 or +1-017-555-7713 or (212) 555-0100, host 10.1.255.7 x 97.51.17.173",
    3: "card 4111111111111111 and 4111 1111 1111 1111; 7536784127813050 4845168114407329 SSN 078-05-1120 DE89 3704 0044 0532 0130 00",
    4: "Mr. John Smith met Mrs Smith and Dr. Karen Miller. Frau Müller. Г-н Иван Петров. Mary Jones.",
    5: "none here 1.2.3 and 12345, a@b", 6: "", 7: None, 8: "é.90@mail2.example.com\nпочта@пример.рф $1 \\2", 9: "1.1.1.1 2.2.2.2 3.3.3.3 1.1.1.1",
}


def run(spark, texts):
    d = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], "doc_id long, text string, entities string").repartition(3)
    out = S.replace(d, "k1", "n")
    assert out.columns == ["doc_id", "text", "entities", "n"]
    return {r.doc_id: (r.text, r.n) for r in out.collect()}


def test_formats_coreference_and_distinctness(spark):
    got = run(spark, TEXTS)
    assert [got[i] for i in (5, 6, 7)] == [(TEXTS[5], 0), ("", 0), (None, 0)]
    a, b, c = re.findall(r"[\w.]+@[\w.]+\.com", got[1][0])
    assert a == b.lower() and b.split("@")[0].isupper() and a != c and not {"anna.34", "bob.35"} & {a.split("@")[0], c.split("@")[0]}
    assert re.fullmatch(r"Write to [a-z]{4}\.\d\d@[a-z]{4}\d\.[a-z]{7}\.com, or [A-Z]{4}\.\d\d@.*! Not to [a-z]{3}\.\d\d@.*\.com\.", got[1][0])
    m = re.fullmatch(r"call \+1 (\(\d{3}\) \d{3}-\d{4}) or \+1-(\d{3}-\d{3}-\d{4}) or \(\d{3}\) \d{3}-\d{4}, host (\S+) x (\S+)", got[2][0])
    assert re.sub(r"\D", "", m[1]) == re.sub(r"\D", "", m[2]) != "0175557713"
    assert all(0 <= int(o) <= 255 for h in m.groups()[2:] for o in h.split(".")) and m[3] != "10.1.255.7"
    m = re.fullmatch(r"card (4\d{15}) and (4\d{3} \d{4} \d{4} \d{4}); (7\d{15}) (4\d{15}) SSN (\d{3}-\d{2}-\d{4}) (DE\d\d \d{4} \d{4} \d{4} \d{4} \d\d)", got[3][0])
    assert m[1] == m[2].replace(" ", "") != "4111111111111111" and len({m[1], m[3], m[4]}) == 3

    def luhn(s):
        return sum(sum(divmod(int(d) * (1 + k % 2), 10)) for k, d in enumerate(reversed(s))) % 10
    assert luhn(m[1]) == 0
    assert got[4][1] == 5 or got[4][1] == 6
    m = re.match(r"Mr\. (\w+) (\w+) met Mrs (\w+) and Dr\. (\w+) (\w+)\. Frau (\w+)\. Г-н (\w+) (\w+)\. (\w+) (\w+)\.", got[4][0])
    assert m[2] == m[3] != "Smith" and m[1] in S.GIVEN["latin", "m"] and m[4] in S.GIVEN["latin", "f"] and m[9] in S.GIVEN["latin", "f"]
    assert m[7] in S.GIVEN["cyrillic", "m"] and re.fullmatch("[А-Яа-яё]+ов", m[8]) and len({m[2], m[5], m[6], m[10]}) == 4
    assert re.fullmatch(r"[a-z]\.\d\d@[a-z]{4}\d\.[a-z]{7}\.com\n[а-я]{5}@[а-я]{6}\.рф \$1 \\2", got[8][0])
    x = got[9][0].split()
    assert x[0] == x[3] and len(set(x)) == 3 and not set(x) & set(TEXTS[9].split())
    assert run(spark, TEXTS) == got


def test_collisions_are_drawn_again(spark):
    # all addresses of one shape: with 9 * 9 * 9 * 9 values for 3000 entities the first draws collide
    ips = [f"{a}.{b}.{c}.{d}" for a in range(1, 8) for b in range(1, 8) for c in range(1, 9) for d in range(1, 8)]
    d = spark.createDataFrame([(i, f"x {ip} y") for i, ip in enumerate(ips)], "doc_id long, text string")
    new = [r.text.split()[1] for r in S.report(d).collect()]
    assert len(set(new)) == len(ips) and not set(new) & set(ips)


def test_no_python_on_the_executors(spark):
    d = spark.createDataFrame([(1, TEXTS[1]), (None, TEXTS[2]), (1, TEXTS[1])], "doc_id long, text string")
    out = S.report(d)
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    assert out.count() == 3 and S.report(d.limit(0)).count() == 0
