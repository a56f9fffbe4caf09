import hashlib
import random
import re

from revlens.llm import secret_scan as S

K = "f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda"
TEXTS = [
    f'token = "{K}" and', f"Password: hunter2hunter2\npassword:short", "API_KEY='abcd1234EFGH' apikey=zzzzzzzz,", "AKIAABCDEFGHIJKL AKIA12", f"x{K}{K} 0123",
    "é\U0001F600 secret   =   q1w2e3r4t5", "token token: token: abcdefgh", "", "nothing here = at all", "ſecret=abcdefgh1", "K" * 9000 + " passwd:12345678",
]


def plain(text):
    """The contract, word by word."""
    out = []
    pat = "(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
    pat = "".join(f"[{c}{c.upper()}]" if c.isalpha() and c.islower() and i < pat.index(")") else c for i, c in enumerate(pat))
    for m in re.finditer(pat, text or ""):
        if len(m.group(2)) >= 8:
            out.append((m.start(), 0, f"assign:{m.start()}:{m.end()}"))
    for k, (name, p, least) in enumerate([("access", "AKIA[A-Z0-9]+", 16), ("hex", "[0-9a-f]+", 32)]):
        out += [(m.start(), k + 1, f"{name}:{m.start()}:{m.end()}") for m in re.finditer(p, text or "") if len(m.group()) >= least]
    return [s for *_, s in sorted(out)]


def test_base_against_plain_patterns(spark):
    r = random.Random(3)
    bits = ["password", "Token", "api_key", "apikey", "=", ": ", "'", '"', K, K[:31], "AKIA", "ABCDEF0123456789", "abcdefgh", " ", "\n", "é", "x"]
    rows = list(enumerate(TEXTS + ["".join(r.choice(bits) for _ in range(r.randint(0, 14))) for _ in range(300)])) + [(999, None), (0, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'a' as spans")
    got = sorted((x.doc_id, x.n_assign, x.n_access, x.n_hex, x.base_sha256) for x in S.report(d).collect())
    want = []
    for i, t in rows:
        p = plain(t)
        n = [sum(s.startswith(k) for s in p) for k in ("assign", "access", "hex")]
        want.append((i, *n, hashlib.sha256(",".join(p).encode()).hexdigest()))
    assert got == sorted(want)
    assert S.report(d.limit(0)).count() == 0


def found(text):
    return [(text[a:b], name) for a, b, name, _ in S.lexed(text)]


def test_assignments_of_many_syntaxes():
    v = "Zx9$kQ2!mW7pL4"
    w = "Zx9kQ2mW7pL4vB"
    for text in (f'db_password = "{v}"', f"const apiKey = '{v}';", f'{{"client_secret": "{v}", "a": 1}}', f"  accessToken: {w}", f"export DB_PASSWD={w}",
                 f'cfg["password"] = "{v}"', f"<password>{v}</password>", f'<add key="api_key" value="{v}"/>', f'"Authorization": "Bearer {w}"',
                 f'pw_secret := "{v}"', f'secret = os.getenv("S", "{v}")', f'$token = "{v}" # {w}'):
        assert [f[0] for f in found(text)] in ([v], [w]), text


def test_constants_propagate_to_their_literal():
    a, b = "Zx9kQ2mW7p", "L4vBn8Tr"
    assert found(f'A = "{a}"\nB = A\npassword = B') == [(a, "password")]
    assert found(f'A = "{a}"\npassword = A + "{b}"') == [(a, "password"), (b, "password")]
    assert found(f'KEY={a}{b}\nAPI_TOKEN="${{KEY}}"') == [(a + b, "API_TOKEN")]
    assert found(f'A = "{a}{b}"\nlabel = A') == []
    assert found("password = password\nsecret = token\ntoken = secret") == []


def test_harmless_values_stay():
    for text in ('password = "changeme"', "password: <your password>", "token_url = 'Zx9kQ2mW7pL4'", 'name = "Zx9kQ2mW7pL4vB"', "secret: x", "the token: a word",
                 'password = "${DB_PASSWORD}"', "password_length = 123456789", "=" * 5000, "a:" * 5000):
        assert found(text) == [], text
