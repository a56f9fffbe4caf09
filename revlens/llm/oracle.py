"""DuckDB SQL of the corpus queries that SQL can express, written apart from the operators.

``REPAIR_SQL`` walks each conversation row by row and holds, for each state of
the role pattern, the least (cost, audit) and the repaired text; ``CODES_SQL``
unrolls the six rounds and compares every part with every entry.
"""

from __future__ import annotations


def _step(frm: str, cost: str, edit: str, text: str = "''") -> str:
    return f"{{'c': {frm}.c + {cost}, 'a': {frm}.a || '{edit}', 't': {frm}.t || {text}}}"


def _least(*options: str) -> str:
    """The least of the options that exist (a struct of nulls does not)."""
    return f"list_min(list_filter([{', '.join(options)}], lambda x: x.c IS NOT NULL))"


_NL = "chr(10)"
_NONE = "{'c': CAST(NULL AS BIGINT), 'a': CAST(NULL AS VARCHAR), 't': CAST(NULL AS VARCHAR)}"
_INSERTED = f"""
  SELECT *, {_least("s3", _step("u", 5, "I", f"'assistant:' || {_NL}"))} AS a
  FROM (SELECT *, {_least("s2", *(_step(s, 5, "I", f"'user:' || {_NL}") for s in ("s0", "s1", "s3")))} AS u FROM FRAME)"""


def _when(test: str, option: str) -> str:
    return f"CASE WHEN {test} THEN {option} ELSE {_NONE} END"


def _row_edits(own: str, name: str, sources: tuple[str, ...]) -> list[str]:
    keep = f"role || ':' || text || {_NL}"
    out = []
    for s in sources:
        out.append(_when(f"NOT must AND ini = '{own}'", _step(s, "cut", "K", keep)))
        if name:
            out.append(_when("NOT must", _step(s, "cut + 1", "R", f"'{name}:' || text || {_NL}")))
    return out


REPAIR_SQL = f"""
WITH RECURSIVE
bits AS (SELECT list(v ORDER BY n) AS t FROM (SELECT n, list_reduce(range(8), lambda v, k: CASE WHEN v & 1 = 1 THEN xor(3988292384, v >> 1)
  ELSE v >> 1 END, n) AS v FROM range(256) r(n))),
keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
kinds AS (SELECT keyed.*, xor(4294967295, list_reduce(list_transform(string_split(k, ''), lambda c: CAST(ord(c) AS BIGINT)),
  lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8), CAST(4294967295 AS BIGINT))) % 20 AS kind FROM keyed, bits),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, 1 AS copy FROM kinds WHERE kind <> 0
  UNION ALL SELECT conv_id, turn, role, text, 2 FROM kinds WHERE kind = 3),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
  row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen,
  regexp_extract(text, '([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*$', 1) AS fin, left(role, 1) AS ini FROM damaged),
flagged AS (SELECT *, fin = '' AS blank, fin <> '' AND seen > 1 AS dup, fin <> '' AND seen = 1 AND fin NOT IN ('.', '!', '?') AS trunc,
  lag(ini) OVER (PARTITION BY conv_id ORDER BY i) AS prior FROM placed),
rows_ AS (SELECT *, blank OR dup AS must, CASE WHEN trunc THEN 5 ELSE 0 END AS cut FROM flagged),
counted AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
  count(*) FILTER (dup) AS duplicate, count(*) FILTER (trunc) AS truncated,
  count(*) FILTER (prior IS NOT NULL AND prior || ini NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM rows_ GROUP BY conv_id),
walk AS (
  SELECT conv_id, 0 AS i, {{'c': CAST(0 AS BIGINT), 'a': '', 't': ''}} AS s0, {_NONE} AS s1, {_NONE} AS s2, {_NONE} AS s3 FROM counted
  UNION ALL
  SELECT conv_id, nxt AS i, {_step("s0", 2, "D")}, {_least(_step("s1", 2, "D"), *_row_edits("s", "", ("s0",)))},
    {_least(_step("u", 2, "D"), *_row_edits("u", "user", ("s0", "s1", "a")))},
    {_least(_step("a", 2, "D"), *_row_edits("a", "assistant", ("u",)))}
  FROM ({_INSERTED.replace("FRAME", "(SELECT w.*, r.i AS nxt, r.must, r.cut, r.ini, r.role, r.text FROM walk w JOIN rows_ r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i + 1)")})),
done AS (SELECT conv_id, {_least("s0", "a")} AS best FROM ({_INSERTED.replace("FRAME", "(SELECT w.* FROM walk w JOIN counted c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.n = w.i)")}))
SELECT o.conv_id, coalesce(c.gaps, 0) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate, coalesce(c.truncated, 0) AS truncated,
  coalesce(c.illegal, 0) AS illegal, coalesce(d.best.c, 0) AS cost, coalesce(d.best.a, '') AS audit,
  sha256(CASE WHEN coalesce(d.best.t, '') = '' THEN '' ELSE left(d.best.t, length(d.best.t) - 1) END) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN done d ON d.conv_id IS NOT DISTINCT FROM o.conv_id
"""


def _codes() -> str:
    steps = ["""whole AS (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) = len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))))""",
             """parts AS (SELECT r, p, v[p * (len(v) // 8) + 1:(p + 1) * (len(v) // 8)] AS x FROM whole, range(8) g(p))""",
             """book0 AS (SELECT p, e, x AS y FROM parts JOIN (SELECT r, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM whole QUALIFY e < 16) USING (r))"""]
    for k in range(7):
        steps.append(f"""near{k} AS (SELECT r, p, min({{'d': list_sum(list_transform(list_zip(x, y), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 'e': e}}) AS m
  FROM parts JOIN book{k} USING (p) GROUP BY r, p)""")
        if k < 6:
            steps.append(f"""book{k + 1} AS (SELECT b.p, b.e, coalesce(f.y, b.y) AS y FROM book{k} b LEFT JOIN (
  SELECT p, e, list(CAST(floor(s / n) AS BIGINT) ORDER BY j) AS y FROM (SELECT p, m.e AS e, j, sum(x[j]) AS s, count(*) AS n
    FROM near{k} JOIN parts USING (r, p), range(1, 65) g(j) WHERE j <= len(x) GROUP BY 1, 2, 3) GROUP BY 1, 2) f USING (p, e))""")
    return "WITH " + ",\n".join(steps) + """,
coded AS (SELECT r, string_agg(printf('%02x', m.e), '' ORDER BY p) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM near6 GROUP BY r),
digest AS (SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book6)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM whole JOIN coded USING (r), digest
"""


CODES_SQL = _codes()
