"""Secrets in source code and configuration, by assignment-aware lexing.

Base patterns give the kinds ``assign``, ``access`` and ``hex``. The lexer adds
``lexed`` spans: around every ``=``, ``:``, ``:=`` and ``=>`` (and XML elements
and attributes) it reads a target name and a value expression of string
literals, bare literals, names and ``+`` joins. The name-literal pairs of a
document form an environment through which constants propagate: a name, a
``$NAME``, ``${NAME}`` or a join is replaced by the literals it stands for:
those of its last binding before, else of its first one after. Names are bound
as written, dotted and hyphenated ones too, without a leading ``$``; values are
kept as references, so no length is cut. A literal is scored by the sensitivity of
the target name it reaches and by its own look (length, entropy, character
classes, placeholders); literals that reach ``THRESHOLD`` become spans.

Offsets are code points, ends exclusive. An ``assign`` span is the whole match
from the name on. Spans are sorted by start, then kind in the order above.

Scale: one ``mapInArrow``, no shuffle; byte-level tests skip the lexer for
texts without a sensitive name. Only sensitive names are resolved; the work is
linear in a document's length and the literals that these reach.

Defined cases: null and empty texts have no spans; a name in its own value is
text; a cycle of names stands for nothing; repeated documents: row by row.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.llm.frames import texts

KINDS = ("assign", "access", "hex", "lexed")
THRESHOLD = 0.6

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
_HEX_RUN = bytes(120 if chr(i) in "0123456789abcdef" else 32 for i in range(256))

#: sensitivity of name parts; the most sensitive part of a target name counts
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "pass": 0.7, "secret": 1.0, "token": 0.9, "apikey": 1.0, "api_key": 1.0,
    "accesskey": 1.0, "access_key": 1.0, "privatekey": 1.0, "private_key": 1.0, "secretkey": 1.0, "credential": 0.9, "credentials": 0.9,
    "auth": 0.6, "authorization": 0.8, "bearer": 0.9, "signingkey": 0.9, "signing_key": 0.9, "encryption_key": 1.0, "encryptionkey": 1.0,
    "connectionstring": 0.8, "connection_string": 0.8, "dsn": 0.7, "webhook": 0.6, "salt": 0.6,
}
#: parts that say the value is about a secret, not one
HARMLESS = {"url", "uri", "file", "path", "name", "id", "type", "length", "len", "count", "expires", "ttl", "field", "label", "policy", "hint", "public"}
PLACEHOLDER = re.compile(r"(?i)^(?:change_?me|example|sample|dummy|placeholder|your[-_ ]?.*|x{3,}|\*+|\.{3,}|none|null|nil|true|false|undefined|todo|test|default|redacted|<.*>|\$\{.*\}|%.*%)$")
_GATE = ("pass", "pwd", "secret", "token", "key", "cred", "auth", "bearer", "connection", "dsn", "webhook", "salt")

_OPERATOR = re.compile(r":=|=>|(?<![=!<>:+*/%&|^-])=(?![=~])|:(?![:/=])")
_NAME_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_.$-")
_TERM = re.compile(r"""[ \t]*(?:(?:[rbuf]|f?r|rb|@)?"((?:[^"\\\n]|\\.)*)"|[rbuf]?'((?:[^'\\\n]|\\.)*)'|`([^`\n]*)`|\$\{?([A-Za-z_]\w*(?:[.-]\w+)+(?=\})|[A-Za-z_]\w*)\}?|([A-Za-z0-9_+/.~-]+={0,2}))""")
_CALL_DEFAULT = re.compile(r"""[ \t]*(?:os\.)?(?:getenv|environ\.get|env|get_env|ENV\.fetch)\([^,()\n]*,[ \t]*(?="|')""")
_REFERENCE = re.compile(r"\$\{?([A-Za-z_]\w*(?:[.-]\w+)+(?=\})|[A-Za-z_]\w*)\}?|%([A-Za-z_]\w*)%|\{([A-Za-z_]\w*(?:[.-]\w+)*)\}")
_SCHEME = re.compile(r"(?i)(?:bearer|basic|token)[ \t]+")
_ELEMENT = re.compile(r"<([A-Za-z_][\w.-]*)>([^<>\n]{4,})</\1>")
_TAG = re.compile(r"<[^<>\n]*")
_KEY = re.compile(r"""\b(?:key|name)="([\w.-]+)\"""")
_OWN_VALUE = re.compile(r"""\bvalue="([^"\n]+)\"""")
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")


def sensitivity(name: str) -> float:
    parts = [p.lower() for p in _PARTS.findall(name)]
    if not parts or parts[-1] in HARMLESS:
        return 0.0
    joined = [*parts, *("_".join(p) for p in zip(parts, parts[1:]))]
    return max(SENSITIVE.get(p, 0.0) for p in joined)


def look(literal: str) -> float:
    """How much a literal looks like a secret, 0 to 1."""
    n = len(literal)
    if n < 6 or PLACEHOLDER.match(literal) or " " in literal.strip():
        return 0.0
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(literal).values())
    classes = sum(any(f(c) for c in literal) for f in (str.islower, str.isupper, str.isdigit, lambda c: not c.isalnum()))
    word = 0.3 if literal.isalpha() and literal.islower() else 0.0
    return min(1.0, 0.25 - word + 0.12 * classes + 0.09 * entropy + 0.01 * min(n, 20))


def score(name: str, literal: str) -> float:
    return sensitivity(name) * look(literal)


class Pair:
    """A target name and its value: parts are (kind, literal, start, end), or ('name', name, literal, start, end)
    for a name that may stand for something else ('bare': a literal that may be a name)."""

    __slots__ = ("name", "parts")

    def __init__(self, name: str, parts: list[tuple]):
        self.name, self.parts = name, parts


def _target(text: str, at: int) -> str:
    """The name that ends before position ``at``, quoted or not."""
    i = at
    while i and text[i - 1] in " \t":
        i -= 1
    if i and text[i - 1] in "\"']":
        i -= 1
        if i and text[i] == "]" and text[i - 1] in "\"'":
            i -= 1
    end = i
    while i and text[i - 1] in _NAME_CHARS:
        i -= 1
    return text[i:end].strip("-.")


def _value(text: str, at: int) -> list[tuple]:
    """The parts of the value expression at ``at``."""
    call = _CALL_DEFAULT.match(text, at)
    at = call.end() if call else at
    scheme = _SCHEME.match(text, at + (len(text[at:at + 1]) if text[at:at + 1] == " " else 0))
    at = scheme.end() if scheme else at
    parts: list[tuple] = []
    while True:
        m = _TERM.match(text, at)
        if not m:
            return parts
        k = m.lastindex
        start, end = m.span(k)
        body = m.group(k)
        if k in (1, 2, 3):
            inner = _SCHEME.match(body)
            skip = inner.end() if inner else 0
            left = skip
            for r in _REFERENCE.finditer(body, skip):
                if r.start() > left:
                    parts.append(("text", body[left:r.start()], start + left, start + r.start()))
                parts.append(("name", r.group(r.lastindex), r.group(), start + r.start(), start + r.end()))
                left = r.end()
            if left < len(body):
                parts.append(("text", body[left:], start + left, end))
        elif k == 4:
            parts.append(("name", body, body, start, end))
        else:
            parts.append(("bare", body, start, end))
        at = m.end()
        rest = at
        while text[rest:rest + 1] in (" ", "\t") and rest < len(text):
            rest += 1
        if text[rest:rest + 1] != "+":
            return parts
        at = rest + 1


def _properties(text: str) -> list[Pair]:
    """Tags with a key or name attribute and a later value: one scan forward, each tag once."""
    out, at = [], 0
    while True:
        tag = _TAG.search(text, at)
        if not tag:
            return out
        at = tag.end()
        key = _KEY.search(text, tag.start(), tag.end())
        start = text.find('value="', key.end(), tag.end()) if key else -1
        while start >= 0:
            value = _OWN_VALUE.match(text, start)
            if value and (start == 0 or not (text[start - 1].isalnum() or text[start - 1] == "_")):
                out.append(Pair(key.group(1), [("text", value.group(1), *value.span(1))]))
                at = value.end()
                break
            start = text.find('value="', start + 1, tag.end())


def pairs(text: str) -> list[Pair]:
    """All name-literal pairs of a text."""
    out = []
    for m in _OPERATOR.finditer(text):
        name = _target(text, m.start())
        if name:
            parts = _value(text, m.end())
            if parts:
                out.append(Pair(name, parts))
    if "</" in text:
        out += [Pair(m.group(1), [("text", m.group(2), *m.span(2))]) for m in _ELEMENT.finditer(text)]
    if "value=\"" in text:
        out += _properties(text)
    return out


def propagate(found: list[Pair]) -> Iterator[tuple[str, list[tuple]]]:
    """Each pair with a sensitive name, with names in its value replaced by the literals they stand for."""
    bound: dict[str, list[int]] = {}
    for i, p in enumerate(found):
        bound.setdefault(p.name.lstrip("$"), []).append(i)

    def own(i: int) -> list:
        """A pair's value: literals, and numbers of the pairs that its names are bound by."""
        out: list = []
        name = found[i].name.lstrip("$")
        for part in found[i].parts:
            ref = part[1] if part[0] in ("name", "bare") else None
            if ref is not None and ref in bound and ref != name:
                at = bisect_left(bound[ref], i)
                out.append(bound[ref][max(0, at - 1)])
                continue
            literal, start, end = part[-3:]
            if out and isinstance(out[-1], tuple) and out[-1][2] == start:  # a string cut at something that is no bound name
                literal, start = out[-1][0] + literal, out.pop()[1]
            out.append((literal, start, end))
        return out

    known: dict[int, list[tuple]] = {}
    for i, p in enumerate(found):
        if not sensitivity(p.name):
            continue
        literals: dict[tuple, None] = {}
        seen, left = {i}, own(i)[::-1]
        while left:
            x = left.pop()
            if isinstance(x, tuple):
                literals[x] = None
            elif x in known:
                literals.update(dict.fromkeys(known[x]))
            elif x not in seen:
                seen.add(x)
                left += own(x)[::-1]
        known[i] = list(literals)
        yield p.name, known[i]


def lexed(text: str, threshold: float = THRESHOLD) -> list[tuple[int, int, str, float]]:
    """(start, end, target name, score) of the literals that reach ``threshold``."""
    low = text.lower()
    if not any(g in low for g in _GATE) or not ("=" in low or ":" in low or "</" in low):
        return []
    best: dict[tuple[int, int], tuple[float, str]] = {}
    for name, parts in propagate(pairs(text)):
        if parts:
            s = score(name, "".join(p[0] for p in parts))
            if s >= threshold:
                for _, start, end in parts:
                    best[start, end] = max(best.get((start, end), (0.0, "")), (s, name))
    return sorted((a, b, name, s) for (a, b), (s, name) in best.items())


def base(text: str) -> list[tuple[int, int, str]]:
    """Spans of the base kinds."""
    out = []
    low = text.lower()
    if any(g in low for g in ("passw", "secret", "token", "api")):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m.group(2)) >= 8]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    if b"x" * 32 in text.encode("utf-8", "surrogatepass").translate(_HEX_RUN):
        out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def scan(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, base spans and all spans (kind, start, end, name, score) of every row."""
    d = texts(docs)
    span = "array<struct<kind:string,start:int,end:int,name:string,score:double>>"
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("name", pa.string()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                found = [(a, b, k, None, 1.0) for a, b, k in base(text)] + [(a, b, "lexed", n, s) for a, b, n, s in lexed(text, threshold)]
                found.sort(key=lambda f: (f[0], KINDS.index(f[2]), f[1]))
                rows.append([{"kind": k, "start": a, "end": b, "name": n, "score": s} for a, b, k, n, s in found])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, kind)], names=["doc_id", "spans"])
    return d.mapInArrow(run, d.select("doc_id", F.lit(None).cast(span).alias("spans")).schema)


def report(docs: DataFrame) -> DataFrame:
    """Per document: n_assign, n_access, n_hex, base_sha256, spans, n_lexed."""
    def line(found):
        return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def n(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    return scan(docs).select(
        "doc_id", n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"),
        F.sha2(line(F.filter("spans", lambda s: s["kind"] != "lexed")), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"), n("lexed").alias("n_lexed"))
