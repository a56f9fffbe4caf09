"""Phrase and token helpers for text columns.

All helpers compile a Python phrase list into one built-in column expression
(``instr``, ``startswith``, ``regexp_extract``, array functions), so a
question table of any size is annotated JVM-side with no Python UDF.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's str.split() whitespace set, as a Java regex class.
_WS = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def normalize(c: Column) -> Column:
    """lower case, runs of whitespace to one space, trimmed (H8)."""
    return F.trim(F.regexp_replace(F.lower(c), _WS, " "))


def strip_lower(c: Column) -> Column:
    """``str.lower().strip()``: lower case, leading/trailing whitespace removed."""
    return F.regexp_replace(F.lower(c), f"^{_WS}|{_WS}$", "")


def has(c: Column, phrase: str) -> Column:
    """Substring test (H9)."""
    return F.instr(c, phrase) > 0


def _quoted(phrases: Iterable[str]) -> str:
    return "|".join(r"\Q" + p.replace(r"\E", r"\E\\E\Q") + r"\E" for p in phrases)


def has_any(c: Column, phrases: Iterable[str]) -> Column:
    """Contains any of the phrases: one regex alternation of quoted literals,
    so a long phrase list stays one small expression."""
    phrases = list(phrases)
    if not phrases:
        return F.lit(False)
    if len(phrases) == 1:
        return has(c, phrases[0])
    return c.rlike(_quoted(phrases))


def starts_any(c: Column, prefixes: Iterable[str]) -> Column:
    prefixes = list(prefixes)
    if not prefixes:
        return F.lit(False)
    return c.rlike("^(?:" + _quoted(prefixes) + ")")


def matches_any(c: Column, patterns: Iterable[str]) -> Column:
    patterns = list(patterns)
    if not patterns:
        return F.lit(False)
    return c.rlike("|".join(f"(?:{p})" for p in patterns))


def first_int(c: Column, patterns: Iterable[str]) -> Column:
    """First pattern (in order) that matches gives the integer of group 1."""
    tries = [F.when(c.rlike(p), F.regexp_extract(c, p, 1)) for p in patterns]
    return F.coalesce(*tries).try_cast("bigint")


def _sql_str(v: str) -> str:
    if "'" in v or "\\" in v:
        raise ValueError(f"phrase needs quoting: {v!r}")
    return "'" + v + "'"


def _name(c: Column | str) -> str:
    if isinstance(c, str):
        return f"`{c}`"
    raise TypeError("pass the column name for SQL-built expressions")


def longest_phrase(c: Column | str, mapping: Mapping[str, str]) -> Column:
    """Value of the longest phrase contained in column ``c`` (a name); on equal
    length the phrase listed first wins (H11). Null when none matches.

    Built as one SQL expression: an array of (length, -position, phrase,
    value) structs, filtered by containment, and its maximum.
    """
    col = _name(c)
    items = ", ".join(f"named_struct('n', {len(p)}, 'o', {-i}, 'p', {_sql_str(p)}, 'v', {_sql_str(v)})"
                      for i, (p, v) in enumerate(mapping.items()))
    return F.expr(f"array_max(filter(array({items}), s -> instr({col}, s.p) > 0)).v")


def ordered_hits(c: Column | str, groups: Mapping[str, Iterable[str]]) -> Column:
    """Names of the groups (in order) with any phrase contained in column ``c``."""
    col = _name(c)
    parts = []
    for name, ps in groups.items():
        cond = " OR ".join(f"instr({col}, {_sql_str(p)}) > 0" for p in ps)
        parts.append(f"CASE WHEN {cond} THEN {_sql_str(name)} END")
    return F.expr(f"filter(array({', '.join(parts)}), x -> x IS NOT NULL)")


def tokens(c: Column, stop: Iterable[str]) -> Column:
    """Distinct ``[a-z0-9]+`` tokens longer than one character, minus stop words."""
    toks = F.regexp_extract_all(F.lower(c.cast("string")), F.lit("[a-z0-9]+"), 0)
    stop_arr = F.expr("array(" + ", ".join(_sql_str(s) for s in sorted(stop)) + ")")
    return F.array_distinct(F.array_except(F.filter(toks, lambda t: F.length(t) > 1), stop_arr))
