"""Column-expression helpers that encode the null, tie and number rules.

All helpers return ``pyspark.sql.Column`` built from ``pyspark.sql.functions``
only, so every use stays inside whole-stage codegen.

Rules (see the survey, R1-R10):

* R1 group keys: rows with a null dimension are dropped before grouping.
* R2 sums: the sum of an all-null group is 0 (``money_sum``).
* R3 means: null values are skipped; an all-null group gives null.
* R4 counts: ``count(col)`` counts non-null values.
* R6 membership: ``in_set`` is False (never null) for a null input.
* R9 ratios: division by zero gives 0.0 (``safe_ratio``).
* R10 number text: ``format_number`` on a double (half-even on the exact
  binary value, the same as Python's ``format``).

Money is summed exactly as ``DECIMAL`` and only then cast to ``DOUBLE``, so a
sum does not depend on the order in which partitions are combined.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"
MONEY_SUM = "decimal(38,6)"


def col_or_lit(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def in_set(c, values: Iterable[str]) -> Column:
    """Null-safe membership: null -> False, so negation keeps null rows."""
    return F.coalesce(col_or_lit(c).isin(list(values)), F.lit(False))


def money_sum(c, where: Column | None = None) -> Column:
    """Exact sum of a money column, 0 for an empty/all-null group, as double (R2)."""
    value = col_or_lit(c)
    if where is not None:
        value = F.when(where, value)
    return F.coalesce(F.sum(value.cast(MONEY_SUM)), F.lit(0).cast(MONEY_SUM)).cast("double")


def money_mean(c, where: Column | None = None) -> Column:
    """Mean that skips nulls (R3): exact decimal sum / non-null count, as double.

    Null when the group has no non-null value.
    """
    value = col_or_lit(c)
    if where is not None:
        value = F.when(where, value)
    total = F.sum(value.cast(MONEY_SUM)).cast("double")
    return F.try_divide(total, F.count(value).cast("double"))


def count_where(cond: Column) -> Column:
    return F.count_if(F.coalesce(cond, F.lit(False)))


def safe_ratio(num: Column, den: Column) -> Column:
    """num / den with 0 or null denominator -> 0.0."""
    return F.coalesce(F.try_divide(num.cast("double"), F.nullif(den.cast("double"), F.lit(0.0))), F.lit(0.0))


def norm_label(c) -> Column:
    """Label normaliser: ``_``/``-`` to space, lower case, squeeze and trim spaces."""
    s = F.regexp_replace(F.lower(col_or_lit(c).cast("string")), r"[_\-]", " ")
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def _fmt(c: Column, decimals: int) -> Column:
    return F.format_number(c.cast("double"), decimals)


def format_compact(c) -> Column:
    """Compact currency text: ``AED 1.23M``, ``AED 4.50K``, ``AED 12``; null -> ``N/A``.

    Millions and thousands use two decimals (no thousands separator inside the
    scaled number); below 1,000 the value is shown with no decimals and a
    thousands separator.
    """
    x = col_or_lit(c).cast("double")
    ax = F.abs(x)
    millions = F.concat(F.lit("AED "), F.regexp_replace(_fmt(x / F.lit(1_000_000.0), 2), ",", ""), F.lit("M"))
    thousands = F.concat(F.lit("AED "), F.regexp_replace(_fmt(x / F.lit(1_000.0), 2), ",", ""), F.lit("K"))
    units = F.concat(F.lit("AED "), _fmt(x, 0))
    text = (F.when(ax >= F.lit(1_000_000.0), millions)
            .when(ax >= F.lit(1_000.0), thousands)
            .otherwise(units))
    return F.when(x.isNull() | F.isnan(x), F.lit("N/A")).otherwise(text)


def format_fixed(c, decimals: int) -> Column:
    """Python ``f"{x:.Nf}"``: half-even on the exact binary value, no separators."""
    return F.regexp_replace(_fmt(col_or_lit(c), decimals), ",", "")


def format_full(c) -> Column:
    """Full currency text ``AED 1,234`` (no decimals); null -> ``N/A``."""
    x = col_or_lit(c).cast("double")
    return F.when(x.isNull(), F.lit("N/A")).otherwise(F.concat(F.lit("AED "), _fmt(x, 0)))


def format_percent(c, decimals: int = 1, scale: float = 1.0) -> Column:
    """Percent text ``12.5%``; ``scale=100`` for fractions; null -> ``N/A``."""
    x = col_or_lit(c).cast("double") * F.lit(float(scale))
    return F.when(x.isNull(), F.lit("N/A")).otherwise(F.concat(_fmt(x, decimals), F.lit("%")))


def month_label(c) -> Column:
    """``Jun 2024`` label of a date."""
    return F.date_format(col_or_lit(c), "MMM yyyy")


def month_key(c) -> Column:
    """``2024-06`` label of a date."""
    return F.date_format(col_or_lit(c), "yyyy-MM")


def day_label(c) -> Column:
    """``05 Jun 2024`` label of a date."""
    return F.date_format(col_or_lit(c), "dd MMM yyyy")


def iso_date(c) -> Column:
    return F.date_format(col_or_lit(c), "yyyy-MM-dd")


# Fixed date patterns accepted by lenient parsing, tried in this order after ISO.
# Month first where both readings fit; a first number above 12 is a day.
DATE_PATTERNS = ("yyyy-M-d", "yyyy/M/d", "yyyy.M.d", "yyyyMMdd", "M/d/yyyy", "d/M/yyyy", "M-d-yyyy", "d-M-yyyy", "M.d.yyyy", "d.M.yyyy",
                 "d MMM yyyy", "d-MMM-yyyy", "d MMMM yyyy", "MMM d, yyyy", "MMMM d, yyyy", "MMM d yyyy", "MMMM d yyyy",
                 "M/d/yyyy H:mm", "M/d/yyyy H:mm:ss", "yyyy/M/d H:mm", "yyyy/M/d H:mm:ss")
NUMBER_PATTERN = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$|^[+-]?(?i:inf|infinity)$"


def parse_date_lenient(c) -> Column:
    """Per-value date parsing; anything unparsable becomes null. A bare time or
    year is no date, so the result never depends on the day of the run."""
    s = F.trim(col_or_lit(c).cast("string"))
    tries = [F.try_to_timestamp(s)] + [F.try_to_timestamp(s, F.lit(p)) for p in DATE_PATTERNS]
    return F.when(s.rlike(r"^\d{4}-\d{1,2}-\d{1,2}|^\d{8}$|[/.\s-].*[/.\s-]"), F.coalesce(*tries).cast("date"))


def parse_number_lenient(c) -> Column:
    """``" 12 "`` and ``"1e3"`` parse; ``"1,000"``, ``"AED 5"``, ``"10d"``, ``"NaN"`` and ``""`` give null."""
    s = F.trim(col_or_lit(c).cast("string"))
    return F.when(s.rlike(NUMBER_PATTERN), s.try_cast("double"))
