"""Number rules: an unknown value stays null and is never replaced by zero or a neighbour."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Texts that mean "not disclosed" in a number cell.
NOT_DISCLOSED = ("", "-", "N/A", "n/a")

_PLAIN_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
_LEADING_NUMBER = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"


_SPACE = " \t\n\r\f\v\u00a0"


def _strip(text: Column) -> Column:
    return F.btrim(text, F.lit(_SPACE))


def num_or_null(text: Column) -> Column:
    """The number written in a text cell, or null where the cell holds none."""
    cleaned = _strip(F.replace(text, F.lit(","), F.lit("")))
    return F.when(cleaned.rlike(_PLAIN_NUMBER), cleaned.try_cast("double"))


def real_or_null(value: Column) -> Column:
    """A numeric column with NaN read as unknown."""
    return F.when(~F.isnan(value), value)


def positive_or_null(value: Column) -> Column:
    """A strictly positive number, or null."""
    return F.when((value > 0) & ~F.isnan(value), value)


def derive_or_null(a: Column, b: Column, fn: Callable[[Column, Column], Column]) -> Column:
    """``fn(a, b)`` where both inputs are known, else null."""
    return F.when(a.isNotNull() & b.isNotNull(), real_or_null(fn(a, b)))


def sum_term(value: Column) -> Column:
    """An unknown term counts as zero in a running total, and only there."""
    return F.coalesce(value, F.lit(0).cast("double"))


def clean_num(text: Column) -> Column:
    """The leading number of a CSV cell after quotes, commas, spaces and percent signs are dropped."""
    head = F.regexp_extract(F.regexp_replace(text, r'[",\s%]', ""), _LEADING_NUMBER, 1)
    return F.when(~text.isin(*NOT_DISCLOSED[:3]) & (head != ""), head.try_cast("double"))


def leading_number(text: Column) -> Column:
    """The number a text starts with (commas dropped), or null."""
    head = F.regexp_extract(F.replace(text, F.lit(","), F.lit("")), _LEADING_NUMBER, 1)
    return F.when(head != "", head.try_cast("double"))


def to_fixed(value: Column, digits: int = 2) -> Column:
    """Round to ``digits`` decimals on the exact binary value of the double.

    ``F.round`` goes through the shortest decimal text, so 1.005 becomes 1.01. The exact value of that double is
    below 1.005 and must give 1.0. Only where the product with the power of ten lands on a half does its
    rounding error matter: the value splits into a float and a rest, both multiply without error, and the sign of the
    error decides. All steps are double arithmetic, so the expression stays in generated code and needs no decimals.
    The input is read several times; name a costly one first. Exact while value times 10^digits stays below 2^53.
    """
    scale = F.lit(float(10**digits))
    x = F.abs(value)
    p = x * scale
    whole = F.floor(p)
    high = x.cast("float").cast("double")
    error = (high * scale - p) + (x - high) * scale
    at_half = F.when(error >= 0, whole + 1).otherwise(whole).cast("double")
    return F.signum(value) * F.when(p - whole == 0.5, at_half).otherwise(F.rint(p)) / scale


def rounded(value: Column, digits: int | None) -> Column:
    """``to_fixed`` unless ``digits`` is None."""
    return value if digits is None else to_fixed(value, digits)


def with_rounded(df: DataFrame, raw: dict[str, Column], digits: int | None = 2) -> DataFrame:
    """Add columns and round them in a second step, so each raw expression is worked out once and generated code stays small."""
    named = df.withColumns(raw)
    return named if digits is None else named.withColumns({n: to_fixed(F.col(n), digits) for n in raw})


def ratio_or_null(top: Column, bottom: Column) -> Column:
    """``top / bottom`` where the bottom is known and not zero."""
    return F.when(bottom != 0, top / bottom)


def change_abs(close: Column, ycp: Column, given: Column | None = None, digits: int | None = 2) -> Column:
    """Change against yesterday's close; a given value wins, and an unknown base gives null."""
    derived = F.when(ycp > 0, rounded(close - ycp, digits))
    return derived if given is None else F.coalesce(given, derived)


def change_pct(close: Column, ycp: Column, given: Column | None = None, digits: int | None = 2) -> Column:
    """Percentage change against yesterday's close."""
    derived = F.when(ycp > 0, rounded((close - ycp) / ycp * 100.0, digits))
    return derived if given is None else F.coalesce(given, derived)


def value_changed(a: Column, b: Column) -> Column:
    """Null-safe inequality."""
    return ~a.eqNullSafe(b)


def cagr_pct(start: Column, end: Column, years: Column, digits: int | None = 2) -> Column:
    """Compound annual growth in percent; null unless both ends and the span are positive."""
    ok = (start > 0) & (end > 0) & (years > 0)
    return F.when(ok, rounded((F.pow(end / start, F.lit(1.0) / years) - 1.0) * 100.0, digits))
