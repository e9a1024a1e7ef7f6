"""Exact rates and means: whole-number arithmetic, rounded half away from zero.

A percentage with two decimals is held as whole hundredths and a mean with one
decimal as whole tenths until it is shown, so no result depends on the order
of additions or on how a binary fraction prints. The products stay inside
BIGINT up to 4·10^14 flights; beyond that ANSI mode raises instead of wrapping.

Arguments are SQL expressions, usually plain column names.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded_share(num: str, den: str, scale: int) -> str:
    """``round(num / den * scale)`` for ``num >= 0``; null when ``den`` is 0 or null."""
    return f"CASE WHEN ({den}) > 0 THEN (({num}) * {2 * scale}L + ({den})) div (2L * ({den})) END"


def rounded_ratio(num: str, den: str, scale: int = 1) -> str:
    """The same for a numerator of either sign."""
    size = rounded_share(f"abs({num})", den, scale)
    return f"CASE WHEN ({num}) < 0 THEN -({size}) ELSE ({size}) END"


def pct_hundredths(num: str, den: str) -> Column:
    return F.expr(rounded_share(num, den, 10_000))


def mean_tenths(total: str, count: str) -> Column:
    return F.expr(rounded_ratio(total, count, 10))


def from_hundredths(value: str) -> Column:
    return F.expr(f"({value}) / 100.0D")


def from_tenths(value: str) -> Column:
    return F.expr(f"({value}) / 10.0D")


def pct(num: str, den: str) -> Column:
    """Percentage with two decimals, as DOUBLE."""
    return from_hundredths(rounded_share(num, den, 10_000))


def mean1(total: str, count: str) -> Column:
    """Mean with one decimal, as DOUBLE."""
    return from_tenths(rounded_ratio(total, count, 10))
