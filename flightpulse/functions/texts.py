"""Number texts of the headline figures. Arguments are column names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def percent_text(name: str) -> Column:
    """A percentage with two decimals, shown with one: ``90.9%``.

    Ties are decided as for the exact binary value of the DOUBLE: 90.25 is a
    true tie and goes to the even digit (90.2), 90.35 lies just below one
    (90.3). ``format_string`` would print 90.3 and 90.4. The distance from the
    tie, k - 100·v for k hundredths, is exact when taken off in steps of 64, 32
    and 4 times v: each difference is a multiple of the last digit of v.
    """
    hundredths = f"CAST(round({name} * 100) AS BIGINT)"
    below_tie = f"((({hundredths} - 64 * {name}) - 32 * {name}) - 4 * {name})"
    rounded = f"""({hundredths} div 10 + CASE
        WHEN {hundredths} % 10 <> 5 THEN ({hundredths} % 10) div 5
        WHEN {below_tie} <> 0 THEN if({below_tie} < 0, 1, 0)
        ELSE ({hundredths} div 10) % 2 END)"""
    return F.expr(f"concat({rounded} div 10, '.', {rounded} % 10, '%')")


def one_decimal_text(name: str, suffix: str) -> Column:
    """A value that has one decimal, with a unit behind it."""
    return F.expr(f"if({name} IS NULL, NULL, format_string('%.1f{suffix}', {name}))")


def thousands_text(name: str) -> Column:
    """Whole number with dots between thousands."""
    return F.expr(f"translate(format_number({name}, 0), ',', '.')")
