"""Keys and labels taken from the reference month and the scheduled departure."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F


def year_of(ref_month: Column) -> Column:
    return F.substring(ref_month, 1, 4)


def month_of(ref_month: Column) -> Column:
    return F.substring(ref_month, 6, 2).cast("int")


def monday_first(weekday: Column) -> Column:
    return (weekday + F.lit(6)) % F.lit(7)


def in_years(ref_month: Column, years: Iterable[str]) -> Column:
    """Rows of the given years; on a table stored by month this prunes partitions."""
    return year_of(ref_month).isin([str(year) for year in years])


def label(value: Column, labels: Mapping) -> Column:
    """Lookup in a small fixed mapping; null where it has no entry."""
    if not labels:
        return F.lit(None).cast("string")
    entries = chain.from_iterable((F.lit(k), F.lit(v)) for k, v in labels.items())
    return F.try_element_at(F.create_map(*entries), value)


def label_or_code(code: Column, labels: Mapping) -> Column:
    return F.coalesce(label(code, labels), code)
