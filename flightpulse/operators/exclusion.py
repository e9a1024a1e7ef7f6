"""Removal of pairs that were authorised but never flown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..vocabulary import PHANTOM_PCT
from .cells import roll_up


def exclude_pairs(rows: DataFrame, pairs: DataFrame, first: str, second: str) -> DataFrame:
    """Rows for which ``(first, second) NOT IN (pairs)`` is true.

    SQL's ``NOT IN`` treats a null on either side as "could be equal", which
    Spark would plan as a nested loop. A row is dropped when the pair list has

    * the same pair, or its first value with a null second, or a null first
      with its second value, or (null, null);
    * if its second is null: its first value, or any null first;
    * if its first is null: its second value, or any null second;
    * anything at all, if both its values are null.

    A row meets the list in one lookup: an entry for each first value holds the
    set of its seconds and whether one of them is null. What rows need beside
    their entry is one row for the whole list: the seconds that stand with a
    null first, all seconds (looked at for rows with a null first only), and
    four flags. So entries are as many as first values, and sets as long as the
    second values are many; both are codes, far fewer than rows.

    The lookup uses null-safe equality: it gives the same answer (a null first
    has an entry of its own, which no test needs) and, unlike plain equality,
    adds no not-null filter below the pair list, so the list is computed once
    and its shuffle is reused. It is a left join rather than an anti join, which
    Spark may push below an aggregate of ``rows`` and so repeat for every flight.
    No join is hinted: the list can grow, and its real size decides.
    """
    listed = pairs.selectExpr(f"`{first}` AS _first", f"`{second}` AS _second")
    entries = listed.groupBy(F.col("_first").alias("_own_first")).agg(
        F.expr("struct(collect_set(_second) AS seconds, bool_or(_second IS NULL) AS open) AS _entry")
    )
    summary = listed.selectExpr(
        """struct(
             count(1) > 0 AS any_pair,
             coalesce(bool_or(_first IS NULL), false) AS open_first,
             coalesce(bool_or(_second IS NULL), false) AS open_second,
             coalesce(bool_or(_first IS NULL AND _second IS NULL), false) AS open_both,
             collect_set(_second) FILTER (WHERE _first IS NULL) AS with_open_first,
             collect_set(_second) AS seconds)"""
    ).scalar()
    # ``greatest`` is true when any of its tests is and skips nulls. Unlike an OR
    # it is not taken apart, so no test on the keys alone moves down to the
    # flights, where their scan would have to wait for the list.
    dropped = f"""greatest(
        false,
        _list.open_both,
        array_contains(_entry.seconds, `{second}`),
        _entry.open,
        array_contains(_list.with_open_first, `{second}`),
        `{second}` IS NULL AND _entry IS NOT NULL,
        `{second}` IS NULL AND _list.open_first,
        `{first}` IS NULL AND `{second}` IS NOT NULL AND array_contains(_list.seconds, `{second}`),
        `{first}` IS NULL AND _list.open_second,
        `{first}` IS NULL AND `{second}` IS NULL AND _list.any_pair)"""
    return (
        rows.withColumn("_list", summary)
        .join(entries, F.expr(f"`{first}` <=> _own_first"), "left")
        .where(f"NOT {dropped}")
        .select(*rows.columns)
    )


def phantom_pairs(cells: DataFrame, threshold: float = PHANTOM_PCT) -> DataFrame:
    """(origin, carrier) pairs whose unrounded cancellation share reaches the threshold."""
    return (
        cells.groupBy("origin", "carrier")
        .agg(F.sum("n").alias("n"), F.sum("n_cancelled").alias("n_cancelled"))
        .where(F.col("n_cancelled") * 100 >= F.col("n") * F.lit(threshold))
        .select("origin", "carrier")
    )


def operational_cells(
    cells: DataFrame,
    *keys: str | Column,
    totals: DataFrame | None = None,
    threshold: float = PHANTOM_PCT,
    only: Column | None = None,
) -> DataFrame:
    """Cells at (origin, carrier, ``keys``) without the phantom pairs.

    Flights are added up before the exclusion, so its joins see a few rows per
    pair instead of every flight. ``only`` restricts the result, never the
    pair list, which always comes from all cells, or from ``totals`` that hold
    the flights and cancellations of every pair.
    """
    wanted = cells if only is None else cells.where(only)
    return exclude_pairs(
        roll_up(wanted, "origin", "carrier", *keys),
        phantom_pairs(cells if totals is None else totals, threshold),
        "origin",
        "carrier",
    )


def operational_flights(flights: DataFrame, pairs: DataFrame) -> DataFrame:
    """Flight rows without the given pairs.

    A list derived from stored pair totals is small by its file size, which
    lets Spark choose a broadcast before any flight is shuffled.
    """
    return exclude_pairs(flights, pairs, "origin", "carrier")
