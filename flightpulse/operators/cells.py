"""Grouping of additive cells and the metrics read from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rates import mean1, pct
from .derive import MAXIMA, MINIMA, SUMS


def total(measure: str, where: Column | None = None) -> Column:
    """Sum of a measure, or of its rows that pass ``where`` (0 for the others)."""
    if where is None:
        return F.sum(measure)
    return F.sum(F.when(where, F.col(measure)).otherwise(0))


def roll_up(cells: DataFrame, *keys: str | Column) -> DataFrame:
    """Cells added up to the given keys; one row when no key is given.

    Partial sums are built before the shuffle, so a key that holds a third of
    all rows still sends one row per task. Measures that the caller does not
    read are pruned.
    """
    # A global count over no rows is 0; the other sums stay null.
    texts = ["coalesce(sum(n), 0L) AS n"]
    texts += [f"sum({measure}) AS {measure}" for measure in SUMS if measure != "n"]
    texts += [f"min({measure}) AS {measure}" for measure in MINIMA]
    texts += [f"max({measure}) AS {measure}" for measure in MAXIMA]
    return cells.groupBy(*keys).agg(*[F.expr(text) for text in texts])


def on_time_pct() -> Column:
    return pct("n_dep_on_time", "n_dep_delay")


def arrival_on_time_pct() -> Column:
    return pct("n_arr_on_time", "n_arr_delay")


def cancelled_pct() -> Column:
    return pct("n_cancelled", "n")


def mean_delay() -> Column:
    return mean1("sum_dep_delay", "n_dep_delay")


def mean_arrival_delay() -> Column:
    return mean1("sum_arr_delay", "n_arr_delay")


def top(frame: DataFrame, order: Column, k: int, *tie_breakers: str) -> DataFrame:
    """First ``k`` rows; the tie-breakers make the choice repeatable."""
    return frame.orderBy(order, *tie_breakers).limit(k)
