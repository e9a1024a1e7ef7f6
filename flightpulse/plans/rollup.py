"""The stored rollup: what the reports read instead of the flights."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.cells import roll_up
from ..operators.derive import ARRIVAL_KEYS, CELL_KEYS, MAXIMA, MINIMA, PAIR_KEYS, SUMS, histogram
from ..sources.publish import Publication, Store
from ..sources.tables import published
from .facts import Facts

_MEASURES = [f"{measure} BIGINT" for measure in SUMS] + [
    f"{measure} TIMESTAMP_NTZ" for measure in (*MINIMA, *MAXIMA)
]
CELL_SCHEMA = ", ".join(
    ["ref_month STRING", "weekday INT", "origin STRING", "carrier STRING", *_MEASURES]
)
ARRIVAL_SCHEMA = ", ".join(["ref_month STRING", "dest STRING", *_MEASURES])
PAIR_SCHEMA = "ref_month STRING, origin STRING, carrier STRING, n BIGINT, n_cancelled BIGINT"
DELAY_SCHEMA = "ref_month STRING, dep_delay_min BIGINT, n BIGINT"


def rolled_cells(facts: Facts) -> DataFrame:
    """One row per month, weekday, origin and carrier."""
    return roll_up(facts.cells, *CELL_KEYS)


def rolled_arrivals(facts: Facts) -> DataFrame:
    """One row per month and destination."""
    return roll_up(facts.arrivals, *ARRIVAL_KEYS)


def pair_totals(facts: Facts) -> DataFrame:
    """Flights and cancellations per month, origin and carrier: what the phantom pairs follow from."""
    return summed_pairs(facts.pairs)


def summed_pairs(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*PAIR_KEYS).agg(
        F.sum("n").alias("n"), F.sum("n_cancelled").alias("n_cancelled")
    )


def delay_histogram(facts: Facts) -> DataFrame:
    """Flights per month and departure delay, for the median."""
    return histogram(facts.delays, "ref_month")


def write_rollup(facts: Facts, path: str, months: Iterable[str] | None = None) -> None:
    """Build the rollup under ``path`` (a shared folder) and publish its four parts at once.

    With ``months`` only these partitions are rebuilt, or go if no flights are
    left of them: the measures add up, so no other month is read or written.
    The pair totals are sums of the cells just written, so they need no scan of
    the flights. ``rebalance`` gathers a month's rows into files of the advised
    size and splits a month that outgrows one.
    """
    spark = facts.cells.sparkSession
    store = Store(spark, path)
    before = store.current() or Publication()
    if months is not None:
        months = list(months)
        facts = facts.where(F.col("ref_month").isin(months))
    fresh = {
        name: store.write(frame.hint("rebalance", "ref_month"), name)
        for name, frame in (
            ("cells", rolled_cells(facts)),
            ("arrivals", rolled_arrivals(facts)),
            ("delays", delay_histogram(facts)),
        )
    }
    cells = store.read(Publication(parts=fresh), "cells", _schema(CELL_SCHEMA))
    fresh["pairs"] = store.write(summed_pairs(cells).hint("rebalance", "ref_month"), "pairs")
    if months is not None:
        for name, folders in fresh.items():
            kept = {m: f for m, f in before.parts.get(name, {}).items() if m not in months}
            fresh[name] = kept | folders
    store.publish(before, Publication(parts=fresh))


def _schema(text: str) -> StructType:
    """Fields of a stored part, the month last."""
    fields = StructType.fromDDL(text).fields
    return StructType([f for f in fields if f.name != "ref_month"]).add("ref_month", "string")


def read_rollup(spark: SparkSession, path: str) -> Facts:
    """The four parts of one publication."""
    store = Store(spark, path)
    state = published(store)
    return Facts(
        *[
            store.read(state, name, _schema(text))
            for name, text in (("cells", CELL_SCHEMA), ("delays", DELAY_SCHEMA), ("arrivals", ARRIVAL_SCHEMA), ("pairs", PAIR_SCHEMA))
        ]
    )


def read_pair_totals(spark: SparkSession, path: str) -> DataFrame:
    return read_rollup(spark, path).pairs
