"""The flights and their two views under the names SQL users know."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.dialect import register_sql_functions
from ..operators.derive import analytic, flight_cells
from ..operators.exclusion import operational_flights, phantom_pairs
from ..sources.publish import Store
from ..sources.tables import read_flights
from ..vocabulary import (
    ANALYTIC_VIEW,
    DERIVED_VIEW_COLUMNS,
    FLIGHTS_VIEW,
    OPERATIONAL_VIEW,
    REF_MONTH_SOURCE_NAME,
    SOURCE_COLUMNS,
)
from .rollup import read_pair_totals

# Session settings: which stored tables the views were made from.
_TABLE = "flightpulse.views.table"
_ROLLUP = "flightpulse.views.rollup"


def source_named(flights: DataFrame) -> DataFrame:
    """Columns under their names in the monthly files."""
    return flights.withColumnsRenamed(
        {**SOURCE_COLUMNS, **DERIVED_VIEW_COLUMNS, "ref_month": REF_MONTH_SOURCE_NAME}
    )


def register_views(
    spark: SparkSession, flights: DataFrame, totals: DataFrame | None = None
) -> None:
    """(Re)create the flights view, the analytic view and the operational view, and the SQL functions.

    Nothing runs here: the pair list is worked out each time the operational
    view is read, from ``totals`` (``read_pair_totals`` of a rollup, small
    beside the flights) or, without it, from the flights. Views of stored
    flights show the state that ``flights`` was read from; the session remembers
    the folders, so that ``refresh_views`` can move on to the newest state.
    """
    register_sql_functions(spark)
    pairs = phantom_pairs(flight_cells(flights) if totals is None else totals)
    rows = analytic(flights)
    for name, frame in (
        (FLIGHTS_VIEW, flights),
        (ANALYTIC_VIEW, rows),
        (OPERATIONAL_VIEW, operational_flights(rows, pairs)),
    ):
        source_named(frame).createOrReplaceTempView(name)
    for setting, folder in ((_TABLE, Store.folder_of(flights)), (_ROLLUP, Store.folder_of(totals))):
        spark.conf.set(setting, folder or "")


def register_stored_views(spark: SparkSession, table: str, rollup: str | None = None) -> None:
    """The same views over the newest state of stored flights, and the pair totals of a stored rollup if there is one."""
    register_views(
        spark, read_flights(spark, table), None if rollup is None else read_pair_totals(spark, rollup)
    )


def refresh_views(spark: SparkSession) -> None:
    """Rebuild the views of stored flights from what is published now, with the columns it has now."""
    table = spark.conf.get(_TABLE, "")
    if table:
        register_stored_views(spark, table, spark.conf.get(_ROLLUP, "") or None)
