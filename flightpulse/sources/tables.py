"""Stored flights: Parquet, one partition per reference month, replaced all at once."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..vocabulary import TIMESTAMP_COLUMNS
from .publish import Publication, Store

FLIGHTS = "flights"


def write_flights(
    flights: DataFrame, path: str, replace_all: bool = True, months: Iterable[str] | None = None
) -> None:
    """Store flights as read from monthly files, and the names of their columns.

    ``replace_all=False`` replaces only the months present in ``flights``, and
    ``months``, which go if no flights are left of them. Readers see the old
    months and columns until all new ones are there, whenever a write ends.

    Writing needs no shuffle: a split of a large file belongs to one month, and
    a task that reads several small files sorts its own rows by month. Months
    that come later may bring columns of their own; the names are added up.
    """
    store = Store(flights.sparkSession, path)
    before = store.current() or Publication()
    written = store.write(flights, FLIGHTS)
    names = flights.drop("ref_month").columns
    if not replace_all:
        known = before.columns.get(FLIGHTS, [])
        names = known + [name for name in names if name not in known]
        replaced = {*written, *(months or ())}
        written = {m: f for m, f in before.parts.get(FLIGHTS, {}).items() if m not in replaced} | written
    store.publish(before, Publication(parts={FLIGHTS: written}, columns={FLIGHTS: names}))


def published(store: Store) -> Publication:
    state = store.current()
    if state is None:
        raise FileNotFoundError(f"no table was published in {store.path}")
    return state


def stored_columns(spark: SparkSession, path: str) -> list[str]:
    """Names of all columns that any month was stored with."""
    return published(Store(spark, path)).columns[FLIGHTS]


def read_flights(spark: SparkSession, path: str) -> DataFrame:
    """Every column that any month was stored with; null in months without it.

    The frame stays with the state that is current now. Its schema comes from
    the stored list of names: no footer is opened to plan a query, and a report
    still reads only the columns it needs.
    """
    store = Store(spark, path)
    state = published(store)
    schema = StructType()
    for name in state.columns[FLIGHTS]:
        schema = schema.add(name, "timestamp_ntz" if name in TIMESTAMP_COLUMNS else "string")
    return store.read(state, FLIGHTS, schema.add("ref_month", "string"))
