"""What every report reads: additive cells and the delay histogram."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame

from ..operators.derive import flight_cells, flight_delays


@dataclass(frozen=True)
class Facts:
    """``cells``: CELL_KEYS and measures. ``arrivals``: ref_month, dest and measures.
    ``delays``: ref_month, dep_delay_min, n. ``pairs``: ref_month, origin, carrier, n, n_cancelled.

    Reports only add cells up, so they give the same rows whether a cell is one
    flight (``facts_from_flights``) or a row of the stored rollup
    (``plans.rollup.read_rollup``).
    """

    cells: DataFrame
    delays: DataFrame
    arrivals: DataFrame
    pairs: DataFrame

    def where(self, condition: Column) -> Facts:
        """Only the months for which a condition on ``ref_month`` holds."""
        return Facts(
            self.cells.where(condition),
            self.delays.where(condition),
            self.arrivals.where(condition),
            self.pairs.where(condition),
        )


def facts_from_flights(flights: DataFrame) -> Facts:
    cells = flight_cells(flights)
    return Facts(cells, flight_delays(flights), cells, cells)
