"""Per-flight derivations: the analytic view and the additive cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from ..functions.delays import delay_category, delay_minutes, is_next_day
from ..vocabulary import (
    CATEGORY_BEYOND_BANDS,
    CATEGORY_NO_ACTUAL,
    CATEGORY_NO_SCHEDULE,
    DELAY_BANDS,
    ON_TIME_BELOW_MIN,
    STATUS_CANCELLED,
)

# Keys of the additive rollup. ``weekday`` (0 = Sunday) is null when no
# departure was scheduled.
CELL_KEYS = ("ref_month", "weekday", "origin", "carrier")
# Keys of the additive rollup by destination, which no other report needs.
ARRIVAL_KEYS = ("ref_month", "dest")
PAIR_KEYS = ("ref_month", "origin", "carrier")

# One count per departure category, in the order the categories are tested.
CATEGORY_COUNTS = {
    CATEGORY_NO_ACTUAL: "n_no_actual",
    CATEGORY_NO_SCHEDULE: "n_no_schedule",
    DELAY_BANDS[0][1]: "n_early",
    DELAY_BANDS[1][1]: "n_punctual",
    DELAY_BANDS[2][1]: "n_late_30_60",
    DELAY_BANDS[3][1]: "n_late_60_120",
    DELAY_BANDS[4][1]: "n_late_120_240",
    CATEGORY_BEYOND_BANDS: "n_late_240",
}

SUMS = (
    "n",
    "n_cancelled",
    "n_dep_on_time",
    "n_dep_delay",
    "sum_dep_delay",
    "n_arr_on_time",
    "n_arr_delay",
    "sum_arr_delay",
    *CATEGORY_COUNTS.values(),
)
MINIMA = ("first_sched_dep",)
MAXIMA = ("last_sched_dep",)


def with_delays(flights: DataFrame) -> DataFrame:
    return flights.selectExpr(
        "*",
        f"{delay_minutes('sched_dep', 'actual_dep')} AS dep_delay_min",
        f"{delay_minutes('sched_arr', 'actual_arr')} AS arr_delay_min",
    )


def analytic(flights: DataFrame) -> DataFrame:
    """Every flight column plus the five derived columns."""
    return with_delays(flights).selectExpr(
        "*",
        f"{delay_category('sched_dep', 'actual_dep', 'dep_delay_min')} AS dep_category",
        f"{delay_category('sched_arr', 'actual_arr', 'arr_delay_min')} AS arr_category",
        f"{is_next_day('dep_delay_min')} AS next_day",
    )


def _category_tests() -> dict[str, str]:
    """The test of each departure category, on whole minutes instead of texts."""
    tests = {
        CATEGORY_NO_ACTUAL: "actual_dep IS NULL",
        CATEGORY_NO_SCHEDULE: "actual_dep IS NOT NULL AND sched_dep IS NULL",
    }
    lower = None
    for upper, category in DELAY_BANDS:
        above = "" if lower is None else f"dep_delay_min >= {lower} AND "
        tests[category] = f"{above}dep_delay_min < {upper}"
        lower = upper
    tests[CATEGORY_BEYOND_BANDS] = f"dep_delay_min >= {lower}"
    return tests


def flight_cells(flights: DataFrame) -> DataFrame:
    """Each flight as the smallest additive cell.

    A cell is a key plus measures that add up, so flights and rolled-up rows
    answer the same reports through the same code. "Comparable" flights are
    exactly those with a delay, and on-time ones those with a delay below the
    bound, so the tests run on whole numbers rather than on category texts.
    Columns a report does not read are pruned from its scan.
    """
    counts = {
        "n_cancelled": f"status = '{STATUS_CANCELLED}'",
        "n_dep_on_time": f"dep_delay_min < {ON_TIME_BELOW_MIN}",
        "n_dep_delay": "sched_dep IS NOT NULL AND actual_dep IS NOT NULL",
        "n_arr_on_time": f"arr_delay_min < {ON_TIME_BELOW_MIN}",
        "n_arr_delay": "sched_arr IS NOT NULL AND actual_arr IS NOT NULL",
        **{CATEGORY_COUNTS[category]: test for category, test in _category_tests().items()},
    }
    return with_delays(flights).selectExpr(
        "ref_month",
        "dayofweek(sched_dep) - 1 AS weekday",
        "origin",
        "dest",
        "carrier",
        "1L AS n",
        *[f"CASE WHEN {test} THEN 1L ELSE 0L END AS {name}" for name, test in counts.items()],
        "dep_delay_min AS sum_dep_delay",
        "arr_delay_min AS sum_arr_delay",
        "sched_dep AS first_sched_dep",
        "sched_dep AS last_sched_dep",
    )


def flight_delays(flights: DataFrame) -> DataFrame:
    """Each flight as one entry of the delay histogram, counting 0 without a delay."""
    return with_delays(flights).selectExpr(
        "ref_month",
        "dep_delay_min",
        "CASE WHEN dep_delay_min IS NOT NULL THEN 1L ELSE 0L END AS n",
    )


def histogram(delays: DataFrame, *keys: str) -> DataFrame:
    """Flights per delay. The filter is on the sum, so it stays above the aggregation."""
    return delays.groupBy(*keys, "dep_delay_min").agg(F.sum("n").alias("n")).where("n > 0")
