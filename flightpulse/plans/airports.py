"""Airport rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.cells import (
    arrival_on_time_pct,
    cancelled_pct,
    mean_arrival_delay,
    mean_delay,
    on_time_pct,
    roll_up,
    top,
)
from ..operators.exclusion import operational_cells
from ..vocabulary import MIN_FLIGHTS, PHANTOM_PCT_AUDIT
from .facts import Facts


def _origins(cells: DataFrame, min_flights: int = 0) -> DataFrame:
    return roll_up(cells, F.col("origin").alias("aeroporto")).where(F.col("n") >= min_flights)


def _full(origins: DataFrame) -> DataFrame:
    return origins.select(
        "aeroporto",
        F.col("n").alias("total_voos"),
        on_time_pct().alias("taxa_pontualidade_pct"),
        cancelled_pct().alias("taxa_cancelamento_pct"),
        mean_delay().alias("atraso_medio_min"),
    )


def _cancellations(origins: DataFrame) -> DataFrame:
    return origins.select(
        "aeroporto",
        F.col("n").alias("total_voos"),
        F.col("n_cancelled").alias("cancelados"),
        cancelled_pct().alias("taxa_cancelamento_pct"),
    )


def origin_top_volume(facts: Facts, k: int = 15) -> DataFrame:
    return top(_full(_origins(facts.cells)), F.desc("total_voos"), k, "aeroporto")


def origin_worst_on_time(facts: Facts, min_flights: int = MIN_FLIGHTS, k: int = 10) -> DataFrame:
    ranked = _full(_origins(facts.cells, min_flights))
    return top(ranked, F.asc("taxa_pontualidade_pct"), k, "aeroporto")


def origin_most_cancelled(facts: Facts, min_flights: int = MIN_FLIGHTS, k: int = 10) -> DataFrame:
    ranked = _cancellations(_origins(facts.cells, min_flights))
    return top(ranked, F.desc("taxa_cancelamento_pct"), k, "aeroporto")


def origin_most_delayed(facts: Facts, min_flights: int = MIN_FLIGHTS, k: int = 10) -> DataFrame:
    ranked = _origins(facts.cells, min_flights).select(
        "aeroporto",
        F.col("n").alias("total_voos"),
        mean_delay().alias("atraso_medio_min"),
        on_time_pct().alias("taxa_pontualidade_pct"),
    )
    return top(ranked, F.desc("atraso_medio_min"), k, "aeroporto")


def dest_worst_arrival(facts: Facts, min_flights: int = MIN_FLIGHTS, k: int = 10) -> DataFrame:
    """Destinations by arrival punctuality; cancellation still by flight status."""
    ranked = (
        roll_up(facts.arrivals, F.col("dest").alias("aeroporto"))
        .where(F.col("n") >= min_flights)
        .select(
            "aeroporto",
            F.col("n").alias("total_voos"),
            arrival_on_time_pct().alias("taxa_pontualidade_chegada_pct"),
            cancelled_pct().alias("taxa_cancelamento_pct"),
            mean_arrival_delay().alias("atraso_medio_chegada_min"),
        )
    )
    return top(ranked, F.asc("taxa_pontualidade_chegada_pct"), k, "aeroporto")


def origin_volume_vs_on_time(facts: Facts, min_flights: int = MIN_FLIGHTS, k: int = 15) -> DataFrame:
    """Rank by volume beside rank by unrounded punctuality (worst first).

    The two ordered windows see one row per airport code, not per flight.
    """
    share = F.col("n_dep_on_time") / F.nullif(F.col("n_dep_delay"), F.lit(0))
    by_volume = Window.orderBy(F.desc("n"))
    by_share = Window.orderBy(F.asc_nulls_first("share"))
    ranked = (
        _origins(facts.cells, min_flights)
        .withColumn("share", share)
        .select(
            "aeroporto",
            F.col("n").alias("total_voos"),
            F.rank().over(by_volume).cast("bigint").alias("rank_volume"),
            on_time_pct().alias("taxa_pontualidade_pct"),
            F.rank().over(by_share).cast("bigint").alias("rank_pontualidade"),
            mean_delay().alias("atraso_medio_min"),
        )
    )
    return top(ranked, F.asc("rank_pontualidade"), k, "aeroporto")


def phantom_pairs_audit(facts: Facts, threshold: float = PHANTOM_PCT_AUDIT) -> DataFrame:
    """Pairs whose *rounded* cancellation percentage reaches the threshold."""
    return (
        facts.pairs.groupBy("origin", "carrier")
        .agg(F.sum("n").alias("n"), F.sum("n_cancelled").alias("n_cancelled"))
        .select(
            F.col("origin").alias("aeroporto"),
            F.col("carrier").alias("empresa"),
            F.col("n").alias("total_voos"),
            F.col("n_cancelled").alias("cancelados"),
            cancelled_pct().alias("taxa_cancelamento_pct"),
        )
        .where(F.col("taxa_cancelamento_pct") >= threshold)
        .orderBy(F.desc("total_voos"), "aeroporto", "empresa")
    )


def origin_worst_on_time_clean(
    facts: Facts,
    min_flights: int = MIN_FLIGHTS,
    k: int = 10,
    threshold: float = PHANTOM_PCT_AUDIT,
) -> DataFrame:
    kept = operational_cells(facts.cells, totals=facts.pairs, threshold=threshold)
    return top(_full(_origins(kept, min_flights)), F.asc("taxa_pontualidade_pct"), k, "aeroporto")


def origin_most_cancelled_clean(
    facts: Facts,
    min_flights: int = MIN_FLIGHTS,
    k: int = 10,
    threshold: float = PHANTOM_PCT_AUDIT,
) -> DataFrame:
    kept = operational_cells(facts.cells, totals=facts.pairs, threshold=threshold)
    ranked = _cancellations(_origins(kept, min_flights))
    return top(ranked, F.desc("taxa_cancelamento_pct"), k, "aeroporto")
