"""Ingest check and data-quality diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rates import pct
from ..operators.cells import roll_up, total
from ..vocabulary import CATEGORY_NO_SCHEDULE, LOW_VOLUME_PCT, REF_MONTH_SOURCE_NAME
from .facts import Facts
from .kpis import delay_category_share


def ingest_summary(facts: Facts) -> DataFrame:
    """Flights with a scheduled departure and the span of their departures."""
    return roll_up(facts.cells.where(F.col("weekday").isNotNull())).select(
        F.col("n").alias("total_registros"),
        F.col("first_sched_dep").alias("data_minima"),
        F.col("last_sched_dep").alias("data_maxima"),
    )


def _missing_schedule(cells: DataFrame, *keys: str) -> DataFrame:
    return (
        cells.groupBy(*keys)
        .agg(total("n").alias("n"), total("n", F.col("weekday").isNull()).alias("missing"))
        .withColumn("share", pct("missing", "n"))
    )


def missing_schedule_by_month(facts: Facts) -> DataFrame:
    """Share of flights without a scheduled departure, per month."""
    return (
        _missing_schedule(facts.cells, "ref_month")
        .select(
            F.col("ref_month").alias(REF_MONTH_SOURCE_NAME),
            F.col("n").alias("total_voos"),
            F.col("missing").alias("sem_horario_previsto"),
            F.col("share").alias("pct_sem_horario"),
        )
        .orderBy(REF_MONTH_SOURCE_NAME)
    )


def missing_schedule_by_carrier_month(facts: Facts) -> DataFrame:
    return (
        _missing_schedule(facts.cells, "carrier", "ref_month")
        .select(
            F.col("carrier").alias("empresa"),
            F.col("ref_month").alias(REF_MONTH_SOURCE_NAME),
            F.col("n").alias("total_voos"),
            F.col("missing").alias("sem_horario_previsto"),
            F.col("share").alias("pct_sem_horario"),
        )
        .orderBy("empresa", REF_MONTH_SOURCE_NAME)
    )


def unscheduled_flights(facts: Facts) -> DataFrame:
    """Flights in the category without a scheduled time."""
    return delay_category_share(facts).where(
        F.col("categoria_atraso_partida") == CATEGORY_NO_SCHEDULE
    )


def origin_month_coverage(facts: Facts) -> DataFrame:
    """Months in which each origin has flights, against the months in the data.

    An origin with fewer months, or with months below LOW_VOLUME_PCT percent of
    its own typical month (the upper median), had its operation interrupted
    and is not comparable month by month. One grouping gives an entry per month
    and origin, the months as a bitmap. The bitmaps of all origins, one row per
    airport code, add up to the months in the data, which is one number.
    """
    monthly = facts.cells.groupBy("origin", "ref_month").agg(total("n").alias("n"))
    origins = monthly.groupBy(F.col("origin").alias("aeroporto")).agg(
        F.sum("n").alias("total_voos"),
        F.count(F.lit(1)).alias("meses_com_voos"),
        F.min("n").alias("menor_volume_mes"),
        F.max("n").alias("maior_volume_mes"),
        F.sort_array(F.collect_list("n")).alias("volumes"),
    )
    # The sum keeps the entries' columns the same for both uses, so that their shuffle serves both.
    every = monthly.selectExpr("struct(count(DISTINCT ref_month) AS months, sum(n) AS n)").scalar()
    typical = F.expr("element_at(volumes, CAST(size(volumes) div 2 + 1 AS INT))")
    low = F.expr(f"size(filter(volumes, v -> v * 100 < volume_tipico_mes * {LOW_VOLUME_PCT}))")
    return (
        origins.withColumn("_every", every)
        .withColumn("meses_no_periodo", F.col("_every.months"))
        .withColumn("interrompido", F.col("meses_com_voos") < F.col("meses_no_periodo"))
        .withColumn("volume_tipico_mes", typical)
        .withColumn("meses_baixo_volume", low.cast("bigint"))
        .drop("volumes", "_every")
        .orderBy("aeroporto")
    )
