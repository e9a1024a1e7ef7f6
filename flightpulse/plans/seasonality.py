"""Punctuality, cancellation and delay by month and weekday."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.periods import label, month_of
from ..operators.cells import cancelled_pct, mean_delay, on_time_pct, roll_up, top
from ..vocabulary import REF_MONTH_SOURCE_NAME, WEEKDAY_NAMES
from .facts import Facts


def _figures():
    return (
        F.col("n").alias("total_voos"),
        on_time_pct().alias("taxa_pontualidade_pct"),
        cancelled_pct().alias("taxa_cancelamento_pct"),
        mean_delay().alias("atraso_medio_min"),
    )


def by_calendar_month(facts: Facts) -> DataFrame:
    """Months 1 to 12 with the years pooled."""
    return (
        roll_up(facts.cells, month_of(F.col("ref_month")).alias("mes"))
        .select("mes", *_figures())
        .orderBy("mes")
    )


def by_ref_month(facts: Facts) -> DataFrame:
    return (
        roll_up(facts.cells, "ref_month")
        .select(F.col("ref_month").alias(REF_MONTH_SOURCE_NAME), *_figures())
        .orderBy(REF_MONTH_SOURCE_NAME)
    )


def _weekdays(facts: Facts) -> DataFrame:
    return roll_up(facts.cells.where(F.col("weekday").isNotNull()), "weekday").withColumn(
        "dia_semana", label(F.col("weekday"), WEEKDAY_NAMES)
    )


def by_weekday(facts: Facts) -> DataFrame:
    return (
        _weekdays(facts)
        .select(F.col("weekday").alias("dia_semana_num"), "dia_semana", *_figures())
        .orderBy("dia_semana_num")
    )


def worst_ref_month(facts: Facts) -> DataFrame:
    months = roll_up(facts.cells, "ref_month").select(
        F.col("ref_month").alias(REF_MONTH_SOURCE_NAME), mean_delay().alias("atraso_medio_min")
    )
    return top(months, F.desc("atraso_medio_min"), 1, REF_MONTH_SOURCE_NAME)


def worst_weekday(facts: Facts) -> DataFrame:
    days = _weekdays(facts).select("dia_semana", mean_delay().alias("atraso_medio_min"))
    return top(days, F.desc("atraso_medio_min"), 1, "dia_semana")


def cancel_by_ref_month(facts: Facts) -> DataFrame:
    return (
        roll_up(facts.cells, "ref_month")
        .select(
            F.col("ref_month").alias(REF_MONTH_SOURCE_NAME),
            F.col("n").alias("total_voos"),
            F.col("n_cancelled").alias("cancelados"),
            cancelled_pct().alias("taxa_cancelamento_pct"),
        )
        .orderBy(REF_MONTH_SOURCE_NAME)
    )
