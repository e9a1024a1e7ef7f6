"""The data behind the dashboard's figures, with its year selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.periods import in_years, label, month_of, monday_first
from ..functions.texts import one_decimal_text, percent_text, thousands_text
from ..operators.cells import cancelled_pct, mean_delay, on_time_pct, roll_up, top
from ..operators.exclusion import operational_cells
from ..vocabulary import (
    FOCUS_MONTH,
    FOCUS_WEEKDAY,
    HIGHLIGHTED_CARRIERS,
    HIGHLIGHTED_ORIGINS,
    MIN_COMPLETENESS,
    MIN_FLIGHTS,
    MONTH_LABELS,
    PHANTOM_PCT,
    WEEKDAY_LABELS,
    YEARS,
)
from .carriers import complete_enough
from .facts import Facts


def _of_years(facts: Facts, years: Sequence[str]) -> DataFrame:
    return facts.cells.where(in_years(F.col("ref_month"), years))


def dash_kpis(facts: Facts, years: Sequence[str] = YEARS) -> DataFrame:
    return roll_up(_of_years(facts, years)).select(
        F.col("n").alias("total_voos"),
        on_time_pct().alias("taxa_pontualidade_pct"),
        cancelled_pct().alias("taxa_cancelamento_pct"),
        mean_delay().alias("atraso_medio_min"),
    )


def dash_kpi_texts(facts: Facts, years: Sequence[str] = YEARS) -> DataFrame:
    """The four headline figures as display texts."""
    return dash_kpis(facts, years).select(
        thousands_text("total_voos").alias("total_voos"),
        percent_text("taxa_pontualidade_pct").alias("pontualidade"),
        percent_text("taxa_cancelamento_pct").alias("cancelamento"),
        one_decimal_text("atraso_medio_min", " min").alias("atraso_medio"),
    )


def dash_by_month(
    facts: Facts, years: Sequence[str] = YEARS, focus_month: int = FOCUS_MONTH
) -> DataFrame:
    return (
        roll_up(_of_years(facts, years), month_of(F.col("ref_month")).alias("mes"))
        .select(
            "mes",
            on_time_pct().alias("taxa_pontualidade_pct"),
            label(F.col("mes"), MONTH_LABELS).alias("nome_mes"),
            (F.col("mes") == focus_month).alias("destaque"),
        )
        .orderBy("mes")
    )


def dash_by_weekday(
    facts: Facts, years: Sequence[str] = YEARS, focus_weekday: int = FOCUS_WEEKDAY
) -> DataFrame:
    """Weekdays in display order, Monday first."""
    scheduled = _of_years(facts, years).where(F.col("weekday").isNotNull())
    return (
        roll_up(scheduled, "weekday")
        .select(
            F.col("weekday").alias("dia_semana_num"),
            on_time_pct().alias("taxa_pontualidade_pct"),
            label(F.col("weekday"), WEEKDAY_LABELS).alias("nome_dia"),
            monday_first(F.col("weekday")).alias("ordem"),
            (F.col("weekday") == focus_weekday).alias("destaque"),
        )
        .orderBy("ordem")
    )


def _operational_of_years(facts: Facts, years: Sequence[str], phantom_pct: float) -> DataFrame:
    """Operational cells of the years; the pair list still comes from all years."""
    return operational_cells(
        facts.cells, totals=facts.pairs, threshold=phantom_pct, only=in_years(F.col("ref_month"), years)
    )


def dash_origin_worst_on_time(
    facts: Facts,
    years: Sequence[str] = YEARS,
    min_flights: int = MIN_FLIGHTS,
    k: int = 10,
    phantom_pct: float = PHANTOM_PCT,
) -> DataFrame:
    ranked = (
        roll_up(_operational_of_years(facts, years, phantom_pct), F.col("origin").alias("aeroporto"))
        .where(F.col("n") >= min_flights)
        .select(
            "aeroporto",
            F.col("n").alias("total_voos"),
            on_time_pct().alias("taxa_pontualidade_pct"),
        )
    )
    return (
        top(ranked, F.asc("taxa_pontualidade_pct"), k, "aeroporto")
        .withColumn("texto", percent_text("taxa_pontualidade_pct"))
        .orderBy(F.asc_nulls_last("taxa_pontualidade_pct"), "aeroporto")
    )


def dash_origin_most_cancelled(
    facts: Facts,
    years: Sequence[str] = YEARS,
    min_flights: int = MIN_FLIGHTS,
    k: int = 5,
    highlighted: Sequence[str] = HIGHLIGHTED_ORIGINS,
    phantom_pct: float = PHANTOM_PCT,
) -> DataFrame:
    ranked = (
        roll_up(_operational_of_years(facts, years, phantom_pct), F.col("origin").alias("aeroporto"))
        .where(F.col("n") >= min_flights)
        .select(
            "aeroporto",
            F.col("n").alias("total_voos"),
            F.col("n_cancelled").alias("cancelados"),
            cancelled_pct().alias("taxa_cancelamento_pct"),
            F.coalesce(F.col("aeroporto").isin(list(highlighted)), F.lit(False)).alias("destaque"),
        )
    )
    return (
        top(ranked, F.desc("taxa_cancelamento_pct"), k, "aeroporto")
        .withColumn("texto", percent_text("taxa_cancelamento_pct"))
        .orderBy(F.asc_nulls_last("taxa_cancelamento_pct"), "aeroporto")
    )


def dash_carrier_on_time(
    facts: Facts,
    years: Sequence[str] = YEARS,
    min_flights: int = MIN_FLIGHTS,
    min_completeness: float = MIN_COMPLETENESS,
    highlighted: Sequence[str] = HIGHLIGHTED_CARRIERS,
    phantom_pct: float = PHANTOM_PCT,
) -> DataFrame:
    return (
        roll_up(_operational_of_years(facts, years, phantom_pct), F.col("carrier").alias("empresa"))
        .where(complete_enough(min_flights, min_completeness))
        .select(
            "empresa",
            F.col("n").alias("total_voos"),
            on_time_pct().alias("taxa_pontualidade_pct"),
            mean_delay().alias("atraso_medio_min"),
            F.coalesce(F.col("empresa").isin(list(highlighted)), F.lit(False)).alias("destaque"),
        )
        .orderBy(F.asc_nulls_last("taxa_pontualidade_pct"), "empresa")
    )
