"""Airports by month and the effect of the focus month (December)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.periods import label, label_or_code, month_of
from ..functions.rates import (
    from_hundredths,
    from_tenths,
    mean_tenths,
    pct_hundredths,
    rounded_ratio,
)
from ..operators.cells import mean_delay, on_time_pct, roll_up, top
from ..operators.exclusion import operational_cells
from ..vocabulary import (
    AIRPORT_LABELS,
    EXCLUDED_HEATMAP_ORIGINS,
    FOCUS_MONTH,
    MIN_FLIGHTS,
    MONTH_LABELS,
    PHANTOM_PCT,
    REF_MONTH_SOURCE_NAME,
)
from .facts import Facts


def _largest(origins: DataFrame, k: int, min_flights: int) -> DataFrame:
    """The ``k`` origins with most flights; a null origin takes a place but is not shown."""
    big = origins.where(F.col("flights") >= min_flights)
    return top(big, F.desc("flights"), k, "origin").where(F.col("origin").isNotNull())


def _origin_months(facts: Facts, min_flights: int, k: int, phantom_pct: float) -> DataFrame:
    """Month figures of the largest origins, in one pass.

    An origin's months travel with its total (at most one small entry per
    calendar month in the data), so choosing the largest origins needs no
    second look at the flights and no join back.
    """
    monthly = roll_up(
        operational_cells(facts.cells, "ref_month", totals=facts.pairs, threshold=phantom_pct), "origin", "ref_month"
    )
    per_origin = monthly.groupBy("origin").agg(
        F.sum("n").alias("flights"),
        F.collect_list(
            F.struct("ref_month", "n", "n_dep_on_time", "n_dep_delay", "sum_dep_delay")
        ).alias("months"),
    )
    return (
        _largest(per_origin, k, min_flights)
        .select(F.col("origin").alias("aeroporto"), F.inline("months"))
        .select(
            "aeroporto",
            F.col("ref_month").alias(REF_MONTH_SOURCE_NAME),
            F.col("n").alias("total_voos"),
            on_time_pct().alias("taxa_pontualidade_pct"),
            mean_delay().alias("atraso_medio_min"),
        )
    )


def origin_month_matrix(
    facts: Facts, min_flights: int = MIN_FLIGHTS, k: int = 15, phantom_pct: float = PHANTOM_PCT
) -> DataFrame:
    return _origin_months(facts, min_flights, k, phantom_pct).orderBy(
        "aeroporto", REF_MONTH_SOURCE_NAME
    )


def worst_origin_months(
    facts: Facts,
    min_flights: int = MIN_FLIGHTS,
    k_origins: int = 15,
    k: int = 10,
    phantom_pct: float = PHANTOM_PCT,
) -> DataFrame:
    months = _origin_months(facts, min_flights, k_origins, phantom_pct)
    return top(months, F.asc("taxa_pontualidade_pct"), k, "aeroporto", REF_MONTH_SOURCE_NAME)


def _origin_profiles(
    facts: Facts,
    min_flights: int,
    k: int,
    focus_month: int,
    phantom_pct: float,
    only: Column | None = None,
) -> DataFrame:
    """One row per large origin: focus month against the mean of the other months.

    The mean is over the *rounded* monthly figures with equal weight. They are
    kept as whole hundredths and tenths, so nothing depends on the order in
    which months are added and only the last step rounds.
    """
    monthly = roll_up(
        operational_cells(
            facts.cells, month_of(F.col("ref_month")).alias("mes"), totals=facts.pairs, threshold=phantom_pct, only=only
        ),
        "origin",
        "mes",
    ).select(
        "origin",
        "mes",
        "n",
        pct_hundredths("n_dep_on_time", "n_dep_delay").alias("on_time"),
        mean_tenths("sum_dep_delay", "n_dep_delay").alias("delay"),
    )
    focus = F.col("mes") == focus_month
    figures = [F.sum("n").alias("flights")]
    for name in ("on_time", "delay"):
        other = F.when(~focus, F.col(name))
        figures += [
            F.max(F.when(focus, F.col(name))).alias(f"{name}_focus"),
            F.sum(other).alias(f"{name}_sum"),
            F.count(other).alias(f"{name}_months"),
        ]
    figures.append(F.collect_list(F.struct("mes", "on_time")).alias("months"))
    return _largest(monthly.groupBy("origin").agg(*figures), k, min_flights)


def _mean_of_others(name: str) -> str:
    return rounded_ratio(f"{name}_sum", f"{name}_months")


def _focus_against_others(name: str) -> str:
    """Focus value minus the unrounded mean of the others, rounded once."""
    return rounded_ratio(f"{name}_focus * {name}_months - {name}_sum", f"{name}_months")


def _delta_columns() -> list[Column]:
    return [
        F.col("origin").alias("aeroporto"),
        from_hundredths(_mean_of_others("on_time")).alias("pontualidade_media_sem_dez"),
        from_hundredths("on_time_focus").alias("pontualidade_dezembro"),
        from_hundredths(_focus_against_others("on_time")).alias("variacao_dez_pp"),
        from_tenths(_mean_of_others("delay")).alias("atraso_medio_sem_dez"),
        from_tenths("delay_focus").alias("atraso_dez_min"),
    ]


def origin_december_delta(
    facts: Facts,
    min_flights: int = MIN_FLIGHTS,
    k: int = 15,
    focus_month: int = FOCUS_MONTH,
    phantom_pct: float = PHANTOM_PCT,
) -> DataFrame:
    return (
        _origin_profiles(facts, min_flights, k, focus_month, phantom_pct)
        .select(
            *_delta_columns(),
            from_tenths(_focus_against_others("delay")).alias("variacao_atraso_dez_min"),
        )
        .orderBy("variacao_dez_pp", "aeroporto")
    )


def stable_origins(
    facts: Facts,
    min_flights: int = MIN_FLIGHTS,
    k: int = 15,
    focus_month: int = FOCUS_MONTH,
    phantom_pct: float = PHANTOM_PCT,
) -> DataFrame:
    """All large origins, the least affected by the focus month first."""
    return (
        _origin_profiles(facts, min_flights, k, focus_month, phantom_pct)
        .select(*_delta_columns())
        .orderBy(F.desc("variacao_dez_pp"), "aeroporto")
    )


def dash_origin_month_heatmap(
    facts: Facts,
    min_flights: int = MIN_FLIGHTS,
    k: int = 14,
    focus_month: int = FOCUS_MONTH,
    excluded_origins: Sequence[str] = EXCLUDED_HEATMAP_ORIGINS,
    labels: Mapping[str, str] = AIRPORT_LABELS,
    phantom_pct: float = PHANTOM_PCT,
) -> DataFrame:
    """Punctuality per large origin and month, with the origin's focus-month change."""
    shown = F.col("origin").isNotNull() & ~F.col("origin").isin(list(excluded_origins))
    profiles = _origin_profiles(facts, min_flights, k, focus_month, phantom_pct, only=shown)
    return (
        profiles.select(
            F.col("origin").alias("aeroporto"),
            from_hundredths(_focus_against_others("on_time")).alias("variacao_dez_pp"),
            F.inline("months"),
        )
        .select(
            "aeroporto",
            "mes",
            from_hundredths("on_time").alias("pontualidade"),
            "variacao_dez_pp",
            label_or_code(F.col("aeroporto"), labels).alias("nome_aeroporto"),
            label(F.col("mes"), MONTH_LABELS).alias("nome_mes"),
        )
        .orderBy("variacao_dez_pp", "aeroporto", "mes")
    )


def dash_origin_month_grid(facts: Facts, **params) -> DataFrame:
    """The heatmap as a grid: one row per origin, twelve month columns."""
    cells = dash_origin_month_heatmap(facts, **params)
    return (
        cells.groupBy("nome_aeroporto", "variacao_dez_pp")
        .pivot("nome_mes", list(MONTH_LABELS.values()))
        .agg(F.max("pontualidade"))
        .orderBy(F.asc_nulls_last("variacao_dez_pp"), "nome_aeroporto")
    )
