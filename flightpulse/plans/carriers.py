"""Carrier rankings on the operational flights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.periods import month_of, year_of
from ..functions.rates import from_hundredths, pct, pct_hundredths
from ..operators.cells import cancelled_pct, mean_delay, on_time_pct, roll_up, top, total
from ..operators.exclusion import operational_cells
from ..vocabulary import FOCUS_MONTH, MIN_COMPLETENESS, MIN_FLIGHTS, PHANTOM_PCT, YEARS
from .facts import Facts


def complete_enough(min_flights: int, min_completeness: float):
    """Enough flights, and enough of them with a computable delay."""
    share = F.col("n_dep_delay") / F.col("n")
    return (F.col("n") >= min_flights) & (share >= min_completeness)


def _carriers(facts: Facts, phantom_pct: float) -> DataFrame:
    kept = operational_cells(facts.cells, totals=facts.pairs, threshold=phantom_pct)
    return roll_up(kept, F.col("carrier").alias("empresa"))


def carrier_top_volume(facts: Facts, k: int = 15, phantom_pct: float = PHANTOM_PCT) -> DataFrame:
    ranked = _carriers(facts, phantom_pct).select(
        "empresa",
        F.col("n").alias("total_voos"),
        on_time_pct().alias("taxa_pontualidade_pct"),
        cancelled_pct().alias("taxa_cancelamento_pct"),
        mean_delay().alias("atraso_medio_min"),
    )
    return top(ranked, F.desc("total_voos"), k, "empresa")


def _on_time_ranking(facts, min_flights, min_completeness, phantom_pct) -> DataFrame:
    return (
        _carriers(facts, phantom_pct)
        .where(complete_enough(min_flights, min_completeness))
        .select(
            "empresa",
            F.col("n").alias("total_voos"),
            on_time_pct().alias("taxa_pontualidade_pct"),
            mean_delay().alias("atraso_medio_min"),
        )
    )


def carrier_best_on_time(
    facts: Facts,
    min_flights: int = MIN_FLIGHTS,
    min_completeness: float = MIN_COMPLETENESS,
    k: int = 10,
    phantom_pct: float = PHANTOM_PCT,
) -> DataFrame:
    ranked = _on_time_ranking(facts, min_flights, min_completeness, phantom_pct)
    return top(ranked, F.desc("taxa_pontualidade_pct"), k, "empresa")


def carrier_worst_on_time(
    facts: Facts,
    min_flights: int = MIN_FLIGHTS,
    min_completeness: float = MIN_COMPLETENESS,
    k: int = 10,
    phantom_pct: float = PHANTOM_PCT,
) -> DataFrame:
    ranked = _on_time_ranking(facts, min_flights, min_completeness, phantom_pct)
    return top(ranked, F.asc("taxa_pontualidade_pct"), k, "empresa")


def carrier_most_cancelled(
    facts: Facts,
    min_flights: int = MIN_FLIGHTS,
    min_completeness: float = MIN_COMPLETENESS,
    k: int = 10,
    phantom_pct: float = PHANTOM_PCT,
) -> DataFrame:
    ranked = (
        _carriers(facts, phantom_pct)
        .where(complete_enough(min_flights, min_completeness))
        .select(
            "empresa",
            F.col("n").alias("total_voos"),
            F.col("n_cancelled").alias("cancelados"),
            cancelled_pct().alias("taxa_cancelamento_pct"),
        )
    )
    return top(ranked, F.desc("taxa_cancelamento_pct"), k, "empresa")


def carrier_most_delayed(
    facts: Facts,
    min_flights: int = MIN_FLIGHTS,
    min_completeness: float = MIN_COMPLETENESS,
    k: int = 10,
    phantom_pct: float = PHANTOM_PCT,
) -> DataFrame:
    ranked = (
        _carriers(facts, phantom_pct)
        .where(complete_enough(min_flights, min_completeness))
        .select(
            "empresa",
            F.col("n").alias("total_voos"),
            mean_delay().alias("atraso_medio_min"),
            on_time_pct().alias("taxa_pontualidade_pct"),
        )
    )
    return top(ranked, F.desc("atraso_medio_min"), k, "empresa")


def carrier_december_delta(
    facts: Facts,
    min_flights: int = MIN_FLIGHTS,
    focus_month: int = FOCUS_MONTH,
    phantom_pct: float = PHANTOM_PCT,
) -> DataFrame:
    """Punctuality in the focus month against all other months, weighted by flights.

    The difference is taken between the two rounded percentages.
    """
    in_focus = F.col("mes") == focus_month
    kept = operational_cells(
        facts.cells, month_of(F.col("ref_month")).alias("mes"), totals=facts.pairs, threshold=phantom_pct
    )
    by_carrier = (
        kept.groupBy(F.col("carrier").alias("empresa"))
        .agg(
            total("n").alias("n"),
            total("n_dep_on_time", ~in_focus).alias("on_time_rest"),
            total("n_dep_delay", ~in_focus).alias("delay_rest"),
            total("n_dep_on_time", in_focus).alias("on_time_focus"),
            total("n_dep_delay", in_focus).alias("delay_focus"),
        )
        .where(F.col("n") >= min_flights)
        .select(
            "empresa",
            "n",
            pct_hundredths("on_time_rest", "delay_rest").alias("rest"),
            pct_hundredths("on_time_focus", "delay_focus").alias("focus"),
        )
    )
    return by_carrier.select(
        "empresa",
        F.col("n").alias("total_voos"),
        from_hundredths("rest").alias("pontualidade_media_anual"),
        from_hundredths("focus").alias("pontualidade_dezembro"),
        from_hundredths("focus - rest").alias("variacao_dez_pp"),
    ).orderBy("variacao_dez_pp", "empresa")


def carrier_year_evolution(
    facts: Facts,
    min_flights: int = MIN_FLIGHTS,
    years: tuple[str, str] = YEARS,
    phantom_pct: float = PHANTOM_PCT,
) -> DataFrame:
    """Two years side by side, largest punctuality gain first."""
    kept = operational_cells(
        facts.cells, year_of(F.col("ref_month")).alias("ano"), totals=facts.pairs, threshold=phantom_pct
    )
    per_year = []
    for year in years:
        in_year = F.col("ano") == year
        per_year += [
            total("n", in_year).alias(f"n_{year}"),
            total("n_dep_on_time", in_year).alias(f"on_time_{year}"),
            total("n_dep_delay", in_year).alias(f"delay_{year}"),
            total("n_cancelled", in_year).alias(f"cancelled_{year}"),
        ]
    by_carrier = (
        kept.groupBy(F.col("carrier").alias("empresa"))
        .agg(total("n").alias("n"), *per_year)
        .where(F.col("n") >= min_flights)
    )
    earlier, later = (
        pct_hundredths(f"on_time_{year}", f"delay_{year}") for year in years
    )
    return by_carrier.orderBy(F.desc(later - earlier), "empresa").select(
        "empresa",
        *[F.col(f"n_{year}").alias(f"voos_{year}") for year in years],
        *[
            pct(f"on_time_{year}", f"delay_{year}").alias(f"pontualidade_{year}")
            for year in years
        ],
        *[
            pct(f"cancelled_{year}", f"n_{year}").alias(f"cancelamento_{year}")
            for year in years
        ],
    )
