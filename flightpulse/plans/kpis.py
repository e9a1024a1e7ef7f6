"""Overall punctuality, cancellation and delay figures."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.periods import year_of
from ..functions.rates import mean1, pct
from ..operators.cells import cancelled_pct, mean_delay, on_time_pct, roll_up
from ..operators.derive import CATEGORY_COUNTS, histogram
from ..operators.median import upper_median
from .facts import Facts


def on_time_overall(facts: Facts) -> DataFrame:
    """On-time share among the comparable flights."""
    return roll_up(facts.cells).select(
        F.coalesce(F.col("n_dep_delay"), F.lit(0)).alias("total_voos_comparaveis"),
        F.when(F.col("n_dep_delay") > 0, F.col("n_dep_on_time")).alias("pontuais"),
        on_time_pct().alias("taxa_pontualidade_pct"),
    )


def cancel_overall(facts: Facts) -> DataFrame:
    return roll_up(facts.cells).select(
        F.col("n").alias("total_voos"),
        F.col("n_cancelled").alias("cancelados"),
        cancelled_pct().alias("taxa_cancelamento_pct"),
    )


def delay_mean_median(facts: Facts) -> DataFrame:
    """Count, mean and upper median of the departure delay.

    One shuffle by delay minute feeds all three, so the reducers hold a few
    rows per distinct minute however many flights there are.
    """
    by_delay = histogram(facts.delays)
    median = upper_median(by_delay, "dep_delay_min", "n").scalar()
    return (
        by_delay.agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
            F.sum(F.col("dep_delay_min") * F.col("n")).alias("minutes"),
        )
        .select(
            F.col("n").alias("total_voos"),
            mean1("minutes", "n").alias("atraso_medio_min"),
            median.alias("atraso_mediano_min"),
        )
    )


def delay_category_share(facts: Facts) -> DataFrame:
    """Flights per departure category and their share of all flights."""
    pairs = chain.from_iterable((F.lit(c), F.col(m)) for c, m in CATEGORY_COUNTS.items())
    return (
        roll_up(facts.cells)
        .select("n", F.stack(F.lit(len(CATEGORY_COUNTS)), *pairs).alias("categoria_atraso_partida", "total"))
        .where(F.col("total") > 0)
        .select(
            "categoria_atraso_partida",
            "total",
            pct("total", "n").alias("pct_do_total"),
        )
        .orderBy(F.desc("total"), "categoria_atraso_partida")
    )


def year_compare(facts: Facts) -> DataFrame:
    return (
        roll_up(facts.cells, year_of(F.col("ref_month")).alias("ano"))
        .select(
            "ano",
            F.col("n").alias("total_voos"),
            on_time_pct().alias("taxa_pontualidade_pct"),
            cancelled_pct().alias("taxa_cancelamento_pct"),
            mean_delay().alias("atraso_medio_min"),
        )
        .orderBy("ano")
    )
