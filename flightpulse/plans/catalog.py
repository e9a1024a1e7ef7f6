"""All reports by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from . import airport_month, airports, carriers, dashboard, kpis, quality, seasonality
from .facts import Facts

REPORTS: dict[str, Callable[..., DataFrame]] = {
    report.__name__: report
    for report in (
        kpis.on_time_overall,
        kpis.cancel_overall,
        kpis.delay_mean_median,
        kpis.delay_category_share,
        kpis.year_compare,
        seasonality.by_calendar_month,
        seasonality.by_ref_month,
        seasonality.by_weekday,
        seasonality.worst_ref_month,
        seasonality.worst_weekday,
        seasonality.cancel_by_ref_month,
        airports.origin_top_volume,
        airports.origin_worst_on_time,
        airports.origin_most_cancelled,
        airports.origin_most_delayed,
        airports.dest_worst_arrival,
        airports.origin_volume_vs_on_time,
        airports.phantom_pairs_audit,
        airports.origin_worst_on_time_clean,
        airports.origin_most_cancelled_clean,
        carriers.carrier_top_volume,
        carriers.carrier_best_on_time,
        carriers.carrier_worst_on_time,
        carriers.carrier_most_cancelled,
        carriers.carrier_most_delayed,
        carriers.carrier_december_delta,
        carriers.carrier_year_evolution,
        airport_month.origin_month_matrix,
        airport_month.origin_december_delta,
        airport_month.worst_origin_months,
        airport_month.stable_origins,
        airport_month.dash_origin_month_heatmap,
        airport_month.dash_origin_month_grid,
        dashboard.dash_kpis,
        dashboard.dash_kpi_texts,
        dashboard.dash_by_month,
        dashboard.dash_by_weekday,
        dashboard.dash_origin_worst_on_time,
        dashboard.dash_origin_most_cancelled,
        dashboard.dash_carrier_on_time,
        quality.ingest_summary,
        quality.missing_schedule_by_month,
        quality.missing_schedule_by_carrier_month,
        quality.unscheduled_flights,
        quality.origin_month_coverage,
    )
}


def report(name: str, facts: Facts, **params) -> DataFrame:
    """A lazy report; nothing runs until the caller asks for rows."""
    return REPORTS[name](facts, **params)
