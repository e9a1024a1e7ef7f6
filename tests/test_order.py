"""Row order of the reports; the SQL comparison looks at rows as a set."""

import pytest

from flightpulse.plans.airport_month import dash_origin_month_grid
from flightpulse.plans.catalog import report
from flightpulse.plans.facts import facts_from_flights

SIZED = {"min_flights": 100}

ASCENDING = {
    "year_compare": ("ano", {}),
    "by_calendar_month": ("mes", {}),
    "by_ref_month": ("ano_mes_referencia", {}),
    "by_weekday": ("dia_semana_num", {}),
    "cancel_by_ref_month": ("ano_mes_referencia", {}),
    "origin_worst_on_time": ("taxa_pontualidade_pct", SIZED),
    "dest_worst_arrival": ("taxa_pontualidade_chegada_pct", SIZED),
    "origin_volume_vs_on_time": ("rank_pontualidade", SIZED),
    "origin_worst_on_time_clean": ("taxa_pontualidade_pct", SIZED),
    "carrier_worst_on_time": ("taxa_pontualidade_pct", SIZED),
    "carrier_december_delta": ("variacao_dez_pp", SIZED),
    "origin_month_matrix": ("aeroporto", SIZED),
    "origin_december_delta": ("variacao_dez_pp", SIZED),
    "worst_origin_months": ("taxa_pontualidade_pct", SIZED),
    "dash_origin_month_heatmap": ("variacao_dez_pp", SIZED),
    "dash_origin_month_grid": ("variacao_dez_pp", SIZED),
    "dash_by_month": ("mes", {}),
    "dash_by_weekday": ("ordem", {}),
    "dash_origin_worst_on_time": ("taxa_pontualidade_pct", SIZED),
    "dash_origin_most_cancelled": ("taxa_cancelamento_pct", SIZED),
    "dash_carrier_on_time": ("taxa_pontualidade_pct", SIZED),
}
DESCENDING = {
    "delay_category_share": ("total", {}),
    "origin_top_volume": ("total_voos", {}),
    "origin_most_cancelled": ("taxa_cancelamento_pct", SIZED),
    "origin_most_delayed": ("atraso_medio_min", SIZED),
    "phantom_pairs_audit": ("total_voos", {"threshold": 50}),
    "origin_most_cancelled_clean": ("taxa_cancelamento_pct", SIZED),
    "carrier_top_volume": ("total_voos", {}),
    "carrier_best_on_time": ("taxa_pontualidade_pct", SIZED),
    "carrier_most_cancelled": ("taxa_cancelamento_pct", SIZED),
    "carrier_most_delayed": ("atraso_medio_min", SIZED),
    "stable_origins": ("variacao_dez_pp", SIZED),
}


def column(flights, name, key, params):
    rows = report(name, facts_from_flights(flights), **params).collect()
    assert len(rows) > 1
    return [row[key] for row in rows]


@pytest.mark.parametrize("name", list(ASCENDING))
def test_ascending(flights, name):
    key, params = ASCENDING[name]
    values = column(flights, name, key, params)
    assert values == sorted(values)


@pytest.mark.parametrize("name", list(DESCENDING))
def test_descending(flights, name):
    key, params = DESCENDING[name]
    values = column(flights, name, key, params)
    assert values == sorted(values, reverse=True)


def test_largest_gain_first(flights):
    rows = report("carrier_year_evolution", facts_from_flights(flights), **SIZED).collect()
    gains = [round(100 * (row.pontualidade_2025 - row.pontualidade_2024)) for row in rows]
    assert len(rows) > 1 and gains == sorted(gains, reverse=True)


def test_null_rates(make_flights):
    """A group without comparable flights has no rate: first when ascending, last when descending."""
    flown = {"sched_dep": "2024-01-01T10:00:00", "actual_dep": "2024-01-01T10:05:00"}
    rows = [{"origin": "X", "carrier": "A", "status": "CANCELADO"}]
    rows += [{"origin": "Y", "carrier": "A", **flown}]
    rows += [{"origin": None, "carrier": "A", **flown}]
    facts = facts_from_flights(make_flights(rows))
    worst = report("origin_worst_on_time", facts, min_flights=1).collect()
    assert [(row.aeroporto, row.taxa_pontualidade_pct) for row in worst] == [
        ("X", None),
        (None, 100.0),
        ("Y", 100.0),
    ]
    ranks = report("origin_volume_vs_on_time", facts, min_flights=1).collect()
    assert [(row.aeroporto, row.rank_pontualidade) for row in ranks] == [("X", 1), (None, 2), ("Y", 2)]


def test_no_flights_at_all(make_flights):
    facts = facts_from_flights(make_flights([]))
    assert list(report("on_time_overall", facts).first()) == [0, None, None]
    assert list(report("cancel_overall", facts).first()) == [0, None, None]
    assert list(report("delay_mean_median", facts).first()) == [0, None, None]
    assert list(report("dash_kpis", facts).first()) == [0, None, None, None]
    assert report("delay_category_share", facts).collect() == []
    assert report("dash_origin_month_heatmap", facts).collect() == []


def test_a_null_origin_takes_a_place_but_is_not_shown(make_flights):
    rows = [{"origin": None, "carrier": "A"}] * 3 + [{"origin": "X", "carrier": "A"}] * 2
    rows += [{"origin": "Y", "carrier": "A"}]
    facts = facts_from_flights(make_flights(rows))
    months = report("origin_month_matrix", facts, min_flights=1, k=2).collect()
    assert [row.aeroporto for row in months] == ["X"]


def test_missing_months_are_null_in_the_grid(make_flights):
    flown = {"sched_dep": "2024-01-01T10:00:00", "actual_dep": "2024-01-01T10:05:00"}
    rows = [
        {"origin": "SBSP", "carrier": "A", "ref_month": "2024-01", **flown},
        {"origin": "SBSP", "carrier": "A", "ref_month": "2024-12", **flown},
        {"origin": "SBPA", "carrier": "A", "ref_month": "2024-12", **flown},
    ]
    facts = facts_from_flights(make_flights(rows))
    grid = report("dash_origin_month_grid", facts, min_flights=1).collect()
    assert [row.nome_aeroporto for row in grid] == ["SBSP (Congonhas)"]
    assert (grid[0].Jan, grid[0].Fev, grid[0].Dez) == (100.0, None, 100.0)


def test_grid_puts_origins_without_a_change_last(make_flights):
    """An origin with no December has no change; it comes after all others."""
    times = {"sched_dep": "{m}-05 10:00:00", "actual_dep": "{m}-05 10:05:00"}
    rows = [
        {"origin": origin, "carrier": "C1", "status": "REALIZADO", "ref_month": month, **{k: v.format(m=month) for k, v in times.items()}}
        for origin, months in (("P1", ("2024-01", "2024-12")), ("P2", ("2024-01", "2024-02")), ("P3", ("2024-03", "2024-12")))
        for month in months
        for _ in range(3)
    ]
    grid = dash_origin_month_grid(facts_from_flights(make_flights(rows)), min_flights=1).collect()
    assert [row.nome_aeroporto for row in grid] == ["P1", "P3", "P2"]
    assert grid[-1].variacao_dez_pp is None
