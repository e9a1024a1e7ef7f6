"""Interrupted months: without flights, and with few."""

from flightpulse.plans.facts import facts_from_flights
from flightpulse.plans.quality import origin_month_coverage
from plan_text import final_plan, nodes


def test_months_of_low_volume(make_flights):
    volumes = {
        "P1": {"2024-01": 10, "2024-02": 10, "2024-03": 4, "2024-04": 5},  # upper median 10: only 4 is below half
        "P2": {"2024-01": 3, "2024-04": 3},
        "P3": {"2024-01": 8, "2024-02": 1, "2024-03": 1, "2024-04": 8},
    }
    rows = [
        {"origin": origin, "ref_month": month, "status": "REALIZADO"}
        for origin, months in volumes.items()
        for month, n in months.items()
        for _ in range(n)
    ]
    found = {
        row.aeroporto: (row.meses_com_voos, row.meses_no_periodo, row.interrompido, row.volume_tipico_mes, row.meses_baixo_volume)
        for row in origin_month_coverage(facts_from_flights(make_flights(rows))).collect()
    }
    assert found == {"P1": (4, 4, False, 10, 1), "P2": (2, 4, True, 3, 0), "P3": (4, 4, False, 8, 2)}


def test_no_flights(make_flights):
    assert origin_month_coverage(facts_from_flights(make_flights([]))).collect() == []


def test_one_scan(flights):
    lines = final_plan(origin_month_coverage(facts_from_flights(flights)))
    assert len(nodes(lines, "FileScan parquet")) + len(nodes(lines, "Scan parquet")) == 1


def test_no_window_over_all_origins(flights):
    lines = final_plan(origin_month_coverage(facts_from_flights(flights)))
    assert not nodes(lines, "Window") and nodes(lines, "ReusedExchange")
