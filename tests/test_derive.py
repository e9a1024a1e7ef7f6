"""Delay minutes, categories and the other per-flight columns."""

from datetime import datetime, timedelta

import pytest

from flightpulse.operators.derive import CATEGORY_COUNTS, analytic, flight_cells
from flightpulse.plans.facts import facts_from_flights
from flightpulse.plans.quality import ingest_summary
from flightpulse.plans.seasonality import by_weekday

START = datetime(2024, 3, 10, 2, 15)  # inside a daylight-saving gap of some time zones

BY_SECONDS = [
    (-60, -1, "Antecipado"),
    (-30, -1, "Antecipado"),
    (-29, 0, "Pontual"),
    (0, 0, "Pontual"),
    (29, 0, "Pontual"),
    (30, 1, "Pontual"),
    (29 * 60, 29, "Pontual"),
    (29 * 60 + 30, 30, "Atraso 30-60"),
    (30 * 60, 30, "Atraso 30-60"),
    (59 * 60, 59, "Atraso 30-60"),
    (60 * 60, 60, "Atraso 60-120"),
    (119 * 60, 119, "Atraso 60-120"),
    (120 * 60, 120, "Atraso 120-240"),
    (239 * 60, 239, "Atraso 120-240"),
    (240 * 60, 240, "Atraso > 240"),
    (1440 * 60, 1440, "Atraso > 240"),
    (1441 * 60, 1441, "Atraso > 240"),
]


@pytest.mark.parametrize("zone", ["UTC", "America/Sao_Paulo", "America/New_York"])
def test_delay_and_category_edges(spark, make_flights, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        rows = [
            {
                "carrier": str(position),
                "sched_dep": START,
                "actual_dep": START + timedelta(seconds=seconds),
                "sched_arr": START,
                "actual_arr": START + timedelta(seconds=seconds),
            }
            for position, (seconds, _, _) in enumerate(BY_SECONDS)
        ]
        found = {int(row.carrier): row for row in analytic(make_flights(rows)).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    for position, (_, minutes, category) in enumerate(BY_SECONDS):
        row = found[position]
        assert (row.dep_delay_min, row.dep_category) == (minutes, category)
        assert (row.arr_delay_min, row.arr_category) == (minutes, category)
        assert row.next_day is (minutes > 1440)


def test_missing_times(make_flights):
    rows = [
        {"carrier": "neither"},
        {"carrier": "unscheduled", "actual_dep": "2024-01-01T10:00:00"},
        {"carrier": "not flown", "sched_dep": "2024-01-01T10:00:00"},
        {
            "carrier": "cancelled by status",
            "status": "CANCELADO",
            "sched_dep": "2024-01-01T10:00:00",
            "actual_dep": "2024-01-01T10:05:00",
        },
    ]
    found = {row.carrier: row for row in analytic(make_flights(rows)).collect()}
    assert found["neither"].dep_category == "Cancelado"
    assert found["unscheduled"].dep_category == "Sem horário previsto"
    assert found["not flown"].dep_category == "Cancelado"
    assert found["cancelled by status"].dep_category == "Pontual"
    for name in ("neither", "unscheduled", "not flown"):
        assert found[name].dep_delay_min is None
        assert found[name].next_day is False


def test_cell_counts_follow_the_categories(flights):
    """The number tests of the cells agree with the category texts, flight by flight."""
    from pyspark.sql import functions as F

    by_text = {
        row.dep_category: row.n
        for row in analytic(flights).groupBy("dep_category").agg(F.count("*").alias("n")).collect()
    }
    sums = flight_cells(flights).agg(*[F.sum(c).alias(c) for c in CATEGORY_COUNTS.values()]).first()
    assert {c: sums[m] for c, m in CATEGORY_COUNTS.items() if sums[m]} == by_text


def test_weekday_names(make_flights):
    days = [{"sched_dep": datetime(2024, 12, 1) + timedelta(days=d)} for d in range(7)]
    rows = by_weekday(facts_from_flights(make_flights([*days, {"carrier": "x"}]))).collect()
    assert [(row.dia_semana_num, row.dia_semana) for row in rows] == [
        (0, "Domingo"),
        (1, "Segunda"),
        (2, "Terca"),
        (3, "Quarta"),
        (4, "Quinta"),
        (5, "Sexta"),
        (6, "Sabado"),
    ]


def test_ingest_summary_skips_unscheduled(make_flights):
    rows = [{"sched_dep": "2024-05-01T00:00:00"}, {"sched_dep": "2024-02-01T12:30:00"}, {}]
    row = ingest_summary(facts_from_flights(make_flights(rows))).first()
    assert row.total_registros == 2
    assert (row.data_minima, row.data_maxima) == (
        datetime(2024, 2, 1, 12, 30),
        datetime(2024, 5, 1),
    )
