"""Every registered query against its SQL on DuckDB, with small thresholds."""

import pytest

import __spark_entry__ as entry_points
from check_oracle import connect, differences
from oracle import operator_sql, report_sql

MIN_FLIGHTS = 100


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.fixture(scope="module")
def sql():
    reports = report_sql(
        MIN_FLIGHTS, MIN_FLIGHTS, entry_points.EXCLUDED_ORIGIN, entry_points.LABELS, entry_points.FLAGGED
    )
    statements = {f"sql_{name}": reports[name] for name in entry_points.STATEMENTS}
    return {**reports, **statements, **operator_sql()}


@pytest.fixture(scope="module", autouse=True)
def small_thresholds():
    changed = [p for p in entry_points.PARAMETERS.values() if "min_flights" in p]
    before, of_year = [p["min_flights"] for p in changed], entry_points.MIN_FLIGHTS_OF_YEAR
    entry_points.MIN_FLIGHTS_OF_YEAR = MIN_FLIGHTS
    for params in changed:
        params["min_flights"] = MIN_FLIGHTS
    statement = entry_points.STATEMENT_PARAMETERS["carrier_best_on_time"]
    statement[0] = MIN_FLIGHTS
    yield
    statement[0] = entry_points.MIN_FLIGHTS
    for params, value in zip(changed, before):
        params["min_flights"] = value
    entry_points.MIN_FLIGHTS_OF_YEAR = of_year


# The training-data queries have tests of their own.
NAMES = [name for name in entry_points.queries() if name not in entry_points.TRAINING_QUERIES]


def test_names_match(sql):
    assert set(NAMES) == set(sql)
    assert set(entry_points.oracle_sql()) - set(NAMES) <= set(entry_points.TRAINING_QUERIES)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, sql, sf_dir, name):
    assert differences(entry_points.queries()[name](spark, sf_dir), duck, sql[name]) == []


def test_entry(spark):
    assert entry_points.entry(spark).columns == [
        "aeroporto",
        "mes",
        "pontualidade",
        "variacao_dez_pp",
        "nome_aeroporto",
        "nome_mes",
    ]
    assert entry_points.entry(spark).count() > 0
