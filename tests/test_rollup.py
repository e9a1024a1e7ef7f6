"""Reports answered from the stored rollup, month refresh, streaming ingest."""

import pytest
from pyspark.sql import functions as F

from flightpulse.operators.derive import analytic
from flightpulse.operators.exclusion import operational_cells, operational_flights, phantom_pairs
from flightpulse.plans.catalog import REPORTS, report
from flightpulse.plans.facts import facts_from_flights
from flightpulse.plans.rollup import read_pair_totals, read_rollup, write_rollup
from flightpulse.plans.views import register_views
from flightpulse.sources.monthly_csv import read_monthly_directory
from flightpulse.sources.tables import read_flights, write_flights
from flightpulse.streaming.monthly_ingest import ingest_new_files, load_months
from plan_text import final_plan, nodes
from test_monthly_csv import write_file

SIZED = {"min_flights": 100}
TAKES_SIZE = {
    name for name, fn in REPORTS.items() if "min_flights" in fn.__code__.co_varnames[: fn.__code__.co_argcount]
} | {"dash_origin_month_grid"}


@pytest.fixture(scope="module")
def direct(flights):
    return facts_from_flights(flights)


@pytest.fixture(scope="module")
def stored(spark, direct, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("rollup"))
    write_rollup(direct, path)
    return read_rollup(spark, path)


@pytest.mark.parametrize("name", list(REPORTS))
def test_rollup_and_flights_agree(name, direct, stored):
    params = SIZED if name in TAKES_SIZE else {}
    expected = report(name, direct, **params).collect()
    assert report(name, stored, **params).collect() == expected
    if name not in {"phantom_pairs_audit"}:
        assert expected


def test_year_selection_prunes_rollup_months(stored):
    frame = report("dash_kpis", stored, years=("2025",))
    text = frame._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in text and "substring(ref_month" in text.split("PartitionFilters")[1]


def test_refresh_of_one_month(spark, flights, tmp_path):
    table, rollup = str(tmp_path / "flights"), str(tmp_path / "rollup")
    month = "2024-03"
    # March arrives incomplete at first.
    first = flights.where((F.col("ref_month") != month) | (F.col("origin") == "P01"))
    write_flights(first, table)
    write_rollup(facts_from_flights(read_flights(spark, table)), rollup)
    write_flights(flights.where(F.col("ref_month") == month), table, replace_all=False)
    assert read_flights(spark, table).count() == flights.count()
    write_rollup(facts_from_flights(read_flights(spark, table)), rollup, [month])
    whole = facts_from_flights(flights)
    for name in ("by_ref_month", "delay_mean_median", "ingest_summary"):
        assert report(name, read_rollup(spark, rollup)).collect() == report(name, whole).collect()


def test_list_from_stored_totals(spark, flights, direct, stored):
    kept = operational_flights(analytic(flights), phantom_pairs(stored.pairs))
    expected = operational_cells(direct.cells).agg(F.sum("n")).first()[0]
    assert kept.count() == expected
    # The size of the totals lets Spark broadcast the list: one flight scan, no flight is shuffled.
    lines = final_plan(kept)
    assert not nodes(lines, "SortMergeJoin")
    scan = next(i for i, line in enumerate(lines) if "lineitem" in line and "FileScan" in line)
    # A reused exchange is that of the list's own sums.
    exchanges = [line for line in lines[:scan] if "Exchange hashpartitioning" in line]
    assert not [line for line in exchanges if "ReusedExchange" not in line]


def test_streaming_ingest_loads_each_month_once(spark, tmp_path):
    raw, table = tmp_path / "raw", str(tmp_path / "flights")
    rollup, state = str(tmp_path / "rollup"), str(tmp_path / "state")
    raw.mkdir()

    def run():
        query = ingest_new_files(spark, str(raw), table, state, rollup)
        query.awaitTermination()
        assert query.exception() is None

    write_file(raw, "VRA_20241.csv", [{}, {"ICAO Empresa Aérea": "TAM"}])
    write_file(raw, "VRA_20242.csv", [{}])
    run()
    assert read_flights(spark, table).count() == 3
    write_file(raw, "VRA_20243.csv", [{}, {}, {}])
    write_file(raw, "VRA_202402.csv", [{}])  # a second file of an already loaded month
    run()
    run()  # nothing new
    counts = {
        row.ref_month: row.n
        for row in read_flights(spark, table).groupBy("ref_month").agg(F.count("*").alias("n")).collect()
    }
    assert counts == {"2024-01": 2, "2024-02": 2, "2024-03": 3}
    whole = facts_from_flights(read_monthly_directory(spark, str(raw)))
    for name in ("by_ref_month", "carrier_top_volume", "delay_mean_median"):
        assert report(name, read_rollup(spark, rollup)).collect() == report(name, whole).collect()


def test_new_month_changes_the_registered_views(spark, tmp_path):
    raw, table, rollup = tmp_path / "raw", str(tmp_path / "flights"), str(tmp_path / "rollup")
    raw.mkdir()
    ghost = {"ICAO Empresa Aérea": "GHO", "Situação Voo": "CANCELADO", "Partida Real": ""}
    write_file(raw, "VRA_20241.csv", [{}, {**ghost, "Situação Voo": "REALIZADO"}, ghost])
    load_months(spark, str(raw), table, {"2024-01"}, rollup)
    register_views(spark, read_flights(spark, table), read_pair_totals(spark, rollup))

    def counts():
        return [spark.table(name).count() for name in ("voos", "vw_voos_analitico", "vw_voos_operacionais")]

    assert counts() == [3, 3, 3]
    # Eleven more cancellations make GHO a phantom at 12 of 13, from the same views.
    write_file(raw, "VRA_20242.csv", [{}] + [ghost] * 11)
    load_months(spark, str(raw), table, {"2024-02"}, rollup)
    assert counts() == [15, 15, 2]


def test_extra_columns_reach_the_views(spark, tmp_path):
    from test_monthly_csv import HEADER

    raw, table = tmp_path / "raw", str(tmp_path / "flights")
    raw.mkdir()
    write_file(raw, "VRA_20241.csv", [{"Número Voo": "1234"}], [*HEADER, "Número Voo"])
    load_months(spark, str(raw), table, {"2024-01"})
    write_file(raw, "VRA_20242.csv", [{"Equipamento": "A320"}], ["Equipamento", *HEADER])
    load_months(spark, str(raw), table, {"2024-02"})
    register_views(spark, read_flights(spark, table))
    for name in ("voos", "vw_voos_analitico", "vw_voos_operacionais"):
        rows = spark.sql(f"SELECT ano_mes_referencia, `Número Voo`, Equipamento FROM {name} ORDER BY 1").collect()
        assert [tuple(row) for row in rows] == [("2024-01", "1234", None), ("2024-02", None, "A320")]
