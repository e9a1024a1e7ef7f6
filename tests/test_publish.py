"""Stored tables change all at once, or not at all."""

import pytest
from pyspark.sql import functions as F

from flightpulse.plans.facts import facts_from_flights
from flightpulse.plans.rollup import read_pair_totals, read_rollup, write_rollup
from flightpulse.plans.views import refresh_views, register_stored_views
from flightpulse.sources.monthly_csv import read_monthly_directory
from flightpulse.sources.publish import ConcurrentWrite, Publication, Store
from flightpulse.sources.tables import read_flights, stored_columns, write_flights
from flightpulse.streaming.monthly_ingest import load_months
from test_monthly_csv import HEADER, write_file


class Stopped(RuntimeError):
    pass


def failing_at(monkeypatch, step):
    """The write ends before its `step`-th store operation (data folders and the publication)."""
    done = []

    def counted(method):
        def run(self, *args):
            if len(done) == step:
                raise Stopped
            done.append(method.__name__)
            return method(self, *args)

        return run

    for name in ("write", "publish"):
        monkeypatch.setattr(Store, name, counted(getattr(Store, name)))


def totals(frame):
    return sorted(map(tuple, frame.groupBy("ref_month").agg(F.sum("n"), F.sum("n_cancelled")).collect()))


def test_flights_are_old_or_new(spark, make_flights, tmp_path, monkeypatch):
    path = str(tmp_path / "flights")
    first = make_flights([{"ref_month": m, "carrier": "GLO"} for m in ("2024-01", "2024-02")]).withColumn("Nota", F.lit("a"))
    write_flights(first, path)
    later = make_flights([{"ref_month": m, "carrier": "TAM"} for m in ("2024-02", "2024-03")]).withColumn("Equipamento", F.lit("x"))
    old = read_flights(spark, path)
    before = sorted(map(tuple, old.select("ref_month", "carrier", "Nota").collect()))
    for step in (0, 1):
        with monkeypatch.context() as patch, pytest.raises(Stopped):
            failing_at(patch, step)
            write_flights(later, path, replace_all=False)
        assert sorted(map(tuple, read_flights(spark, path).select("ref_month", "carrier", "Nota").collect())) == before
        assert "Equipamento" not in stored_columns(spark, path)
    write_flights(later, path, replace_all=False)
    rows = read_flights(spark, path).select("ref_month", "carrier", "Nota", "Equipamento").collect()
    assert sorted(map(tuple, rows)) == [("2024-01", "GLO", "a", None), ("2024-02", "TAM", None, "x"), ("2024-03", "TAM", None, "x")]
    assert sorted(map(tuple, old.select("ref_month", "carrier", "Nota").collect())) == before  # a frame keeps its state
    write_flights(later.limit(0), path, replace_all=False, months=["2024-02"])
    assert {row.ref_month for row in read_flights(spark, path).collect()} == {"2024-01", "2024-03"}
    write_flights(first, path)
    assert "Equipamento" not in stored_columns(spark, path)


def test_rollup_parts_belong_together(spark, make_flights, tmp_path, monkeypatch):
    path = str(tmp_path / "rollup")
    row = {"ref_month": "2024-01", "origin": "SBSP", "carrier": "GLO", "status": "CANCELADO"}
    write_rollup(facts_from_flights(make_flights([row])), path)
    more = facts_from_flights(make_flights([row] * 3 + [{**row, "ref_month": "2024-02"}]))
    for step in range(5):
        with monkeypatch.context() as patch, pytest.raises(Stopped):
            failing_at(patch, step)
            write_rollup(more, path, ["2024-01", "2024-02"])
        stored = read_rollup(spark, path)
        assert totals(stored.cells) == totals(stored.pairs) == [("2024-01", 1, 1)]
    write_rollup(more, path, ["2024-01", "2024-02"])
    stored = read_rollup(spark, path)
    assert totals(stored.cells) == totals(stored.pairs) == [("2024-01", 3, 3), ("2024-02", 1, 1)]
    assert stored.arrivals.agg(F.sum("n")).first()[0] == 4
    write_rollup(facts_from_flights(make_flights([])), path, ["2024-01"])
    assert totals(read_pair_totals(spark, path)) == [("2024-02", 1, 1)]


def test_pair_totals_need_no_scan_of_the_flights(spark, flights, tmp_path, monkeypatch):
    plans = []
    monkeypatch.setattr(Store, "write", lambda self, frame, part, real=Store.write: (plans.append((part, frame._jdf.queryExecution().toString())), real(self, frame, part))[1])
    write_rollup(facts_from_flights(flights), str(tmp_path / "rollup"))
    assert [part for part, plan in plans if "lineitem" in plan] == ["cells", "arrivals", "delays"]


def test_of_two_writers_one_is_told(spark, make_flights, tmp_path):
    path = str(tmp_path / "flights")
    write_flights(make_flights([{"carrier": "GLO"}]), path)
    store = Store(spark, path)
    before = store.current()
    write_flights(make_flights([{"carrier": "TAM"}]), path)
    with pytest.raises(ConcurrentWrite):
        store.publish(before, Publication(parts=before.parts, columns=before.columns))
    assert [row.carrier for row in read_flights(spark, path).collect()] == ["TAM"]
    assert [name for name in (tmp_path / "flights" / "_published").iterdir() if not name.name.endswith(".crc")].__len__() == 2


def test_folders_out_of_use_can_be_removed(spark, make_flights, tmp_path):
    path = str(tmp_path / "flights")
    for carrier in ("GLO", "TAM", "AZU"):
        write_flights(make_flights([{"carrier": carrier}]), path)
    assert len(Store(spark, path).remove_unpublished(keep=2)) == 1
    assert len(Store(spark, path).remove_unpublished()) == 1
    assert Store(spark, path).remove_unpublished() == []
    assert [row.carrier for row in read_flights(spark, path).collect()] == ["AZU"]


def test_a_folder_without_a_table_is_an_error(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        read_flights(spark, str(tmp_path))
    with pytest.raises(FileNotFoundError):
        read_rollup(spark, str(tmp_path))


def test_views_follow_months_and_columns(spark, tmp_path):
    raw, table, rollup = tmp_path / "raw", str(tmp_path / "flights"), str(tmp_path / "rollup")
    raw.mkdir()
    write_file(raw, "VRA_20241.csv", [{}])
    load_months(spark, str(raw), table, {"2024-01"}, rollup)
    register_stored_views(spark, table, rollup)
    views = ("voos", "vw_voos_analitico", "vw_voos_operacionais")
    assert all("Equipamento" not in spark.table(name).columns for name in views)
    write_file(raw, "VRA_20242.csv", [{"Equipamento": "A320"}], [*HEADER, "Equipamento"])
    write_flights(read_monthly_directory(spark, str(raw)), table)
    assert spark.table("voos").count() == 1  # until refreshed, views keep their state
    refresh_views(spark)
    for name in views:
        rows = spark.sql(f"SELECT ano_mes_referencia, Equipamento FROM {name} ORDER BY 1").collect()
        assert [tuple(row) for row in rows] == [("2024-01", None), ("2024-02", "A320")]
