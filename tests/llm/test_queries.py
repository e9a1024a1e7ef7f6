import sys

import pytest

import __spark_entry__ as entry_points
from check_oracle import connect, differences
from flightpulse.llm.registry import ORACLE_SQL, QUERIES


def test_every_operator_is_registered():
    names = entry_points.queries()
    assert sorted(int(name[2:].split("_")[0]) for name in names if name.startswith("op") and name[2].isdigit()) == list(range(1, 14))
    assert "pipeline" in names and set(ORACLE_SQL) <= set(QUERIES) <= set(names)
    assert set(ORACLE_SQL) <= set(entry_points.oracle_sql())


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_query_equals_its_sql(spark, sf_dir, name):
    assert differences(QUERIES[name](spark, sf_dir), connect(sf_dir), ORACLE_SQL[name]) == []


def test_entry_points_work_without_the_subpackage(monkeypatch):
    import importlib

    with monkeypatch.context() as m:
        m.setitem(sys.modules, "corpus_pipeline", None)
        bare = importlib.reload(entry_points)
        assert not [n for n in bare.queries() if n.startswith(("op1_", "pipeline"))] and "dash_kpis" in bare.queries()
    importlib.reload(entry_points)
    assert "pipeline" in entry_points.queries()
