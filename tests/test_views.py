"""The SQL views under their known names."""

import pytest
from pyspark.sql import functions as F

from flightpulse.operators.derive import analytic
from flightpulse.operators.exclusion import operational_cells
from flightpulse.plans.facts import facts_from_flights
from flightpulse.plans.views import register_views, source_named


@pytest.fixture(scope="module", autouse=True)
def views(spark, flights):
    register_views(spark, flights)


def test_columns(spark, flights):
    names = spark.table("vw_voos_analitico").columns
    assert names == [
        "ICAO Empresa Aérea",
        "ICAO Aeródromo Origem",
        "ICAO Aeródromo Destino",
        "Situação Voo",
        "Partida Prevista",
        "Partida Real",
        "Chegada Prevista",
        "Chegada Real",
        "ano_mes_referencia",
        "atraso_partida_min",
        "atraso_chegada_min",
        "categoria_atraso_partida",
        "categoria_atraso_chegada",
        "operado_dia_seguinte",
    ]
    assert spark.table("voos").columns == names[:9]
    assert spark.table("vw_voos_operacionais").columns == names


def test_rows(spark, flights):
    assert spark.table("voos").count() == flights.count()
    assert spark.table("vw_voos_analitico").count() == flights.count()
    kept = operational_cells(facts_from_flights(flights).cells).agg(F.sum("n")).first()[0]
    assert spark.table("vw_voos_operacionais").count() == kept < flights.count()


def test_not_in_gives_the_same_rows(spark, flights):
    """Spark's own NOT IN, which plans a nested loop, keeps the same flights."""
    rows = analytic(flights)
    rows.createOrReplaceTempView("seen")
    shares = flights.groupBy("origin", "carrier").agg(F.avg((F.col("status") == "CANCELADO").cast("int")).alias("share"))
    shares.where("share >= 0.85").createOrReplaceTempView("ghosts")
    kept = spark.sql("SELECT * FROM seen WHERE (origin, carrier) NOT IN (SELECT origin, carrier FROM ghosts)")
    expected, found = source_named(kept), spark.table("vw_voos_operacionais")
    assert found.exceptAll(expected).isEmpty() and expected.exceptAll(found).isEmpty()


def test_bound_parameters(spark, flights):
    frame = spark.sql(
        "SELECT count(*) AS n FROM vw_voos_analitico WHERE substr(ano_mes_referencia, 1, 4) IN (?, ?)",
        args=["2024", "2025"],
    )
    assert frame.first().n == flights.count()
    one = spark.sql(
        "SELECT count(*) AS n FROM vw_voos_analitico WHERE substr(ano_mes_referencia, 1, 4) = ?",
        args=["2024"],
    )
    assert one.first().n == analytic(flights).where(F.col("ref_month") < "2025").count()


def test_accented_names_in_double_quotes(spark, flights):
    """SQL written with double-quoted names runs once Spark reads them as names."""
    settings = ("spark.sql.ansi.enabled", "spark.sql.ansi.doubleQuotedIdentifiers")
    for name in settings:
        spark.conf.set(name, "true")
    try:
        frame = spark.sql(
            """SELECT "ICAO Aeródromo Origem" AS aeroporto, COUNT(*) AS total_voos
               FROM vw_voos_operacionais GROUP BY aeroporto ORDER BY total_voos DESC LIMIT 3"""
        )
        assert frame.count() == 3
    finally:
        for name in settings:
            spark.conf.unset(name)
