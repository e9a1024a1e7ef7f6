"""Flights derived from the ``lineitem`` test table (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def flights_from_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    lineitem = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    keys = lineitem.selectExpr(
        "l_linenumber",
        "l_orderkey",
        "least(l_partkey % 20, l_partkey % 31) AS o",
        "l_suppkey % 17 AS dst",
        "l_orderkey % 12 AS c",
        "(l_orderkey * 13 + l_partkey * 7 + l_linenumber * 101) % 100 AS d",
        "(l_orderkey * 31 + l_partkey * 3 + l_linenumber * 17) % 100 AS x",
        "(l_orderkey * 11 + l_suppkey * 5 + l_linenumber * 29) % 100 AS u",
        # The minutes stay within a day, so this is also the date of ``sched``.
        """date_add(DATE'2024-01-01',
             datediff(l_shipdate, TIMESTAMP_NTZ'1995-01-01 00:00:00') % 731) AS day""",
        """TIMESTAMP_NTZ'2024-01-01 00:00:00' + INTERVAL '1' MINUTE *
             ((datediff(l_shipdate, TIMESTAMP_NTZ'1995-01-01 00:00:00') % 731) * 1440
              + (l_partkey * 37 + l_linenumber * 61) % 1440) AS sched""",
    )
    flags = keys.selectExpr(
        "*",
        """CASE WHEN o = 3 AND c = 5 THEN x < 97
                WHEN o = 4 AND c = 6 THEN x < 90
                ELSE x < 4 END AS cx""",
        "CASE WHEN c = 9 THEN u < 60 ELSE u < 5 END AS ns",
        "concat(year(day), if(month(day) < 10, '-0', '-'), month(day)) AS ref_month",
        """CASE WHEN d < 30 THEN -(d % 13)
                WHEN d < 86 THEN d % 30
                WHEN d < 92 THEN 30 + (d * 7) % 30
                WHEN d < 96 THEN 60 + (d * 11) % 60
                WHEN d < 98 THEN 120 + (d * 13) % 120
                WHEN d < 99 THEN 240
                ELSE 1441 END AS base""",
    ).selectExpr(
        "*",
        "base + if(month(day) = 12 AND d >= 60, o, 0) AS dl",
        "cx OR x = 99 AS no_actual",
    )
    return flags.selectExpr(
        """CASE WHEN l_linenumber = 7 AND l_orderkey % 50 = 0 THEN NULL
                ELSE concat(if(c < 10, 'C0', 'C'), c) END AS carrier""",
        "concat(if(o < 10, 'P0', 'P'), o) AS origin",
        "concat(if(dst < 10, 'P0', 'P'), dst) AS dest",
        "CASE WHEN cx THEN 'CANCELADO' WHEN x >= 98 THEN 'NÃO INFORMADO' ELSE 'REALIZADO' END AS status",
        "CASE WHEN NOT ns THEN sched END AS sched_dep",
        "CASE WHEN NOT no_actual THEN sched + INTERVAL '1' MINUTE * dl END AS actual_dep",
        "CASE WHEN NOT ns THEN sched + INTERVAL '60' MINUTE END AS sched_arr",
        "CASE WHEN NOT no_actual THEN sched + INTERVAL '1' MINUTE * (55 + dl) END AS actual_arr",
        "ref_month",
    )
