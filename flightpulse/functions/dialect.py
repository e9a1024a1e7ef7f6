"""SQL functions and settings for statements in the dialect the reports were first written in."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

# Day number of 1970-01-01 00:00:00, and the seconds of a day.
_EPOCH_DAY = "2440587.5D"
_DAY_SECONDS = "86400.0D"
# What each conversion of a time format stands for; ``t`` is the time. A doubled percent sign comes last.
_CONVERSIONS = {
    "%Y": "date_format(t, 'yyyy')",
    "%m": "date_format(t, 'MM')",
    "%d": "date_format(t, 'dd')",
    "%H": "date_format(t, 'HH')",
    "%M": "date_format(t, 'mm')",
    "%S": "date_format(t, 'ss')",
    "%j": "date_format(t, 'DDD')",
    "%w": "CAST(dayofweek(t) - 1 AS STRING)",
    "%s": "CAST(timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', t) AS STRING)",
    "%%": "'%'",
}


def _formatted() -> str:
    text = "format"
    for conversion, value in _CONVERSIONS.items():
        text = f"replace({text}, '{conversion}', {value})"
    return text


def register_sql_functions(spark: SparkSession) -> None:
    """``julianday(time)`` and ``strftime(format, time)`` for this session's SQL.

    Both are SQL expressions, expanded into the plan: no Python, and a filter or
    a column list reaches the scan as if they had been written out.
    """
    spark.sql(
        f"""CREATE OR REPLACE TEMPORARY FUNCTION julianday(t TIMESTAMP_NTZ) RETURNS DOUBLE
        RETURN timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', t) / {_DAY_SECONDS} + {_EPOCH_DAY}"""
    )
    spark.sql(
        f"""CREATE OR REPLACE TEMPORARY FUNCTION strftime(format STRING, t TIMESTAMP_NTZ) RETURNS STRING
        RETURN {_formatted()}"""
    )


def dialect_sql(spark: SparkSession, statement: str, args: Sequence | None = None) -> DataFrame:
    """A statement in that dialect: names in double quotes, its two time functions, and no number but whole and double.

    The session is left as it was. A division by zero is an error in Spark's
    strict mode; write ``NULLIF`` around a divisor that can be zero.
    """
    register_sql_functions(spark)
    settings = {
        # Double-quoted names belong to the strict mode, whose other checks only apply to what runs under it.
        "spark.sql.ansi.enabled": "true",
        "spark.sql.ansi.doubleQuotedIdentifiers": "true",
    }
    before = {name: spark.conf.get(name, None) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        frame = spark.sql(statement, args=list(args) if args else None)
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    decimals = [f.name for f in frame.schema.fields if isinstance(f.dataType, DecimalType)]
    return frame.withColumns({name: F.col(f"`{name}`").cast("double") for name in decimals}) if decimals else frame
