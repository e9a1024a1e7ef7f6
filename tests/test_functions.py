"""Rates, means, texts, labels."""

from decimal import ROUND_HALF_UP, Decimal
from fractions import Fraction

from pyspark.sql import functions as F

from flightpulse.functions.periods import label_or_code, monday_first
from flightpulse.functions.rates import mean1, pct, rounded_ratio
from flightpulse.functions.texts import one_decimal_text, percent_text, thousands_text


def half_away(value: Fraction, digits: int) -> Decimal:
    exact = Decimal(abs(value.numerator)) / Decimal(value.denominator)
    rounded = exact.quantize(Decimal(1).scaleb(-digits), rounding=ROUND_HALF_UP)
    return -rounded if value < 0 else rounded


def test_pct_is_exact(spark):
    pairs = spark.range(1, 401).select(F.col("id").alias("den")).withColumn(
        "num", F.explode(F.sequence(F.lit(0), F.col("den")))
    )
    for row in pairs.select("num", "den", pct("num", "den").alias("p")).collect():
        assert Decimal(str(row.p)) == half_away(Fraction(100 * row.num, row.den), 2), row


def test_pct_tie_and_zero(spark):
    frame = spark.createDataFrame([(201, 20000), (1, 0), (0, 5), (None, 3)], "num long, den long")
    found = [row.p for row in frame.select(pct("num", "den").alias("p")).collect()]
    assert found == [1.01, None, 0.0, None]


def test_mean_keeps_sign_and_size(spark):
    cases = [(-5, 100), (5, 100), (-15, 100), (7, 3), (-7, 3), (0, 4), (9, 0), (10**14, 10**12)]
    frame = spark.createDataFrame(cases, "s long, n long")
    for row in frame.select("s", "n", mean1("s", "n").alias("m")).collect():
        if row.n == 0:
            assert row.m is None
        else:
            assert Decimal(str(row.m)) == half_away(Fraction(row.s, row.n), 1), row


def test_rounded_ratio_half_away(spark):
    frame = spark.createDataFrame([(1, 2), (-1, 2), (3, 2), (-3, 2), (1, 3)], "a long, b long")
    found = [row.r for row in frame.select(F.expr(rounded_ratio("a", "b")).alias("r")).collect()]
    assert found == [1, -1, 2, -2, 0]


def test_texts_match_python_formatting(spark):
    frame = spark.range(0, 10001).selectExpr(
        "id / 100.0D AS p", "(id - 5000) / 10.0D AS m", "id * 98765 AS n"
    )
    rows = frame.select(
        "p",
        "m",
        "n",
        percent_text("p").alias("pt"),
        one_decimal_text("m", " min").alias("mt"),
        thousands_text("n").alias("nt"),
    ).collect()
    for row in rows:
        assert row.pt == f"{row.p:.1f}%"
        assert row.mt == f"{row.m:.1f} min"
        assert row.nt == f"{row.n:,}".replace(",", ".")


def test_texts_of_null(spark):
    frame = spark.createDataFrame([(None, None)], "p double, n long")
    row = frame.select(percent_text("p"), one_decimal_text("p", ""), thousands_text("n")).first()
    assert list(row) == [None, None, None]


def test_labels(spark):
    frame = spark.createDataFrame([("A",), ("B",), (None,)], "code string")
    found = [row[0] for row in frame.select(label_or_code(F.col("code"), {"A": "A (x)"})).collect()]
    assert found == ["A (x)", "B", None]
    assert [row[0] for row in frame.select(label_or_code(F.col("code"), {})).collect()] == ["A", "B", None]


def test_monday_first(spark):
    days = spark.range(7).select(F.col("id").cast("int").alias("d"))
    found = [row.d for row in days.orderBy(monday_first(F.col("d"))).collect()]
    assert found == [1, 2, 3, 4, 5, 6, 0]
