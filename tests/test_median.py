"""Upper median by histogram."""

import random

import pytest
from pyspark.sql import functions as F

from flightpulse.operators.median import upper_median
from flightpulse.plans.facts import facts_from_flights
from flightpulse.plans.kpis import delay_mean_median
from plan_text import final_plan, nodes


def median_of(spark, values):
    frame = spark.createDataFrame([(v,) for v in values], "v long")
    histogram = frame.groupBy("v").agg(F.count("*").alias("n"))
    return upper_median(histogram, "v", "n").first()[0]


@pytest.mark.parametrize(
    "values",
    [
        [10, 11, 12, 13],
        [5],
        [1, 2],
        [-3, -3, 7],
        [-(10**9), -70_000, -1, 0, 65_535, 65_536, 10**9],
        [65_536] * 5 + [-65_537] * 5,
    ],
    ids=str,
)
def test_small_lists(spark, values):
    assert median_of(spark, values) == sorted(values)[len(values) // 2]


@pytest.mark.parametrize("seed", range(4))
def test_random_lists(spark, seed):
    pick = random.Random(seed)
    spread = pick.choice([5, 1000, 500_000])
    values = [pick.randint(-spread, spread) for _ in range(pick.randint(1, 300))]
    assert median_of(spark, values) == sorted(values)[len(values) // 2]


def test_no_delays(make_flights):
    row = delay_mean_median(facts_from_flights(make_flights([{"carrier": "x"}]))).first()
    assert list(row) == [0, None, None]


def test_report_agrees_with_discrete_percentile(spark, flights):
    facts = facts_from_flights(flights)
    facts.delays.createOrReplaceTempView("delays_for_median")
    expected = spark.sql(
        "SELECT percentile_disc(0.5) WITHIN GROUP (ORDER BY dep_delay_min DESC) FROM delays_for_median"
    ).first()[0]
    assert delay_mean_median(facts).first().atraso_mediano_min == expected


def test_histogram_is_read_once(flights):
    frame = delay_mean_median(facts_from_flights(flights))
    assert len(nodes(final_plan(frame), "FileScan")) == 1
