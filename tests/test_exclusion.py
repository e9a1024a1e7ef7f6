"""Null-aware pair exclusion."""

import random
from itertools import product

import pytest
from pyspark.sql import functions as F

from flightpulse.operators.derive import flight_cells
from flightpulse.operators.exclusion import exclude_pairs, operational_cells, phantom_pairs
from flightpulse.plans.airports import phantom_pairs_audit
from flightpulse.plans.facts import facts_from_flights
from plan_text import final_plan, nodes

DOMAIN = ("a", "b", None)
ALL_PAIRS = list(product(DOMAIN, DOMAIN))


def equal(x, y):
    return None if x is None or y is None else x == y


def not_in(row, pairs) -> bool:
    """SQL's three-valued ``row NOT IN pairs`` is true."""
    for pair in pairs:
        tests = [equal(x, y) for x, y in zip(row, pair)]
        matched = False if False in tests else (None if None in tests else True)
        if matched is not False:
            return False
    return True


def kept_rows(spark, rows, pairs):
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, x string, y string")
    listed = spark.createDataFrame(pairs, "x string, y string")
    return sorted(row.id for row in exclude_pairs(frame, listed, "x", "y").collect())


CASES = [
    [],
    [("a", "b")],
    [(None, "a")],
    [("a", None)],
    [(None, None)],
    [("a", "a"), ("b", None)],
    [("a", "b"), (None, "a"), ("b", None)],
    [("a", "b"), ("a", "b")],
]


@pytest.mark.parametrize("pairs", CASES, ids=str)
def test_against_three_valued_logic(spark, pairs):
    expected = [i for i, row in enumerate(ALL_PAIRS) if not_in(row, pairs)]
    assert kept_rows(spark, ALL_PAIRS, pairs) == expected


@pytest.mark.parametrize("seed", range(6))
def test_random_pairs(spark, seed):
    pick = random.Random(seed)
    values = ["p", "q", "r", "s", None]
    pairs = [(pick.choice(values), pick.choice(values)) for _ in range(pick.randint(1, 4))]
    rows = [(pick.choice(values), pick.choice(values)) for _ in range(60)]
    expected = [i for i, row in enumerate(rows) if not_in(row, pairs)]
    assert kept_rows(spark, rows, pairs) == expected


def test_same_result_without_broadcast(spark):
    pairs = [("a", "b"), ("b", None)]
    settings = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for name in settings:
        spark.conf.set(name, "-1")
    try:
        expected = [i for i, row in enumerate(ALL_PAIRS) if not_in(row, pairs)]
        assert kept_rows(spark, ALL_PAIRS, pairs) == expected
    finally:
        for name in settings:
            spark.conf.unset(name)


def test_plan_has_no_nested_loop_and_two_scans(flights):
    lines = final_plan(operational_cells(flight_cells(flights), "ref_month"))
    assert not nodes(lines, "BroadcastNestedLoopJoin") and not nodes(lines, "CartesianProduct")
    # One scan for the rows, one narrow scan for the pair list, however often it is used.
    assert len(nodes(lines, "FileScan")) == 2
    assert nodes(lines, "ReusedExchange")


def test_rows_meet_the_list_in_one_join(flights):
    pairs = phantom_pairs(flight_cells(flights))
    lines = final_plan(exclude_pairs(flights, pairs, "origin", "carrier"))
    assert len([line for line in lines if "Join" in line]) == 1


def test_nothing_is_joined_or_tested_before_the_pre_aggregation(flights):
    """Below the first shuffle of the flights there are only projections and partial sums."""
    lines = final_plan(operational_cells(flight_cells(flights), "ref_month"))
    shuffle = next(
        i for i, line in enumerate(lines) if "Exchange hashpartitioning" in line and "ref_month" in line
    )
    scan = next(i for i in range(shuffle, len(lines)) if "FileScan" in lines[i])
    between = lines[shuffle + 1 : scan]
    assert not [line for line in between if "Join" in line or "Filter" in line]


def test_thresholds_rounded_and_unrounded(make_flights):
    """94.996 % reaches 95 when rounded, not when exact."""
    n, cancelled = 25_000, 23_749
    base = make_flights([{"origin": "O", "carrier": "X", "status": "CANCELADO"}])
    other = make_flights([{"origin": "O", "carrier": "X", "status": "REALIZADO"}])
    flights = base.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(cancelled)))).unionAll(
        other.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(n - cancelled))))
    )
    facts = facts_from_flights(flights)
    audit = phantom_pairs_audit(facts).collect()
    assert [(r.aeroporto, r.empresa, r.total_voos, r.taxa_cancelamento_pct) for r in audit] == [
        ("O", "X", n, 95.0)
    ]
    assert phantom_pairs(facts.cells, 95).count() == 0
    assert phantom_pairs(facts.cells, 85).count() == 1


def test_pair_list_ignores_the_row_restriction(make_flights):
    """A pair flown only in 2025 but cancelled overall stays excluded for 2025."""
    rows = [{"origin": "O", "carrier": "X", "status": "CANCELADO", "ref_month": "2024-01"}] * 9
    rows += [{"origin": "O", "carrier": "X", "status": "REALIZADO", "ref_month": "2025-01"}]
    rows += [{"origin": "O", "carrier": "Y", "status": "REALIZADO", "ref_month": "2025-01"}]
    cells = flight_cells(make_flights(rows))
    kept = operational_cells(cells, only=F.col("ref_month").startswith("2025")).collect()
    assert [(row.origin, row.carrier, row.n) for row in kept] == [("O", "Y", 1)]
