import math
import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from flightpulse.llm import neighbours
from flightpulse.llm.neighbours import balanced_parts, grouped, nearest_neighbours, op7_neighbours, partitions

SCHEMA = "vec_id long, embedding array<float>"


def plain(rows, queries, nearest):
    answer = {}
    for q in queries:
        scored = sorted((-float((np.float64(v) * np.float64(rows[q])).sum()), i) for i, v in rows.items() if i != q)
        answer[q] = [(i, -s) for s, i in scored[:nearest]]
    return answer


def found_by(frame, **params):
    found = {}
    for r in sorted(nearest_neighbours(frame, F.col("vec_id") % 20 == 0, **params).collect(), key=lambda r: (r["query_id"], r["rank"])):
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(found[r["query_id"]])
    return found


def recall(found, expected):
    hit = sum(len({i for i, _ in found.get(q, [])} & {i for i, _ in rows}) for q, rows in expected.items())
    return hit / sum(map(len, expected.values()))


@pytest.mark.parametrize("block_rows", [64, 16384])
def test_recall_on_clusters_with_copies(spark, block_rows):
    draw = np.random.default_rng(1)
    centres = draw.normal(size=(40, 16))
    vectors = (centres[draw.integers(0, 40, 2400)] + 0.4 * draw.normal(size=(2400, 16))).astype(np.float32)
    vectors[::3] = vectors[0]  # a third of all rows is one vector
    rows = {i: v for i, v in enumerate(vectors)}
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in rows.items()], SCHEMA)
    found = found_by(frame, parts=16, block_rows=block_rows)
    expected = plain(rows, range(0, 2400, 20), 20)
    assert all(len(r) == 20 for r in found.values()) and set(found) == set(expected)
    assert recall(found, expected) >= 0.9
    same = next(q for q in expected if q % 3 == 0)
    assert [i for i, _ in found[same]] == [i for i in range(0, 90, 3) if i != same][:20]


def test_scores_and_order(spark, sf_dir):
    rows = {r["vec_id"]: np.array(r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()}
    found = {}
    for r in op7_neighbours(spark, sf_dir).collect():
        assert r["score"] == pytest.approx(float((rows[r["query_id"]] * rows[r["vec_id"]]).sum()), abs=1e-12)
        found.setdefault(r["query_id"], []).append((r["rank"], -r["score"], r["vec_id"]))
    assert all([x[1:] for x in sorted(f)] == sorted(x[1:] for x in f) for f in found.values())
    by_id = {q: [(i, s) for _, s, i in f] for q, f in found.items()}
    assert recall(by_id, plain(rows, [i for i in rows if i % 20 == 0], 20)) >= 0.9


def test_partitions_follow_the_rows():
    assert [partitions(n) for n in (0, 1, 100, 500, 2_000, 50_000, 10**6, 10**8)] == [1, 1, 2, 8, 16, 64, 256, 2048]


@pytest.mark.parametrize("size", ["sf0.01", "sf0.1"])
def test_learned_partitions_on_the_given_tables(spark, monkeypatch, size):
    """The method runs on them, with the recall asked for; most rows have no structure, so many partitions are probed."""
    used, compared = [], []
    monkeypatch.setattr(neighbours, "learned", lambda v, parts, recall, real=neighbours.learned: used.append((parts, v, real(v, parts, recall))) or used[-1][2])
    rows = {r["vec_id"]: np.array(r["embedding"]) for r in spark.read.parquet(f"/root/testdata/{size}/embeddings.parquet").collect()}
    found = {}
    for r in op7_neighbours(spark, f"/root/testdata/{size}").collect():
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    ((parts, vectors, (router, mass)),) = used
    assert parts == partitions(len(rows)) > 1
    logits = neighbours.routed(router, vectors)
    in_part = np.bincount(logits.argmax(1), minlength=parts)
    compared = ((neighbours.mass_before(logits) <= mass) * in_part).sum(1).mean() / len(vectors)
    reached = recall(found, plain(rows, [i for i in rows if i % 20 == 0], 20))
    print(f"{size}: {parts} partitions, recall {reached:.3f}, {compared:.0%} of rows compared")
    assert reached >= 0.9 and compared < 0.95


@pytest.mark.parametrize("parts", [1, 4])
def test_products_beyond_double_precision(spark, parts):
    """Huge components lose no rows: infinite products are largest and tie, others keep their order."""
    draw = np.random.default_rng(4)
    huge = draw.normal(size=(400, 6)) * 1e200
    huge[100:] = draw.normal(size=(300, 6))
    huge[200:, :] *= 10.0 ** draw.integers(-30, 30, (200, 1))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(huge)], "vec_id long, embedding array<double>")
    found = {}
    for r in nearest_neighbours(frame, F.col("vec_id") % 20 == 0, parts=parts).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(found) == set(range(0, 400, 20)) and all(len(rows) == 20 for rows in found.values())
    if parts == 1:
        for q, rows in found.items():
            with np.errstate(over="ignore", invalid="ignore"):
                scores = (huge * huge[q]).sum(1)
                small = ((huge / 1e150) * (huge[q] / 1e150)).sum(1)
                scores = np.where(np.isnan(scores), np.sign(small) * np.inf, scores)
            order = sorted((-s, i) for i, s in enumerate(scores.tolist()) if i != q)[:20]
            assert [i for _, i, _ in sorted(rows)] == [i for _, i in order]


def test_many_queries_are_cut_into_turns(spark):
    draw = np.random.default_rng(6)
    vectors = draw.normal(size=(600, 8)).astype(np.float32)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], SCHEMA)
    found = {}
    for r in nearest_neighbours(frame, F.lit(True), parts=1, block_rows=50).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    expected = plain(dict(enumerate(vectors)), range(600), 20)
    assert {q: [i for _, i in sorted(rows)] for q, rows in found.items()} == {q: [i for i, _ in rows] for q, rows in expected.items()}


def test_vectors_that_take_no_part(spark):
    good = [(i, [float(i % 7) - 3, 1.0, 0.5 * i]) for i in range(0, 45)]
    odd = [
        (100, None), (120, [0.0, 0.0, 0.0]), (140, [1.0, None, 2.0]), (160, [math.nan, 1.0, 1.0]), (180, [math.inf, 1.0, 1.0]),
        (None, [1.0, 2.0, 3.0]), (200, [1.0, 2.0]), (220, []),
    ]
    frame = spark.createDataFrame(good + odd + good[:10], SCHEMA).withColumn("rank", F.lit("x")).withColumn("part", F.lit("x"))
    found = found_by(frame)
    assert found == plain({i: np.float32(v) for i, v in good}, (0, 20, 40), 20)
    few = found_by(spark.createDataFrame(good[:4], SCHEMA))
    assert [i for i, _ in few[0]] == [i for i, _ in plain({i: np.float32(v) for i, v in good[:4]}, [0], 20)[0]] and len(few[0]) == 3
    assert found_by(spark.createDataFrame([], SCHEMA)) == {}


@pytest.mark.parametrize("parts", [2, 8, 32])
def test_parts_are_balanced_and_follow_the_graph(parts):
    draw = random.Random(0)
    group = [i % parts for i in range(40 * parts)]
    members = [[i for i, g in enumerate(group) if g == k] for k in range(parts)]
    graph = np.array([draw.sample(members[g], 6) for g in group])
    part = balanced_parts(graph, parts)
    sizes = np.bincount(part, minlength=parts)
    assert sizes.max() - sizes.min() <= 1
    kept = (part[graph] == part[:, None]).mean()
    assert kept > 0.85


def test_groups_hold_about_as_many_rows_as_a_block():
    assert grouped({0: 30, 1: 30, 2: 50, 3: 250, 4: 10, 5: 100}, 100) == {
        0: (0, 1), 1: (0, 1), 2: (1, 1), 3: (2, 3), 4: (3, 1), 5: (4, 1),
    }
    assert grouped({}, 100) == {}


def test_different_vectors_that_tie_give_the_smaller_ids(spark):
    draw = np.random.default_rng(8)
    bits = np.unique(draw.integers(0, 2, (300, 12)), axis=0)
    bits = draw.permutation(bits[bits.any(1)]).astype(float)
    rows = [(i, v.tolist()) for i, v in enumerate(bits)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = {}
    for r in nearest_neighbours(vectors, F.col("vec_id") < 20, nearest=5, parts=1).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    for i in range(20):
        order = sorted((-float(bits[j] @ bits[i]), j) for j in range(len(bits)) if j != i)[:5]
        assert [j for _, j in sorted(found[i])] == [j for _, j in order]
