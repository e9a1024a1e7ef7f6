import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from flightpulse.llm.shared import table
from flightpulse.llm.whitening import op12_whitening, refined_eigenvectors, whitened

SCHEMA = "vec_id long, embedding array<float>"


def rotated(values, seed=3):
    """A symmetric matrix with the given eigenvalues, worked out in extended precision."""
    draw = np.random.default_rng(seed)
    q = np.linalg.qr(draw.normal(size=(len(values), len(values))))[0].astype(np.longdouble)
    for _ in range(3):  # orthogonal to extended precision
        q = q @ (1.5 * np.eye(len(values)) - 0.5 * (q.T @ q))
    return (q * np.array(values, np.longdouble)) @ q.T, q


@pytest.mark.parametrize(
    "values",
    [
        [9.0, 5.0, 2.0, 1.0, 0.5],
        [3.0, 3.0, 3.0, 1.0, 1.0, 0.0],
        [1.0, 1.0 - 1e-6, 1.0 - 2e-6, 0.5, 0.5 - 1e-9, 1e-3],
        [1.0, 1.0 - 1e-12, 0.25],
        list(np.linspace(1, 2, 40)),
        [7.0] * 8,
        [1e12, 1.0, 1e-3],
        [2.0],
    ],
)
def test_eigenvectors_are_right_to_double_precision(values):
    matrix, q = rotated(values)
    found, vectors = refined_eigenvectors(matrix)
    order = np.argsort(-np.array(values), kind="stable")
    want, scale = np.array(values)[order], max(np.abs(values))
    assert np.abs(found - want).max() <= 4e-16 * scale
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-14
    residual = matrix @ vectors.astype(np.longdouble) - vectors * found.astype(np.longdouble)
    assert np.abs(residual).max() <= 4e-16 * scale * math.sqrt(len(values))
    for k, value in enumerate(want):
        gap = min((abs(value - other) for j, other in enumerate(want) if j != k), default=scale) / scale
        if gap > 1e-11:  # the vector itself, where the matrix's own rounding leaves it defined
            assert abs(abs(float(q[:, order[k]] @ vectors[:, k])) - 1) < 1e-14
            sign = np.sign(float(q[:, order[k]] @ vectors[:, k]))
            assert np.abs(vectors[:, k] * sign - q[:, order[k]]).max() <= 4e-16 + 4e-18 / gap


def test_zero_and_empty_matrices():
    assert (refined_eigenvectors(np.zeros((3, 3)))[1] == np.eye(3)).all()
    assert refined_eigenvectors(np.zeros((0, 0)))[0].size == 0


def plain(rows, components=4):
    """vec_id and component to n, deviation, whitened, explained by exact sums and numpy's own eigenvectors."""
    kept = [(i, [math.floor(256 * float(c)) for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    mean = np.array([s / n for s in sums])
    centred = np.array(fit, float) - mean
    covariance = centred.T @ centred / n
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    out = []
    for i, x in kept:
        deviation = sum((n * c - s) ** 2 for c, s in zip(x, sums))
        for k in range(components):
            score = (np.array(x) - mean) @ vectors[:, k] / math.sqrt(values[k])
            out.append((i, k + 1, n, deviation, score, values[k] / values.sum()))
    return out


def compare(found, want):
    found = sorted(map(tuple, found), key=lambda r: (r[0] is None, r[0] or 0, r[1], abs(r[4])))
    want = sorted(want, key=lambda r: (r[0] is None, r[0] or 0, r[1], abs(r[4])))
    assert [r[:4] for r in found] == [r[:4] for r in want]
    for k in {r[1] for r in want}:
        a = np.array([r[4] for r in found if r[1] == k])
        b = np.array([r[4] for r in want if r[1] == k])
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-9
    assert np.allclose([r[5] for r in found], [r[5] for r in want], rtol=1e-9)
    assert all(abs(r[6]) < 1e-9 for r in found)


def test_query_equals_the_plain_version(spark, mid_dir):
    rows = [tuple(r) for r in table(spark, mid_dir, "embeddings").select("vec_id", "embedding").collect()]
    compare(op12_whitening(spark, mid_dir).collect(), plain(rows))


def test_odd_vectors(spark):
    draw = np.random.default_rng(5)
    good = [(k, [float(c) for c in draw.normal(size=5) * [1, 2, 3, 4, 5]]) for k in range(40)]
    good += [(3, good[3][1]), (None, good[4][1]), (41, [-0.0] * 5), (42, [0.0] * 5), (43, [c + 1e-5 for c in good[5][1]])]
    odd = [(90, None), (91, []), (92, [1.0, None, 1.0, 1.0, 1.0]), (93, [float("nan")] * 5), (94, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (95, [1.0] * 4)]
    frame = spark.createDataFrame(good + odd, SCHEMA).repartition(3)
    for name in ("x", "n", "k", "component", "vector"):
        frame = frame.withColumn(name, F.lit("extra"))
    stored_floats = [tuple(r) for r in frame.select("vec_id", "embedding").collect() if r[1] is None or len(r[1]) == 5]
    compare(whitened(frame).collect(), plain(stored_floats))


def test_no_variance_huge_entries_and_no_rows(spark):
    assert whitened(spark.createDataFrame([], SCHEMA)).collect() == []
    assert whitened(spark.createDataFrame([(1, None), (2, [float("nan")])], SCHEMA)).collect() == []
    assert whitened(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], SCHEMA)).collect() == []
    line = whitened(spark.createDataFrame([(k, [float(k), 2.0 * k, 7.0]) for k in range(4)], SCHEMA)).collect()
    assert {r["component"] for r in line} == {1} and {r["explained"] for r in line} == {1.0}
    huge = whitened(spark.createDataFrame([(1, [1e30, 1.0]), (2, [-1e30, 2.0]), (3, [0.0, 5.0])], SCHEMA)).collect()
    by_id = {r["vec_id"]: r for r in huge if r["component"] == 1}
    assert by_id[1]["deviation"] is None and by_id[1]["whitened"] == pytest.approx(-by_id[2]["whitened"])
    big = whitened(spark.createDataFrame([(k, [2.0**20 * k, 1.0 * (k % 3)]) for k in range(6)], SCHEMA)).collect()
    x = [(256 * 2**20 * k, 256 * (k % 3)) for k in range(6)]
    sums = [sum(c) for c in zip(*x)]
    assert {r["vec_id"]: r["deviation"] for r in big} == {
        k: d if d < 1 << 63 else None for k in range(6) for d in [sum((6 * c - s) ** 2 for c, s in zip(x[k], sums))]
    }
