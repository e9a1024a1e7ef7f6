"""Whitening of embeddings by the principal components of their covariance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flightpulse.llm.shared import stored, table

COMPONENTS = 4
SCALE = 256
#: Refinement steps at most; from single precision, four or five are the rule.
STEPS = 16
#: Matrices of double precision that an extended one is cut into for products.
SLICES = 4

_LIMIT = 1 << 62


def _slices(m: np.ndarray, axis: int, bits: int) -> list[np.ndarray]:
    """Matrices of double precision that add up to `m`, each with `bits` bits an entry along `axis`."""
    found = []
    for _ in range(SLICES):
        _, exponent = np.frexp(np.abs(m).max(axis=axis, keepdims=True, initial=0))
        part = np.ldexp(np.rint(np.ldexp(m, bits - exponent)), exponent - bits)
        found.append(part.astype(np.float64))
        m = m - part
    return found


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b in extended precision: products of slices whose sums are exact in double precision."""
    bits = (53 - int(np.ceil(np.log2(max(2, a.shape[1]))))) // 2 - 1
    left, right = _slices(a, 1, bits), _slices(b, 0, bits)
    total = np.zeros((a.shape[0], b.shape[1]), np.longdouble)
    for order in reversed(range(SLICES)):
        for i in range(order + 1):
            total += left[i] @ right[order - i]
    return total


def _clusters(values: np.ndarray, width: float) -> list[np.ndarray]:
    """Positions of ascending values, split where neighbours are further apart than `width`."""
    return np.split(np.arange(len(values)), np.flatnonzero(np.diff(values) > width) + 1)


def refined_eigenvectors(matrix: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, largest first, and unit eigenvectors (columns) of a symmetric matrix, to double precision.

    Eigenvectors in single precision are corrected by iterations of matrix products in extended precision
    (Ogita and Aishima 2018): from the errors of orthogonality and of diagonality follows a correction of
    each vector along every other one, which squares the error at each step. Vectors whose eigenvalues lie closer
    together than the present error can tell are a cluster: they are only made orthogonal, and the
    shifted matrix on their subspace is solved by itself, which turns them into place (the second part of 2019).
    A vector's largest entry is positive.
    """
    a = np.asarray(matrix, np.longdouble)
    size = len(a)
    scale = np.abs(a).max(initial=0)
    if not scale:
        return np.zeros(size), np.eye(size)
    a = (a + a.T) / (2 * scale)
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(np.longdouble)
    eye = np.eye(size, dtype=np.longdouble)
    tiny = size * np.finfo(np.longdouble).eps
    norm = np.linalg.norm(a.astype(np.float64), 2)
    errors = [np.inf]
    for _ in range(steps):
        image = product(a, x)
        s, r = product(x.T, image), eye - product(x.T, x)
        values = np.diag(s) / (1 - np.diag(r))
        order = np.argsort(values, kind="stable")
        x, values = x[:, order], values[order]
        s, r = s[np.ix_(order, order)], r[np.ix_(order, order)]
        off = s - np.diag(values)
        # what the present vectors can tell apart
        width = 2 * (np.linalg.norm(off.astype(np.float64), 2) + norm * np.linalg.norm(r.astype(np.float64), 2))
        gap = values[None, :] - values[:, None]
        near = np.abs(gap) <= width
        correction = np.where(near, r / 2, (s + values[None, :] * r) / np.where(near, 1, gap))
        errors.append(float(max(np.abs(r).max(), np.abs(np.where(near, off, correction)).max())))
        if errors[-1] <= tiny or (len(errors) > 4 and min(errors[-2:]) > min(errors[:-2]) / 2):  # as far as the precision goes
            break
        x = x + product(x, correction)
        for members in _clusters(values, width):
            if len(members) > 1:
                block = x[:, members]
                shift = values[members].mean()
                inner = product(block.T, product(a, block) - shift * block)
                rest = np.abs(inner - np.diag(np.diag(inner))).max()
                if rest > tiny:
                    inner = (inner + inner.T) / 2
                    turn = np.linalg.eigh((inner / np.abs(inner).max()).astype(np.float64))[1]
                    x[:, members] = product(block, turn.astype(np.longdouble))
    x = product(x, 1.5 * eye - 0.5 * product(x.T, x))
    x = x / np.sqrt((x * x).sum(0))
    values = (x * product(a, x)).sum(0) * scale
    order = np.argsort(-values, kind="stable")
    x = x[:, order].astype(np.float64)
    x *= np.where(x[np.abs(x).argmax(0), np.arange(size)] < 0, -1.0, 1.0)
    return values[order].astype(np.float64), x


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def _sums(size: int):
    """Exact sums of each dimension over a task's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * size
        for batch in batches:
            x = _matrix(batch.column("x"), size)
            if not len(x):
                continue
            wide = len(x) * max(int(x.max()), -int(x.min())) >= _LIMIT
            for k, part in enumerate((x.astype(object) if wide else x).sum(0).tolist()):
                total[k] += part
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(size), pa.int32()), pa.array(total, pa.decimal128(38, 0))], names=["k", "total"]
        )

    return run


def _products(size: int, columns: int, centred):
    """Sums of products of all pairs of columns of `centred(x)` over a task's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((columns, columns))
        for batch in batches:
            c = centred(_matrix(batch.column("x"), size))
            total += c.T @ c
        i, j = np.triu_indices(columns)
        yield pa.RecordBatch.from_arrays(
            [pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], names=["i", "j", "value"]
        )

    return run


def _summed_products(fit: DataFrame, size: int, columns: int, centred) -> np.ndarray:
    """The products over all rows; what reaches the driver depends on the number of columns alone."""
    parts = fit.mapInArrow(_products(size, columns, centred), "i int, j int, value double")
    found = parts.groupBy("i", "j").agg(F.sum("value").alias("value")).toArrow()
    answer = np.zeros((columns, columns))
    i, j, value = (found.column(n).to_numpy() for n in ("i", "j", "value"))
    answer[i, j] = answer[j, i] = value
    return answer


def _transformed(size: int, n: int, sums: list[int], whiten, explained: list[float], identity_error: float):
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    components = len(explained)
    largest = max(map(abs, sums), default=0)

    def deviations(x: np.ndarray) -> list[int | None]:
        bound = n * max(int(x.max()), -int(x.min())) + largest
        whole, less = (x, np.array(sums)) if size * bound * bound < _LIMIT else (x.astype(object), np.array(sums, object))
        found = ((n * whole - less) ** 2).sum(1).tolist()
        return [v if v < 1 << 63 else None for v in found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            x = _matrix(batch.column("x"), size)
            at = pa.array(np.repeat(np.arange(rows), components))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(at),
                    pa.array(np.tile(np.arange(1, components + 1, dtype=np.int32), rows)),
                    pa.array(np.full(rows * components, n, np.int64)),
                    pa.array(deviations(x), pa.int64()).take(at),
                    pa.array(whiten(x).ravel()),
                    pa.array(np.tile(np.array(explained), rows)),
                    pa.array(np.full(rows * components, identity_error)),
                ],
                names=names,
            )

    return run


def _usable(vector: Column) -> Column:
    """Not null, not empty, and without null or non-finite entries."""
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) > 0) & finite, F.lit(False))


def whitened(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each vector and component.

    `vectors` has vec_id and embedding. An entry c becomes x = floor(scale * c). The fit list is each distinct
    x vector once, n of them; sums of its dimensions are exact, its covariance is summed from centred products in
    the tasks, and its eigenvectors come from `refined_eigenvectors` on the driver, which only ever holds
    matrices of one vector's length. identity_error is measured on the fit list's whitened vectors.
    deviation is the exact sum of (n * x - sum)^2, null where that is no long.

    Rows whose vector is null, empty, holds a null or non-finite entry, or differs in length from the most
    frequent length (of several the larger) take no part. Entries too large for a long count as the largest
    long. Repeated rows give repeated rows, a null vec_id stays null, and vectors that repeat count once
    in the fit. A component without variance (to rounding) is left out, so a single distinct vector, or no
    rows, give no rows. Components of equal variance are any orthogonal ones. Other columns are ignored,
    whatever their names.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    rows = rows.where(_usable(F.col("vector")))
    lengths = rows.groupBy(F.size("vector").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("size")).limit(1).collect()
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not lengths:
        return spark.createDataFrame([], schema)
    size = lengths[0]["size"]
    rows = rows.where(F.size("vector") == size).select("vec_id", F.transform("vector", lambda c: F.floor(c * scale)).alias("x"))
    fit = stored(rows.select("x").distinct())
    n = fit.count()
    totals = fit.mapInArrow(_sums(size), "k int, total decimal(38,0)").groupBy("k").agg(F.sum("total").alias("total")).collect()
    sums = [int(row["total"]) for row in sorted(totals, key=lambda row: row["k"])]
    mean = np.array([s / n for s in sums])
    covariance = _summed_products(fit, size, size, lambda x: x - mean) / n
    values, directions = refined_eigenvectors(covariance)
    trace = float(np.trace(covariance))
    kept = [k for k in range(min(components, size)) if values[k] > size * np.finfo(float).eps * trace]
    if not kept:
        return spark.createDataFrame([], schema)
    turn, spread = directions[:, kept], np.sqrt(values[kept])

    def whiten(x: np.ndarray) -> np.ndarray:
        return (x - mean) @ turn / spread

    identity = _summed_products(fit, size, len(kept), whiten) / n
    identity_error = float(np.abs(identity - np.eye(len(kept))).max())
    explained = [float(values[k] / trace) for k in kept]
    return rows.mapInArrow(_transformed(size, n, sums, whiten, explained, identity_error), schema)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four whitened components of all `embeddings`."""
    return whitened(table(spark, sf_dir, "embeddings"))
