"""Approximate nearest neighbours through learned partitions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flightpulse.llm.shared import stored, table

NEAREST = 20
QUERY_EVERY = 20
#: Distinct vectors that the partitions are learned from: so many, or as many more as there are partitions to
#: tell apart, up to the second figure.
SAMPLE = 8192
LARGEST_SAMPLE = 65_536
#: The root of a table's distinct vectors over this is the number of partitions, as a power of two.
ROOT_SHARE = 2.5
#: Vectors of the sample in a partition, at least.
SAMPLED_ROWS = 32
#: Neighbours of a vector in the sample's graph.
GRAPH = 20
HIDDEN = 96
EPOCHS = 25
#: Share of the true neighbours that the probed partitions must hold for the sample's own queries.
RECALL = 0.95
#: Candidates, and queries, that one task compares with each other at most, on average.
BLOCK_ROWS = 16_384
SEED = 11


def _nearest(vectors: np.ndarray, count: int) -> np.ndarray:
    """The `count` nearest others of each vector by inner product, a block of rows at a time."""
    count = min(count, len(vectors) - 1)
    found = np.empty((len(vectors), count), np.int64)
    for at in range(0, len(vectors), 512):
        product = vectors[at : at + 512] @ vectors.T
        product[np.arange(len(product)), np.arange(at, at + len(product))] = -np.inf
        found[at : at + 512] = np.argpartition(-product, count - 1, axis=1)[:, :count]
    return found


def balanced_parts(graph: np.ndarray, parts: int, rounds: int = 12) -> np.ndarray:
    """A part for each node, all parts of equal size up to one node, with few edges between parts.

    Halves the graph again and again. A half starts as the lower side of a smooth function on the graph
    (power iteration on the averages over neighbours) and is improved by exchanging equally many nodes
    of both sides, those with most edges to the other side first, while that saves edges.
    """
    nodes = len(graph)
    row = np.repeat(np.arange(nodes), graph.shape[1])
    ends = (np.concatenate([row, graph.ravel()]), np.concatenate([graph.ravel(), row]))
    part = np.zeros(nodes, np.int64)
    draw = np.random.default_rng(SEED)
    pieces = 1
    while pieces < parts:
        same = part[ends[0]] == part[ends[1]]
        a, b = ends[0][same], ends[1][same]
        degree = np.bincount(a, minlength=nodes) + 1e-9
        size = np.bincount(part, minlength=pieces)
        value = draw.normal(size=nodes)
        for _ in range(30):
            value -= (np.bincount(part, value, pieces) / size)[part]
            value = 0.5 * value + 0.5 * np.bincount(a, value[b], nodes) / degree
            value /= np.sqrt(np.bincount(part, value**2, pieces) / size + 1e-30)[part]
        order = np.lexsort((value, part))
        begin = np.concatenate([[0], np.cumsum(size)[:-1]])
        place = np.empty(nodes, np.int64)
        place[order] = np.arange(nodes) - begin[part[order]]
        side = (place >= (size[part] + 1) // 2).astype(np.int64)
        cut = (side[a] != side[b]).sum()
        for _ in range(rounds):
            other = np.bincount(a, side[b] != side[a], nodes)
            gain = 2 * other - degree
            trial = side.copy()
            for piece in range(pieces):
                members = np.flatnonzero(part == piece)
                left, right = members[side[members] == 0], members[side[members] == 1]
                left = left[np.argsort(-gain[left], kind="stable")]
                right = right[np.argsort(-gain[right], kind="stable")]
                pairs = min(len(left), len(right))
                moved = int((gain[left[:pairs]] + gain[right[:pairs]] > 0).sum() * 0.5 + 0.5)
                trial[left[:moved]], trial[right[:moved]] = 1, 0
            after = (trial[a] != trial[b]).sum()
            if after >= cut:
                break
            side, cut = trial, after
        part = 2 * part + side
        pieces *= 2
    return part


Router = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def routed(router: Router, vectors: np.ndarray) -> np.ndarray:
    """Unnormalised log-probabilities of the partitions for each vector."""
    first, offset, second, last = router
    return np.maximum(vectors @ first + offset, 0) @ second + last


def fitted_router(vectors: np.ndarray, shares: np.ndarray, epochs: int = EPOCHS, batch: int = 256) -> Router:
    """A small network that predicts the shares of a vector's neighbours in each partition."""
    draw = np.random.default_rng(SEED)
    inputs, parts = vectors.shape[1], shares.shape[1]
    scale = 1.0 / np.sqrt(np.mean(vectors**2) * inputs + 1e-30)
    p = [
        draw.normal(0, np.sqrt(2.0), (inputs, HIDDEN)) * scale,
        np.zeros(HIDDEN),
        draw.normal(0, np.sqrt(1 / HIDDEN), (HIDDEN, parts)),
        np.zeros(parts),
    ]
    state = [[np.zeros_like(v), np.zeros_like(v)] for v in p]
    steps, t = epochs * -(-len(vectors) // batch), 0
    for _ in range(epochs):
        order = draw.permutation(len(vectors))
        for at in range(0, len(order), batch):
            x, y = vectors[order[at : at + batch]], shares[order[at : at + batch]]
            before = x @ p[0] + p[1]
            hidden = np.maximum(before, 0)
            logits = hidden @ p[2] + p[3]
            chance = np.exp(logits - logits.max(1, keepdims=True))
            chance /= chance.sum(1, keepdims=True)
            error = (chance - y) / len(x)
            back = (error @ p[2].T) * (before > 0)
            t += 1
            rate = 0.01 * (1 - (t - 1) / steps)
            for k, g in enumerate((x.T @ back, back.sum(0), hidden.T @ error, error.sum(0))):
                first, second = state[k]
                first += 0.1 * (g - first)
                second += 0.001 * (g**2 - second)
                size = scale if k == 0 else 1.0
                p[k] -= size * rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-10)
    return tuple(p)


def mass_before(logits: np.ndarray) -> np.ndarray:
    """For each row and partition, the probability of the partitions that are more probable."""
    chance = np.exp(logits - logits.max(1, keepdims=True))
    chance /= chance.sum(1, keepdims=True)
    order = np.argsort(-chance, axis=1, kind="stable")
    ordered = np.take_along_axis(chance, order, axis=1)
    answer = np.empty_like(chance)
    np.put_along_axis(answer, order, np.cumsum(ordered, axis=1) - ordered, axis=1)
    answer[np.arange(len(answer)), order[:, 0]] = 0.0
    return answer


def learned(vectors: np.ndarray, parts: int, recall: float = RECALL) -> tuple[Router, float]:
    """A router, and the mass of probability that a query's probed partitions reach.

    A query probes its most probable partitions until those before the next one have more than that mass, so
    few where the router is sure and many where it is not. The mass is measured with vectors of the sample that the
    router is not fitted on: a quarter of them ask for their exact nearest neighbours in the whole
    sample, and it is the least with which the wanted share of these lies in the probed partitions.
    """
    graph = _nearest(vectors, GRAPH)
    part = balanced_parts(graph, parts)
    shares = np.zeros((len(vectors), parts))
    np.add.at(shares, (np.repeat(np.arange(len(vectors)), graph.shape[1]), part[graph].ravel()), 1.0 / (graph.shape[1] + 1))
    shares[np.arange(len(vectors)), part] += 1.0 / (graph.shape[1] + 1)
    asks = np.arange(len(vectors)) % 4 == 3
    router = fitted_router(vectors[~asks], shares[~asks])
    logits = routed(router, vectors)
    lies = logits.argmax(1)
    needed = np.sort(np.take_along_axis(mass_before(logits[asks]), lies[graph[asks]], axis=1).ravel())
    return router, float(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)])


def partitions(distinct: int) -> int:
    """How many partitions a table of so many distinct vectors has."""
    wanted = min(np.sqrt(distinct) / ROOT_SHARE, LARGEST_SAMPLE / SAMPLED_ROWS, distinct / SAMPLED_ROWS)
    return 1 << max(0, int(np.log2(max(1.0, wanted))))


def _matrix(column: pa.ChunkedArray | pa.Array, size: int) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return values.flatten().to_numpy(zero_copy_only=False).reshape(-1, size) if len(values) else np.empty((0, size))


def grouped(counts: dict[int, int], rows: int) -> dict[int, tuple[int, int]]:
    """Group and number of blocks of each partition: small neighbouring partitions share a group, a large one
    is a group of its own in several blocks, so that a block has about `rows` rows at most."""
    answer, group, filled = {}, -1, rows
    for part in sorted(counts):
        if filled + counts[part] > rows:
            group, filled = group + 1, 0
        filled += counts[part]
        answer[part] = (group, -(-counts[part] // rows))
    return answer


def _assigned(shared, mass: float, size: int, scale: float):
    """Adds `parts`: the most probable partition of each vector, or all before which the mass is no larger."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        router = shared.value
        for batch in batches:
            logits = routed(router, scaled(_matrix(batch.column("vector"), size), scale))
            chosen = mass_before(logits) <= mass if len(logits) else np.empty((0, 1), bool)
            if mass < 0:  # rows lie in one partition only
                chosen = np.arange(logits.shape[1])[None, :] == logits.argmax(1)[:, None] if len(logits) else chosen
            at = np.concatenate([[0], np.cumsum(chosen.sum(1))]).astype(np.int32)
            parts = pa.ListArray.from_arrays(at, np.nonzero(chosen)[1].astype(np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns, parts], names=[*batch.schema.names, "parts"])

    return run


def scaled(vectors: np.ndarray, scale: float) -> np.ndarray:
    """Vectors as the router takes them: by a common scale, outliers cut off. Only the choice of partitions sees this."""
    return np.clip(vectors / scale, -1e3, 1e3)


def best_rows(
    asked: np.ndarray, known: np.ndarray, ids: list[list[int]], allowed: np.ndarray, count: int
) -> Iterator[list[tuple[float, int]]]:
    """For each row of `asked`, its `count` best ids among the `allowed` rows of `known`, as (-score, id) in order.

    Rows are chosen by products of vectors that are divided by their largest entry, so that none overflows. A
    score is the plain sum of products; one that is beyond double precision is infinite and ties with others.
    """
    size = known.shape[1]
    short = min(len(known), count)
    top = np.abs(known).max(initial=0) or 1.0
    known_part = known / top
    longest = np.sqrt((known_part * known_part).sum(1).max(initial=0))
    tops = np.abs(asked).max(axis=1, initial=0)
    asked_part = asked / np.where(tops > 0, tops, 1.0)[:, None]
    product = np.where(allowed, asked_part @ known_part.T, -np.inf)
    # all rows that tie with the last one, as far as the product's rounding can tell
    margin = 4 * size * np.finfo(float).eps * longest * np.sqrt((asked_part * asked_part).sum(1))
    least = np.partition(product, len(known) - short, axis=1)[:, len(known) - short] - margin
    for i in range(len(asked)):
        close = product[i] >= least[i]
        huge = top * (size * min(tops[i], 1e300)) > 1e300  # some products may not be finite
        with np.errstate(over="ignore", invalid="ignore"):
            if huge:
                close |= product[i] * tops[i] * top == np.inf
            chosen = np.flatnonzero(allowed[i] & close)
            # summed anew, the same way for every pair, whatever the blocks were
            scores = (known[chosen] * asked[i]).sum(1)
            if huge:
                scores = np.where(np.isnan(scores), product[i, chosen] * tops[i] * top, scores)
        rows = [(-s, v) for s, c in zip(scores.tolist(), chosen) for v in ids[c]]
        rows.sort()
        yield rows[:count]


def _compared(count: int, size: int, parts: int):
    """The best rows of a block of candidates for each query of a turn, among the partitions it probes."""

    def run(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        asked, known = _matrix(queries.column("vector"), size), _matrix(candidates.column("vector"), size)
        lies, ids = candidates.column("part").to_numpy(), candidates.column("ids").to_pylist()
        keys, probed = queries.column("asked").to_numpy(), queries.column("parts").to_pylist()
        found: list[tuple[int, int, float]] = []
        for at in range(0, len(asked) if len(known) else 0, 256):
            block = asked[at : at + 256]
            allowed = np.zeros((len(block), parts), bool)
            for i, chosen in enumerate(probed[at : at + 256]):
                allowed[i, chosen] = True
            for key, rows in zip(keys[at : at + 256], best_rows(block, known, ids, allowed[:, lies], count)):
                found.extend((int(key), v, -s) for s, v in rows)
        columns = list(zip(*found)) if found else [(), (), ()]
        return pa.table(
            {"asked": pa.array(columns[0], pa.int64()), "vec_id": pa.array(columns[1], pa.int64()), "score": pa.array(columns[2], pa.float64())}
        )

    return run


def _usable(vector: Column) -> Column:
    """Not null, not zero, and without null or non-finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest_neighbours(
    vectors: DataFrame,
    is_query: Column,
    nearest: int = NEAREST,
    parts: int | None = None,
    recall: float = RECALL,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """query_id, rank, vec_id, score: the `nearest` other rows of each query by inner product.

    `vectors` has vec_id and embedding. On a bounded sample, a graph of neighbours is cut into balanced
    partitions, as many as the root of the number of distinct vectors asks for (or `parts`), and a small network
    learns to tell them apart; every row is indexed under its most probable partition, and a query probes as
    many partitions as the sample needed for `recall`. Fewer than a few hundred vectors are one partition.
    Equal vectors are indexed once, with the smallest ids that an answer can need, so a vector that a third of
    all rows share costs no more than another. Small partitions are searched together, large ones in
    blocks; the queries of a partition are cut into turns where they are many, and only its rows meet each turn.

    Rows whose vector is null, zero, or holds null or non-finite components, whose id is null, or whose
    vector differs in length from the most frequent length take no part. Of rows that repeat an id, the
    least vector counts. Ties go to the smaller vec_id; products beyond double precision are infinite and tie. Other columns are ignored, whatever their names.
    No rows give no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("vector"))
    rows = rows.where(F.col("vec_id").isNotNull() & _usable(F.col("vector")))
    lengths = rows.groupBy(F.size("vector").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("size")).limit(1).collect()
    size = lengths[0]["size"] if lengths else 0
    rows = rows.where(F.size("vector") == size).groupBy("vec_id").agg(F.min("vector").alias("vector"))

    order = Window.partitionBy("vector").orderBy("vec_id")
    few = rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= nearest + 1)
    distinct = stored(few.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))
    total = distinct.count()
    parts = partitions(total) if parts is None else parts
    sample_rows = min(LARGEST_SAMPLE, max(SAMPLE, SAMPLED_ROWS * parts))
    sample = distinct.select("vector").orderBy(F.xxhash64("vector"), "vector").limit(sample_rows).toArrow()
    sample_vectors = _matrix(sample.column("vector"), max(1, size))
    scale = float(np.median(np.abs(sample_vectors).max(axis=1, initial=0))) if len(sample_vectors) else 1.0
    if parts == 1:
        router, mass = (np.zeros((max(1, size), 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1)), 0.0
    else:
        router, mass = learned(scaled(sample_vectors, scale), parts, recall)
    shared = spark.sparkContext.broadcast(router)

    indexed = stored(
        distinct.mapInArrow(_assigned(shared, -1.0, max(1, size), scale), "vector array<double>, ids array<long>, parts array<int>").select(
            F.col("parts")[0].alias("part"), "vector", "ids"
        )
    )
    counts = {row["part"]: row["n"] for row in indexed.groupBy("part").agg(F.count("*").alias("n")).collect()}
    place_rows = [(part, *place) for part, place in grouped(counts, block_rows).items()]

    def places() -> DataFrame:  # one row per partition
        return F.broadcast(spark.createDataFrame(place_rows, "part int, group int, blocks int"))

    queries = rows.where(is_query).select("vec_id", "vector")
    asked = stored(queries.groupBy("vector").agg(F.min("vec_id").alias("asked")))
    probed = asked.mapInArrow(_assigned(shared, mass, max(1, size), scale), "vector array<double>, asked long, parts array<int>")
    probing = stored(
        probed.select("asked", F.explode("parts").alias("part"))
        .join(places(), "part")
        .groupBy("asked", "group")
        .agg(F.max("blocks").alias("blocks"), F.collect_list("part").alias("parts"))  # at most one entry per partition
    )
    asking = probing.groupBy("group").agg(F.count("*").alias("n")).collect()  # one row per group
    turn_rows = [(row["group"], -(-row["n"] // block_rows)) for row in asking]

    def turns() -> DataFrame:
        return F.broadcast(spark.createDataFrame(turn_rows, "group int, turns int"))

    candidates = (
        indexed.join(places(), "part")
        .join(turns(), "group")
        .withColumn("block", F.pmod(F.xxhash64("vector"), "blocks"))
        .withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)))
        .select("group", "block", "turn", "part", "vector", "ids")
    )
    probing = (
        probing.join(asked, "asked")
        .join(turns(), "group")
        .withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1)))
        .withColumn("turn", F.pmod(F.xxhash64("asked"), "turns").cast("int"))
        .select("group", "block", "turn", "asked", "vector", "parts")
    )
    keys = ("group", "block", "turn")
    found = (
        probing.groupBy(*keys)
        .cogroup(candidates.groupBy(*keys))
        .applyInArrow(_compared(nearest + 1, max(1, size), parts), "asked long, vec_id long, score double")
    )
    best = Window.partitionBy("asked").orderBy(F.desc("score"), "vec_id")
    top = found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= nearest + 1).drop("place")
    members = queries.join(asked, "vector").select(F.col("vec_id").alias("query_id"), "asked")
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        members.join(top, "asked")
        .where("vec_id <> query_id")
        .withColumn("rank", F.row_number().over(ranked))
        .where(F.col("rank") <= nearest)
        .select("query_id", "rank", "vec_id", "score")
    )


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % QUERY_EVERY == 0)
