"""Connected components of a graph that is too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flightpulse.llm.shared import stored


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """`node`, `root` for each node of `edges` (`a`, `b`); the root is the smallest node reachable.

    Alternates two steps until nothing changes: every node links its larger neighbours, then its
    smaller ones, to the smallest node it knows. Both are an aggregate with partial minima and a join
    that Spark may split, so a node with very many edges is no single task. The number of rounds
    grows with the logarithm of the longest chain, and each ends in the checkpoint folder.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    current = stored(pairs.distinct())
    state = _state(current)
    while state[0]:
        both = current.unionAll(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("least"))
        small = (
            large.join(down, "a")
            .select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("least").alias("b")), F.struct("a", F.col("least").alias("b")))).alias("e"))
            .select("e.*")
            .where("a <> b")
            .distinct()
        )
        current = stored(small)
        before, state = state, _state(current)
        if state == before:
            break
    stars = current.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.unionAll(stars.select(F.col("root").alias("node"), "root").distinct())
