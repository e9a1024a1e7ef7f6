"""Mixing sources to target weights, cut at each source's exact budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flightpulse.llm.shared import DOCUMENT, stored, table, word_count

WEIGHTS = (3, 1, 2)
SHARE = 1.5
LIMIT = 2.0
SEED = "mix"
#: Rows of one range of random keys, on average, in a source that holds all rows.
RANGE_ROWS = 8192


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> DataFrame:
    """Adds `target` to one row per source (`src`, `source_size`).

    Sources in order of `src` have the weights in turn and share `share` times the total. A target
    stops at `limit` times its source; the rest is shared by weight among the others. Sorted by
    limit per unit of weight, the stopped sources come first, so one pass of running sums finds the
    level at which nothing exceeds its limit. One task holds one row per source.
    """
    by_name = Window.orderBy("src")
    by_level = Window.orderBy("full_at", "src")
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    position = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), position + 1)
    level = (F.lit(share) * F.sum("source_size").over(every) - F.col("stopped")) / F.col("weight_left")
    return (
        sizes.withColumn("weight", weight)
        .withColumn("most", limit * F.col("source_size"))
        .withColumn("full_at", F.col("most") / F.col("weight"))
        .withColumn("stopped", F.sum("most").over(by_level.rowsBetween(Window.unboundedPreceding, 0)) - F.col("most"))
        .withColumn("weight_left", F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", level)
        .withColumn("level", F.max(F.when(F.col("level") <= F.col("full_at"), F.col("level"))).over(every))
        .withColumn("target", F.least(F.col("most"), F.coalesce(F.col("level") * F.col("weight"), F.col("most"))))
        .select("src", "source_size", "target")
    )


def mix(
    docs: DataFrame,
    carry: tuple[str, ...] = ("doc_id",),
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    limit: float = LIMIT,
    seed: str = SEED,
    range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """One row per document: `carry`, size, source_size, target, taken, passes, begun.

    A document's random key is the MD5 of seed and id. Its leading bits cut each source into ranges of
    keys; a range is sorted on its own and the ranges' totals are summed up per source, which gives
    every document the words before it in its source without a task per source. A source is taken
    `passes` whole times; the rest of its budget is cut at the exact word, so `taken` sums up to the
    whole words of `target`. `begun` tells whether the last, partial pass reaches the document.

    `size` is the number of words, 0 for null or blank text. A null source is a source of its own, the
    last. Rows of equal key (repeated or null ids) are taken in order of size. Columns of `docs` that
    are not in `carry` are ignored, whatever their names. No rows give no rows.
    """
    ranges = max(1, min(1 << 28, -(-docs.count() // range_rows)))
    key = F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string")))
    first_bits = F.conv(F.substring("key", 1, 7), 16, 10).cast("long")
    rows = docs.select(
        F.struct(*carry).alias("row"),
        F.col("doc_id").alias("id"),
        F.when(F.col("source").isNull(), "b").otherwise(F.concat(F.lit("a"), F.col("source"))).alias("src"),
        word_count(F.col("text")).alias("size"),
        key.alias("key"),
    ).withColumn("range", F.shiftright(first_bits * ranges, 28).cast("int"))

    # One pass sums up the ranges, which are few; the other places the documents in them.
    totals = stored(rows.groupBy("src", "range").agg(F.sum("size").alias("total")))
    by_source = Window.partitionBy("src")
    before = totals.withColumn(
        "before", F.sum("total").over(by_source.orderBy("range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("total")
    )
    sizes = totals.groupBy("src").agg(F.sum("total").alias("source_size"))
    plan = before.join(source_targets(sizes, weights, share, limit), "src").drop("total")
    in_order = Window.partitionBy("src", "range").orderBy("key", "id", "size")
    summed = rows.withColumn("upto", F.sum("size").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    placed = summed.join(plan, ["src", "range"])

    begin = F.col("before") + F.col("upto") - F.col("size")
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.floor("target") - F.col("passes") * F.col("source_size")
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("rest") - F.col("begin")))
    return (
        placed.withColumn("passes", passes)
        .withColumn("rest", rest)
        .withColumn("begin", begin)
        .withColumn("part", part)
        .select(
            "row.*",
            "size",
            "source_size",
            "target",
            (F.col("passes") * F.col("size") + F.col("part")).alias("taken"),
            "passes",
            (F.col("part") > 0).alias("begun"),
        )
    )


def mixed_documents(docs: DataFrame, **params) -> DataFrame:
    """The mix as documents: one whole row for each time that a document is taken.

    The document in which a source's budget ends is given whole, so a source exceeds its target by
    less than one document. Documents without words are repeated with the whole passes only.
    """
    columns = tuple(c for c in DOCUMENT if c in docs.columns)
    taken = mix(docs, carry=columns, **params)
    times: Column = (F.col("passes") + F.col("begun").cast("long")).cast("int")
    return (
        taken.withColumn("times", times)
        .where("times > 0")
        .select(*columns, F.explode(F.sequence(F.lit(1), F.col("times"))).alias("time"))
        .drop("time")
    )


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP1_SQL = r"""
WITH sized AS (
    SELECT doc_id, CASE WHEN source IS NULL THEN 'b' ELSE 'a' || source END AS src,
           coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
           md5(concat_ws(':', 'mix', doc_id::VARCHAR)) AS key
    FROM documents
), sources AS (
    SELECT src, sum(size)::BIGINT AS source_size FROM sized GROUP BY src
), weighted AS (
    SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][((row_number() OVER (ORDER BY src) - 1) % 3 + 1)::INT] AS weight,
           2.0::DOUBLE * source_size AS most
    FROM sources
), levels AS (
    SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()::DOUBLE
               - (sum(most) OVER (ORDER BY most / weight, src ROWS UNBOUNDED PRECEDING) - most))
              / sum(weight) OVER (ORDER BY most / weight, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
    FROM weighted
), targets AS (
    SELECT src, source_size,
           least(most, coalesce(max(CASE WHEN level <= most / weight THEN level END) OVER () * weight, most)) AS target
    FROM levels
), placed AS (
    SELECT doc_id, size, source_size, target,
           CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS passes,
           sum(size) OVER (PARTITION BY src ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING)::BIGINT - size AS begin
    FROM sized JOIN targets USING (src)
)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       (passes * size + greatest(0, least(size, floor(target)::BIGINT - passes * source_size - begin)))::BIGINT AS taken
FROM placed
"""
