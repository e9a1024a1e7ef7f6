"""Exact deduplication by deterministic block naming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flightpulse.llm.shared import DOCUMENT, SPACE, stored, table

#: Bytes of a block. A Spark string is below 2 GB, so a text has fewer than 2^POSITION_BITS blocks.
BLOCK_BYTES = 2048
POSITION_BITS = 21
#: Bits of the hash that stands for a block where no other block has the same.
MARK_BITS = 64
#: The missing right half of an odd last pair; no name is -1.
NO_PARTNER = -1


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def _address(row: Column, position: Column) -> Column:
    """A row and a position in it as one whole number."""
    return (row.cast("decimal(20,0)") * F.lit(1 << POSITION_BITS).cast("decimal(7,0)") + position).cast("decimal(30,0)")


def _joined(pieces: DataFrame, names: DataFrame, key: list[str]) -> DataFrame:
    """Gives each piece its name. `names` is stored, so both sides are shuffled for the join alone and Spark
    may split the partition of a content that a third of all rows hold."""
    return pieces.join(names, key).select("row", "position", "name")


def _named(pieces: DataFrame, key: list[str]) -> DataFrame:
    """Replaces `key` by the integer name of its content.

    Equal contents meet in a sorted run of their own partition and get the address of their first
    occurrence as their name: different contents never share one, and a rerun gives the same names.
    Each task sends a content once, however often it holds it.
    """
    first = F.min(_address(F.col("row"), F.col("position"))).alias("name")
    return _joined(pieces, stored(pieces.groupBy(*key).agg(first)), key)


def _content() -> Column:
    """The bytes that are compared. Selected as a column of its own, it is worked out once for each text."""
    return F.encode(normalised(F.col("text")), "utf-8").alias("data")


def _blocks(block_bytes: int) -> Column:
    """The bytes of `data` in blocks of fixed size; one empty block for an empty text."""
    data = F.col("data")
    count = F.greatest(F.lit(1), F.ceil(F.length(data) / block_bytes)).cast("int")
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(data, i * block_bytes + 1, F.lit(block_bytes)))


def _mark(block: Column, mark_bits: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(block), 64 - mark_bits)


def _named_blocks(docs: DataFrame, rows: DataFrame, block_bytes: int, mark_bits: int) -> DataFrame:
    """The integer name of each block (`row`, `position`, `name`).

    All blocks are grouped by their full bytes, once, and named by the address of their first
    occurrence. That also tells which hashes stand for one block only, so the join back carries a
    hash in the block's place. Where several blocks share a hash, and only there, the bytes are joined
    as well, so that names stay free of collisions. Those names come from a scan of their own, which may
    be split otherwise; they are below NO_PARTNER, so they never equal an address of the first scan.
    """
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").alias("id"), _content())
    spread = numbered.select(
        "row", "id", F.sha2("data", 256).alias("sha"), F.posexplode(_blocks(block_bytes)).alias("position", "block")
    ).withColumn("mark", _mark(F.col("block"), mark_bits))
    first = F.min(_address(F.col("row"), F.col("position"))).alias("name")
    names = stored(spread.groupBy("mark", "block").agg(first).select("mark", "name"))
    marks = stored(names.groupBy("mark").agg(F.count("*").alias("blocks"), F.min("name").alias("name")))
    pieces = rows.select("row", "id", "sha", F.posexplode("marks").alias("position", "mark"))
    named = _joined(pieces, marks.where("blocks = 1").drop("blocks"), ["mark"])
    crowded = marks.where("blocks > 1").select("mark")
    if crowded.isEmpty():
        return named
    among = spread.join(crowded, "mark", "left_semi")
    below = (F.lit(NO_PARTNER - 1) - F.min(_address(F.col("row"), F.col("position")))).cast("decimal(30,0)").alias("name")
    told = among.join(stored(among.groupBy("mark", "block").agg(below)), ["mark", "block"])
    told = told.select(F.col("id").alias("its_id"), F.col("sha").alias("its_sha"), F.col("position").alias("at"), "name").distinct()
    same = F.col("id").eqNullSafe(F.col("its_id")) & (F.col("sha") == F.col("its_sha")) & (F.col("position") == F.col("at"))
    return named.unionAll(pieces.join(told, same).select("row", "position", "name"))


def identities(named: DataFrame) -> DataFrame:
    """One collision-free identity (`level`, `name`) for each row of named blocks.

    Adjacent names are paired and equal pairs get one name, level by level, until each row is one
    name. Two rows have the same level and name exactly if their blocks are the same. The number of
    levels is the logarithm of the longest row's blocks; every level has half the pieces.
    """
    named, level, done = stored(named), 0, []
    while True:
        ends = named.groupBy("row").agg(F.max("position").alias("last"))
        finished = ends.where("last = 0").select("row")
        done.append(named.where("position = 0").join(finished, "row").select("row", F.lit(level).alias("level"), "name"))
        rest = named.join(finished, "row", "left_anti")
        if rest.isEmpty():
            break
        even = F.col("position") % 2 == 0
        pairs = rest.groupBy("row", F.shiftright("position", 1).alias("position")).agg(
            F.max(F.when(even, F.col("name"))).alias("left"),
            F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(NO_PARTNER).cast("decimal(30,0)")).alias("right"),
        )
        named = stored(_named(stored(pairs), ["left", "right"]))
        level += 1
    found = done[0]
    for part in done[1:]:
        found = found.unionAll(part)
    return found


def exact_duplicates(
    docs: DataFrame, carry: tuple[str, ...] = ("doc_id",), block_bytes: int = BLOCK_BYTES, mark_bits: int = MARK_BITS
) -> DataFrame:
    """One row per document: `carry`, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical after each run of ASCII white space became one space; a
    null text is an empty one, and empty texts are equal to each other. Of equal texts the row with the
    smallest doc_id stays, a null doc_id being the largest; of rows that repeat that doc_id, one stays.
    Columns of `docs` not in `carry`, which should be narrow, are ignored, whatever their names. No rows
    give no rows.

    Rows are numbered once and stored with the hashes of their blocks; no result depends on how a later
    scan is split among executors. A very long text is as many blocks as it needs; only its normalised
    copy is held whole.
    """
    rows = stored(
        docs.select(
            F.monotonically_increasing_id().alias("row"), F.struct(*carry).alias("carried"), F.col("doc_id").alias("id"), _content()
        ).select(
            "row",
            "carried",
            "id",
            F.sha2("data", 256).alias("sha"),
            F.transform(_blocks(block_bytes), lambda block: _mark(block, mark_bits)).alias("marks"),
        )
    )
    named = identities(_named_blocks(docs, rows, block_bytes, mark_bits))
    members = rows.select("row", "carried", "id", F.col("sha").alias("text_sha256")).join(named, "row")
    first = F.struct(F.col("id").isNull().alias("missing"), F.col("id"), F.col("row"))
    groups = stored(members.groupBy("level", "name").agg(F.count("*").alias("group_size"), F.min(first).alias("first")))
    return members.join(groups, ["level", "name"]).select(
        "carried.*",
        F.col("first.id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("first.row")).alias("kept"),
        "text_sha256",
    )


def without_duplicates(docs: DataFrame) -> DataFrame:
    """The documents that stay, with the columns of documents that `docs` has.

    Null and empty texts are equal, and of them one row stays. Of rows that repeat a doc_id and whose texts are
    equal but for white space, the least by its columns in their order stays, nulls first, so a rerun gives the same rows.
    Other columns are left out, whatever their names. No rows give no rows.
    """
    columns = [c for c in DOCUMENT if c in docs.columns]
    stay = exact_duplicates(docs).where("kept").select(F.struct("doc_id", F.col("text_sha256").alias("sha")).alias("same"))
    sha = F.sha2(normalised(F.col("text")), 256)
    rows = docs.select(F.struct("doc_id", sha.alias("sha")).alias("same"), F.struct(*columns).alias("document"))
    return rows.join(stay, "same", "left_semi").groupBy("same").agg(F.min("document").alias("document")).select("document.*")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH texts AS (
    SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS content FROM documents
)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY content) AS keep_id,
       count(*) OVER (PARTITION BY content) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY content) AS kept,
       sha256(content) AS text_sha256
FROM texts
"""
