"""Near-duplicate detection by fast similarity sketches, banding and exact verification."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flightpulse.llm.components import connected_components
from flightpulse.llm.shared import DOCUMENT, stored, table, utf8

#: A link needs 100 * intersection >= PERCENT * union of the sets of SHINGLE-word shingles.
PERCENT = 80
SHINGLE = 4
PIPELINE_SHINGLE = 5
#: At similarity 0.8 all BANDS bands of ROWS coordinates differ with probability (1 - 0.8^4)^24 = 3e-6.
BANDS = 24
ROWS = 4

#: Members of a bucket in a block on average, and shingles of all of them; two blocks are compared at once.
BLOCK = 1024
BLOCK_SHINGLES = 1 << 22
#: Columns of the matrices.
STRETCH = 2048
#: Bytes of a text that are hashed at once, and shingles that are sketched at once.
PIECE = 1 << 20

U = np.uint64
_ODD = 0x9E3779B97F4A7C15
#: Words are hashed by two polynomials over the integers modulo this prime.
_PRIME = (1 << 31) - 1
_BASES = (1_357_924_680, 2_012_345_679)
_IS_SPACE = np.isin(np.arange(256), [0x20, 9, 10, 11, 12, 13])
_FOLDED = np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256))


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits all depend on all input bits."""
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


#: A random number below the prime for each byte, the same for A-Z and a-z.
_BYTE_CODE = (_mixed(np.arange(1, 257, dtype=np.uint64))[_FOLDED] % U(_PRIME - 1)) + U(1)


def _reduced(x: np.ndarray) -> np.ndarray:
    """Numbers below 2^62 modulo the prime, up to one more multiple of it."""
    return (x & U(_PRIME)) + (x >> U(31))


class _Powers:
    """Powers of the hash bases and of their inverses, as many as a piece of a text needs."""

    def __init__(self) -> None:
        self.tables = [[np.ones(1, np.uint64), np.ones(1, np.uint64)] for _ in _BASES]

    def upto(self, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
        for base, both in zip(_BASES, self.tables):
            for i, factor in enumerate((base, pow(base, -1, _PRIME))):
                while len(both[i]) < n:
                    both[i] = np.concatenate([both[i], both[i] * U(pow(factor, len(both[i]), _PRIME)) % U(_PRIME)])
        return [(up[:n], down[:n]) for up, down in self.tables]


def word_hashes(data: np.ndarray, powers: _Powers) -> np.ndarray:
    """One 64-bit hash for each word of UTF-8 bytes, by its length and two polynomials over a prime field.

    Differences of one running sum give all words of a piece of the text; a word that goes on in the next
    piece is put together from its parts, so memory beside the hashes does not grow with the text.
    """
    done, parts, length = [], [0] * len(_BASES), 0
    for start in range(0, len(data), PIECE):
        piece = data[start : start + PIECE]
        space = np.concatenate(([True], _IS_SPACE[piece], [True]))
        edges = np.flatnonzero(space[1:] != space[:-1])
        begin, end = edges[::2], edges[1::2]
        goes_on = length > 0 and len(begin) > 0 and begin[0] == 0
        if length and not goes_on:
            done.append(_named(np.array([parts], np.uint64).T, np.array([length])))
        if not len(begin):
            length = 0
            continue
        found = np.empty((len(_BASES), len(begin)), np.uint64)
        codes = _BYTE_CODE[piece]
        for k, (up, down) in enumerate(powers.upto(len(piece))):
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_reduced(codes * up))])
            found[k] = (total[end] - total[begin]) % U(_PRIME) * down[begin] % U(_PRIME)
        lengths = end - begin
        if goes_on:
            for k, base in enumerate(_BASES):
                found[k, 0] = (parts[k] + int(found[k, 0]) * pow(base, length, _PRIME)) % _PRIME
            lengths[0] += length
        if end[-1] == len(piece) and start + PIECE < len(data):
            parts, length = [int(x) for x in found[:, -1]], int(lengths[-1])
            found, lengths = found[:, :-1], lengths[:-1]
        else:
            length = 0
        done.append(_named(found, lengths))
    return np.concatenate(done) if done else np.empty(0, np.uint64)


def _named(polynomials: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """One number from a word's two polynomials and its length in bytes."""
    with np.errstate(over="ignore"):
        return _mixed((polynomials[0] << U(31) | polynomials[1]) + lengths.astype(np.uint64) * U(_ODD))


def shingle_set(data: np.ndarray, words: int, powers: _Powers) -> np.ndarray:
    """Sorted distinct hashes of all runs of `words` words; a shorter text is one run."""
    hashes = word_hashes(data, powers)
    if not len(hashes):
        return hashes
    width = min(words, len(hashes))
    runs = np.full(len(hashes) - width + 1, U(width), np.uint64)
    with np.errstate(over="ignore"):
        for begin in range(0, len(runs), PIECE):
            part = runs[begin : begin + PIECE]
            for i in range(width):
                part[:] = _mixed(part * U(_ODD) + hashes[begin + i : begin + i + len(part)])
    return np.unique(runs)


def sketch(elements: np.ndarray, size: int) -> np.ndarray:
    """Fast similarity sketch: in round i each element falls into a hashed bin with value (i, hash).

    A bin keeps its least value, and rounds go on until all bins are filled. From round `size` on, every
    element goes to bin i - size, so 2 * size rounds always fill all of them; sets of more elements
    than bins need two or three rounds.
    """
    empty = U(0xFFFFFFFFFFFFFFFF)
    bins = np.full(size, empty, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(2 * size):
            salt = _mixed(np.array([i + 1], np.uint64))
            for begin in range(0, len(elements), PIECE):
                hashed = _mixed(elements[begin : begin + PIECE] + salt)
                value = (hashed >> U(10)) | U(i << 54)
                if i < size:
                    np.minimum.at(bins, (((hashed & U(0xFFFFFFFF)) * U(size)) >> U(32)).astype(np.int64), value)
                else:
                    bins[i - size] = min(bins[i - size], value.min())
            if (bins != empty).all():
                break
    return bins


def _key(elements: np.ndarray) -> bytes:
    return hashlib.blake2b(elements.tobytes(), digest_size=16).digest()


def _sketched(words: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = _Powers()
        for batch in batches:
            counts, keys, values = [], [], []
            for data in utf8(batch.column("text")):
                elements = shingle_set(data, words, powers)
                counts.append(len(elements))
                keys.append(_key(elements) if len(elements) else None)
                if not len(elements):
                    values.append(None)
                    continue
                coordinates = sketch(elements, bands * rows).reshape(bands, rows)
                band = np.arange(bands, dtype=np.uint64)
                with np.errstate(over="ignore"):
                    for j in range(rows):
                        band = _mixed(band * U(_ODD) + coordinates[:, j])
                values.append(band.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(n) for n in ("doc_id", "mark")),
                    pa.array(counts, pa.int64()),
                    pa.array(keys, pa.binary()),
                    pa.array(values, pa.list_(pa.int64())),
                ],
                names=["doc_id", "mark", "n_shingles", "key", "bands"],
            )

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = _Powers()
        for batch in batches:
            keep, found = [], []
            wanted = batch.column("key").to_pylist()
            for i, data in enumerate(utf8(batch.column("text"))):
                elements = shingle_set(data, words, powers)
                if len(elements) and _key(elements) == wanted[i]:
                    keep.append(wanted[i])
                    found.append(elements.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(keep, pa.binary()), pa.array(found, pa.list_(pa.int64()))], names=["key", "elements"])

    return run


def _alike(left: Column, right: Column) -> Column:
    """Whether two sets reach the similarity, counted on the whole sets."""
    common = F.size(F.array_intersect(left, right)).cast("long")
    return 100 * common >= PERCENT * (F.size(left) + F.size(right) - common)


def _may_be_alike(left: Column, right: Column) -> Column:
    """Sizes that allow the similarity."""
    return 100 * F.least(left, right) >= PERCENT * F.greatest(left, right)


def _resolved(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of keys that are links."""
    left = sets.select(F.col("key").alias("a"), F.col("elements").alias("of_a"))
    right = sets.select(F.col("key").alias("b"), F.col("elements").alias("of_b"))
    return pairs.join(right, "b").join(left, "a").where(_alike(F.col("of_a"), F.col("of_b"))).select("a", "b")


def _linked_roots(left: pa.Table, right: pa.Table) -> pa.Table:
    """Pairs of roots that a link joins, between the members of two blocks of one bucket.

    Common elements are counted for all pairs at once, as a product of matrices with a row for each member
    and a column for each element that two or more members hold, a stretch of columns at a time.
    """
    names = ["key", "root", "elements"]
    tables = (side.select([f"{n}_{mark}" for n in names]).rename_columns(names) for side, mark in ((left, "a"), (right, "b")))
    both = pa.concat_tables(tables)
    keys, roots = both.column("key").to_pylist(), both.column("root").to_pylist()
    place: dict[bytes, int] = {}
    rows = np.array([place.setdefault(key, len(place)) for key in keys], np.int64)
    _, first = np.unique(rows, return_index=True)
    sets = both.column("elements").combine_chunks().take(pa.array(first))
    size = sets.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    _, column, held = np.unique(sets.flatten().to_numpy(zero_copy_only=False), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(size)), size)[held[column] > 1]
    column = (np.cumsum(held > 1) - 1)[column[held[column] > 1]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    a, b = rows[: len(left)], rows[len(left) :]
    common = np.zeros((len(a), len(b)), np.int64)
    for begin in range(0, int(column[-1]) + 1 if len(column) else 0, STRETCH):
        at, end = np.searchsorted(column, [begin, begin + STRETCH])
        part = np.zeros((len(size), STRETCH), np.float32)
        part[row[at:end], column[at:end] - begin] = 1
        common += (part[a] @ part[b].T).astype(np.int64)
    number = {root: i for i, root in enumerate(dict.fromkeys(roots))}
    root = np.array([number[r] for r in roots])
    root_a, root_b = root[: len(left)], root[len(left) :]
    whole = size[a][:, None] + size[b][None, :] - common
    i, j = np.nonzero((100 * common >= PERCENT * whole) & (root_a[:, None] != root_b[None, :]))
    pairs = np.unique(np.sort(np.stack([root_a[i], root_b[j]], axis=1), axis=1), axis=0)
    named = list(number)
    return pa.table({c: pa.array([named[k] for k in pairs[:, n]], pa.binary()) for n, c in enumerate(("a", "b"))})


def _further_links(rest: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of roots that a link between members of a bucket joins.

    `rest` has band, value, key, n and root of the members but for the pivots. In a bucket, each pair of
    different roots has a member outside the bucket's largest root, so those are compared with all
    members. Buckets of the same members are compared once. A bucket of many members, or of long ones, is
    cut into blocks, and each block of the ones meets each block of the others in a task of bounded size.
    """
    hashed = rest.select("*", F.xxhash64("key").alias("h"), F.xxhash64("key", F.lit(1)).alias("g"))
    roots = hashed.groupBy("band", "value", "root").agg(
        F.count("*").alias("size"), F.sum("n").alias("shingles"), F.sum(F.col("h").cast("decimal(38,0)")).alias("sum"), F.bit_xor("g").alias("xor")
    )
    buckets = (
        roots.groupBy("band", "value")
        .agg(
            F.max(F.struct("size", "root")).alias("largest"),
            F.count("*").alias("roots"),
            F.sum("size").alias("size"),
            F.sum("shingles").alias("shingles"),
            F.sum("sum").alias("sum"),
            F.bit_xor("xor").alias("xor"),
        )
        .where("roots > 1")
        .groupBy("size", "shingles", "sum", "xor")
        .agg(F.min(F.struct("band", "value", F.col("largest.root").alias("largest"))).alias("bucket"))
        .select("bucket.*", F.ceil(F.greatest(F.col("size") / BLOCK, F.col("shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    )
    members = hashed.join(buckets, ["band", "value"]).join(sets, "key").withColumn("block", F.pmod("h", "blocks").cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    sides = {
        "a": members.where(F.col("root") != F.col("largest")).withColumn("other", every),
        "b": members.withColumn("other", F.col("block")).withColumn("block", every),
    }
    keys = ("band", "value", "block", "other")
    left, right = (
        side.select(*(F.col(c).alias(f"{c}_{mark}") for c in (*keys, "key", "root", "elements"))).groupBy(*(f"{k}_{mark}" for k in keys))
        for mark, side in sides.items()
    )
    return left.cogroup(right).applyInArrow(_linked_roots, "a binary, b binary")


def near_duplicates(docs: DataFrame, words: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept, mark.

    Documents whose sets of shingles are equal are one class. Classes that share a band of their sketches
    meet in a bucket, and only the least row of a class does, so copies cost nothing. In each bucket all
    members are compared with one pivot, the member that shares most buckets, on their whole sets. Members
    that are then still in different components are compared with the rest of their bucket, where those
    of the bucket's largest component need not be compared with each other. So every two classes that
    share a bucket and are alike end in one component, and no bucket gives all its pairs.

    A text without words has no shingles and is linked with nothing: its component is its own doc_id. A null
    doc_id never names a component that has another; a row is kept if its doc_id is the component's. Rows
    that repeat a doc_id and its text are one class and are all kept or dropped. Other columns are ignored,
    whatever their names. No rows give no rows. A very long text is hashed and sketched piece by piece; its set
    takes eight bytes a shingle. Sets hold 64-bit hashes of shingles, and similarity is counted on whole sets. `mark` is xxhash64 of the text, to find a row again together with its doc_id.
    """
    source = docs.select("doc_id", F.xxhash64("text").alias("mark"), "text")
    found = stored(
        source.mapInArrow(
            _sketched(words, bands, rows),
            "doc_id long, mark long, n_shingles long, key binary, bands array<long>",
        )
    )
    classes = stored(
        found.where("n_shingles > 0")
        .groupBy("key")
        .agg(
            F.min(F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "mark")).alias("least"),
            F.first("n_shingles").alias("n"),
            F.first("bands").alias("bands"),
        )
        .select("key", "n", "bands", F.col("least.doc_id").alias("least_id"), F.col("least.mark").alias("least_mark"))
    )
    members = classes.select("key", "least_id", "least_mark", "n", F.posexplode("bands").alias("band", "value"))
    sizes = members.groupBy("band", "value").agg(F.count("*").alias("size")).where("size > 1")
    members = stored(members.join(sizes, ["band", "value"]))
    popular = members.groupBy("key").agg(F.sum("size").alias("popularity"))
    ranked = members.join(popular, "key").groupBy("band", "value").agg(F.max(F.struct("popularity", "key", "n")).alias("pivot"))
    with_pivot = stored(members.join(ranked, ["band", "value"]).where(F.col("key") != F.col("pivot.key")))

    candidates = members.select("key", "least_id", "least_mark").distinct()
    texts = source.join(
        candidates, source["doc_id"].eqNullSafe(candidates["least_id"]) & (source["mark"] == candidates["least_mark"])
    )
    sets = stored(texts.select("key", "text").mapInArrow(_sets(words), "key binary, elements array<long>").dropDuplicates(["key"]))

    pairs = with_pivot.where(_may_be_alike(F.col("n"), F.col("pivot.n"))).select(F.col("pivot.key").alias("a"), F.col("key").alias("b"))
    roots = connected_components(_resolved(pairs.distinct(), sets))

    rest = stored(
        with_pivot.select("band", "value", "key", "n")
        .join(roots.withColumnRenamed("node", "key"), "key", "left")
        .withColumn("root", F.coalesce("root", "key"))
    )
    second = connected_components(_further_links(rest, sets)).select(F.col("node").alias("root"), F.col("root").alias("final"))

    labelled = (
        classes.select("key", "least_id")
        .join(roots.withColumnRenamed("node", "key"), "key", "left")
        .withColumn("root", F.coalesce("root", "key"))
        .join(second, "root", "left")
        .withColumn("root", F.coalesce("final", "root"))
        .select("key", "least_id", "root")
    )
    least = labelled.groupBy("root").agg(F.min("least_id").alias("component_id"))
    answer = labelled.join(least, "root").select("key", "component_id")
    return (
        found.join(answer, "key", "left")
        .withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
        .select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "mark")
    )


def without_near_duplicates(docs: DataFrame, words: int = PIPELINE_SHINGLE) -> DataFrame:
    """One document of each component, with the columns of documents that `docs` has.

    The document with the least doc_id of a component stays, and so does every text without words. Rows that
    repeat a doc_id and its text stay or go together. Other columns are left out, whatever their names. No rows give
    no rows; a very long text counts as a whole.
    """
    columns = [c for c in DOCUMENT if c in docs.columns]
    stay = near_duplicates(docs, words).where("kept").select(F.col("doc_id").alias("kept_id"), F.col("mark").alias("kept_mark"))
    rows = docs.select(*columns, F.xxhash64("text").alias("kept_mark"))
    same = rows["doc_id"].eqNullSafe(F.col("kept_id")) & (rows["kept_mark"] == stay["kept_mark"])
    return rows.join(stay, same, "left_semi").select(*columns)


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("mark")


OP4_SQL = r"""
WITH RECURSIVE worded AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x20\x09-\x0D]+') AS w
    FROM documents
), shingles AS (
    SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS s
    FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 2))) AS i FROM worded WHERE len(w) > 0)
), sizes AS (
    SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
    SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common
    FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id
), links AS (
    SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
    WHERE 100 * common >= 80 * (p.n + q.n - common)
), ways AS (
    SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reached AS (
    SELECT doc_id AS x, doc_id AS y FROM documents
    UNION
    SELECT reached.x, ways.y FROM reached JOIN ways ON reached.y = ways.x
)
SELECT x AS doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(y) AS component_id, x = min(y) AS kept
FROM reached LEFT JOIN sizes ON sizes.doc_id = reached.x GROUP BY x
"""
