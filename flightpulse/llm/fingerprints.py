"""Near-duplicate detection by 64-bit similarity fingerprints and an inverted index of their bytes."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flightpulse.llm.components import connected_components
from flightpulse.llm.shared import stored, table, utf8

SHINGLE = 4
SEED = 42
#: Fingerprints with at most this many differing bits are linked.
DISTANCE = 4
BYTES = 8
#: Differing bits spoil at most as many bytes, so linked fingerprints share at least this many.
LEAST_SHARED = BYTES - DISTANCE
#: Positional bytes in an index key.
KEY_BYTES = 3
#: Bytes of a text that are split into words at a time.
STRETCH = 1 << 20
#: Members of an index entry that one task compares with as many others.
BLOCK = 16_384
#: Entries up to this size are compared together, by shifts of the sorted rows.
SHORT = 48
TILE = 1024

U = np.uint64
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def word_stretches(data: bytes, size: int = STRETCH) -> Iterator[list[bytes]]:
    """The words of UTF-8 bytes with A-Z folded, a stretch of the text at a time; no word is cut."""
    at = 0
    while at < len(data):
        gap = _SPACE.search(data, at + size)
        end = gap.start() if gap else len(data)
        yield data[at:end].translate(_FOLD).split()  # splits at ASCII white space only
        at = end


def shingle_hashes(words: list[bytes], width: int) -> np.ndarray:
    """XXH64 of each run of `width` words, joined by one space."""
    import xxhash

    joined = b" ".join(words)
    length = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(length + 1) - 1
    begin = end - length
    digest = xxhash.xxh64_intdigest
    runs = zip(begin[: len(words) - width + 1].tolist(), end[width - 1 :].tolist())
    return np.array([digest(joined[a:b], SEED) for a, b in runs], U)


def fingerprint(data: bytes, width: int = SHINGLE, stretch: int = STRETCH) -> int:
    """The fingerprint of a text: a bit is 1 if more than half of the shingles' hashes have it."""
    ones, total, words = np.zeros(64, np.int64), 0, []
    for more in word_stretches(data, stretch):
        words += more
        if len(words) >= width:
            hashes = shingle_hashes(words, width)
            bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones += bits.sum(0, dtype=np.int64)
            total += len(hashes)
            words = words[len(words) - width + 1 :]
    if not total and words:
        bits = np.unpackbits(shingle_hashes(words, len(words)).view(np.uint8), bitorder="little")
        ones, total = ones + bits, 1
    return int(np.packbits(2 * ones > total, bitorder="little").view(U)[0])


def _fingerprinted(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(data.tobytes(), width) for data in utf8(batch.column("text"))], U)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return run


def key_positions() -> list[tuple[int, ...]]:
    """Triples of byte positions such that any four positions contain one of them.

    The positions fall into three parts of nearly equal size. A triple is taken if it lies in one part, or
    has two positions in a part and one in the next part (cyclically): four positions always have such a triple.
    """
    part = [p * 3 // BYTES for p in range(BYTES)]

    def taken(triple: tuple[int, ...]) -> bool:
        in_part = [sum(part[p] == k for p in triple) for k in range(3)]
        return 3 in in_part or any(in_part[k] == 2 and in_part[(k + 1) % 3] == 1 for k in range(3))

    return [triple for triple in combinations(range(BYTES), KEY_BYTES) if taken(triple)]


def index_keys(fp: Column) -> Column:
    """The index keys of a fingerprint: number of the triple of positions, and the bytes there."""

    def byte(position: int) -> Column:
        return F.shiftrightunsigned(fp, 8 * position).bitwiseAND(F.lit(255).cast("long"))

    keys = []
    for number, positions in enumerate(key_positions()):
        key = F.lit(number).cast("long")
        for position in positions:
            key = F.shiftleft(key, 8).bitwiseOR(byte(position))
        keys.append(key)
    return F.array(*keys)


def shared_bytes(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many positional bytes fingerprints share (arrays of uint64 that broadcast)."""
    tally = np.zeros(np.broadcast_shapes(left.shape, right.shape), np.uint8)
    for position in range(BYTES):
        shift = U(8 * position)
        tally += (left >> shift).astype(np.uint8) == (right >> shift).astype(np.uint8)
    return tally


def linked(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Pairs (positions) of linked fingerprints, by count filter and verification, a tile at a time."""
    found = []
    for i in range(0, len(left), TILE):
        for j in range(0, len(right), TILE):
            a, b = np.nonzero(shared_bytes(left[i : i + TILE, None], right[None, j : j + TILE]) >= LEAST_SHARED)
            near = np.bitwise_count(left[i + a] ^ right[j + b]) <= DISTANCE
            found.append(_forest(i + a[near], j + b[near] + len(left)))
    return np.concatenate(found, axis=1) if found else np.empty((2, 0), np.int64)


def _forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Pairs that connect the same nodes as the pairs (a, b), at most one for each node."""
    if not len(a):
        return np.empty((2, 0), np.int64)
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = place[: len(a)], place[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[x], label[y])
        after = label.copy()
        np.minimum.at(after, x, least)
        np.minimum.at(after, y, least)
        after = after[after]
        if (after == label).all():
            break
        label = after
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return np.stack([nodes[label[moved]], nodes[moved]])


def _links_of_short(fps: np.ndarray, entry: np.ndarray, longest: int) -> np.ndarray:
    """Pairs (positions) of linked fingerprints among rows sorted by entry, all short entries at once."""
    a_found, b_found = [], []
    for shift in range(1, longest):
        a = np.flatnonzero(entry[shift:] == entry[:-shift])
        a = a[shared_bytes(fps[a], fps[a + shift]) >= LEAST_SHARED]
        a = a[np.bitwise_count(fps[a] ^ fps[a + shift]) <= DISTANCE]
        a_found.append(a)
        b_found.append(a + shift)
    if not a_found:
        return np.empty((2, 0), np.int64)
    return _forest(np.concatenate(a_found), np.concatenate(b_found))


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within each cell of rows sorted by cell (key, i, j); a cell never ends inside what is worked on."""
    names = ("key", "i", "j", "block", "fp")
    waiting = [np.empty(0, np.int64)] * len(names)

    def worked(columns: list[np.ndarray]) -> pa.RecordBatch:
        key, i, j, block, fp = columns
        fps = fp.view(U)
        starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])) if len(key) else key
        size = np.diff(np.append(starts, len(key)))
        entry = np.repeat(np.arange(len(starts)), size)
        found = []
        short = (size <= SHORT) & (i[starts] == j[starts])
        if short.any():
            at = np.flatnonzero(short[entry])
            found.append(at[_links_of_short(fps[at], entry[at], int(size[short].max()))])
        for k in np.flatnonzero(~short):
            at = np.arange(starts[k], starts[k] + size[k])
            left = at if i[starts[k]] == j[starts[k]] else at[block[at] == i[starts[k]]]
            right = at if i[starts[k]] == j[starts[k]] else at[block[at] == j[starts[k]]]
            found.append(np.concatenate([left, right])[linked(fps[left], fps[right])])
        pairs = np.concatenate(found, axis=1) if found else np.empty((2, 0), np.int64)
        a, b = fp[pairs[0]], fp[pairs[1]]
        return pa.RecordBatch.from_arrays([pa.array(a[a != b]), pa.array(b[a != b])], names=["a", "b"])

    for batch in batches:
        rows = [batch.column(n).to_numpy(zero_copy_only=False) for n in names]
        waiting = [np.concatenate(pair) for pair in zip(waiting, rows)]
        if not len(waiting[0]):
            continue
        last = [column[-1] for column in waiting[:3]]
        same = np.ones(len(waiting[0]), bool)
        for column, value in zip(waiting, last):
            same &= column == value
        end = len(same) - int(same.sum())
        yield worked([column[:end] for column in waiting])
        waiting = [column[end:] for column in waiting]
    yield worked(waiting)


def fingerprint_links(fingerprints: DataFrame, block_rows: int = BLOCK) -> DataFrame:
    """Pairs (a, b) that connect all linked fingerprints of `fingerprints` (distinct longs `fp`).

    The inverted index lists the fingerprints under the bytes at triples of positions. Linked ones share
    four positional bytes or more, hence one of the triples, so they meet in an entry of the index. There
    the shared positional bytes of each pair are tallied, pairs with the guaranteed minimum are kept, and
    their differing bits are counted. An entry gives at most one pair for each member, tile by tile,
    never all its pairs. Entries of more than `block_rows` members are cut into blocks, and each pair of
    blocks is a cell of its own, so no task holds a whole large entry.
    """
    postings = fingerprints.select("fp", F.explode(index_keys(F.col("fp"))).alias("key"))
    sizes = postings.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    members = postings.join(sizes, "key").withColumn("blocks", F.ceil(F.col("size") / block_rows).cast("int"))
    cells = (
        members.withColumn("block", F.pmod(F.xxhash64("fp"), "blocks").cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "fp")
    )
    return (
        cells.repartition("key", "i", "j")
        .sortWithinPartitions("key", "i", "j", "fp")
        .mapInArrow(_compared, "a long, b long")
    )


def similar_fingerprints(docs: DataFrame, words: int = SHINGLE) -> DataFrame:
    """One row per document: doc_id, fp (the fingerprint's bits as a long), component_id.

    Words are runs without ASCII white space, with A-Z in lower case. Every occurrence of a shingle of `words`
    words counts; a text with fewer words is one shingle. Fingerprints of at most DISTANCE differing
    bits are linked; component_id is the smallest doc_id in the component of links.

    A null or empty text, or one of white space only, has fingerprint zero, which is linked like any other. A
    null doc_id never names a component that has another. Repeated rows give repeated rows; equal fingerprints
    are compared once. Texts of any length count whole and are worked on a stretch at a time; other columns
    are ignored, whatever their names. No documents give no rows.
    """
    found = stored(docs.select("doc_id", "text").mapInArrow(_fingerprinted(words), "doc_id long, fp long"))
    classes = stored(found.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    roots = connected_components(fingerprint_links(classes.select("fp")))
    rooted = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return found.join(rooted.join(least, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id for all `documents`."""
    return similar_fingerprints(table(spark, sf_dir, "documents")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
