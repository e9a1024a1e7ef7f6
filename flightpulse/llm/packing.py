"""Best-fit packing of documents into sequences, under conflicts."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flightpulse.llm.block_naming import normalised
from flightpulse.llm.shared import table, word_count

CAPACITY = 2048
#: Documents of one shard on average. A shard is packed in one task, and bins never span shards.
SHARD_ROWS = 4096
#: Bins that the successor search looks at in one step.
STEP = 64


class OpenBins:
    """Open bins in order of residual, each with a bitmap of its sources and one of its clusters."""

    def __init__(self, capacity: int, sources: int, clusters: int, most: int) -> None:
        self.capacity = capacity
        self.residuals = np.empty(most, np.int64)
        self.order = np.empty(most, np.int64)  # numbers of open bins, by residual, then number
        self.open = 0
        self.used = np.zeros(most, np.int64)
        self.sources = np.zeros((sources // 64 + 1, most), np.uint64)
        self.clusters = np.zeros((clusters // 64 + 1, most), np.uint64)
        self.bins = 0

    def _free(self, bins: np.ndarray, source: int, cluster: int) -> np.ndarray:
        taken = np.zeros(len(bins), bool)
        for bitmap, bit in ((self.sources, source), (self.clusters, cluster)):
            if bit >= 0:
                taken |= (bitmap[bit >> 6, bins] >> np.uint64(bit & 63)) & np.uint64(1) != 0
        return ~taken

    def place(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """Bin and offset of a piece: the tightest open bin that fits and holds neither its source nor its cluster."""
        at = int(np.searchsorted(self.residuals[: self.open], size))
        found = -1
        while at < self.open:
            free = self._free(self.order[at : min(at + STEP, self.open)], source, cluster)
            if free.any():
                found = at + int(free.argmax())
                break
            at += STEP
        if found < 0:
            number, residual = self.bins, self.capacity
            self.bins += 1
        else:
            number, residual = int(self.order[found]), int(self.residuals[found])
            self.residuals[found : self.open - 1] = self.residuals[found + 1 : self.open].copy()
            self.order[found : self.open - 1] = self.order[found + 1 : self.open].copy()
            self.open -= 1
        offset = int(self.used[number])
        self.used[number] += size
        for bitmap, bit in ((self.sources, source), (self.clusters, cluster)):
            if bit >= 0:
                bitmap[bit >> 6, number] |= np.uint64(1) << np.uint64(bit & 63)
        if residual > size:
            self._insert(number, residual - size)
        return number, offset

    def _insert(self, number: int, residual: int) -> None:
        low = int(np.searchsorted(self.residuals[: self.open], residual))
        high = int(np.searchsorted(self.residuals[: self.open], residual, side="right"))
        at = low + int(np.searchsorted(self.order[low:high], number))
        for values, value in ((self.residuals, residual), (self.order, number)):
            values[at + 1 : self.open + 1] = values[at : self.open].copy()
            values[at] = value
        self.open += 1


def _numbers(values: list, shared_only: bool) -> tuple[np.ndarray, int]:
    """Bit numbers of the values; -1 for null and, with `shared_only`, for values that occur once."""
    counts = Counter(values)
    shared = [v for v, n in counts.items() if v is not None and (n > 1 or not shared_only)]
    number = {value: bit for bit, value in enumerate(shared)}
    return np.array([number.get(v, -1) for v in values], np.int64), len(shared)


def packed(sizes: list[int], sources: list, clusters: list, capacity: int) -> tuple[list[int], list[int], list[int]]:
    """Row, bin and offset of each piece of a shard, whose rows come largest first.

    A row larger than a bin fills whole bins of its own; only its last piece is placed among others.
    """
    source_bits, source_count = _numbers(sources, False)
    cluster_bits, cluster_count = _numbers(clusters, True)
    bins = OpenBins(capacity, source_count, cluster_count, len(sizes))
    rows, numbers, offsets = [], [], []
    whole = 0
    for i, size in enumerate(sizes):
        full, rest = divmod(size, capacity)
        rows.extend([i] * full)
        numbers.extend(range(-whole - 1, -whole - full - 1, -1))
        offsets.extend([0] * full)
        whole += full
        if rest:
            number, offset = bins.place(rest, int(source_bits[i]), int(cluster_bits[i]))
            rows.append(i)
            numbers.append(number)
            offsets.append(offset)
    return rows, [n if n >= 0 else bins.bins - n - 1 for n in numbers], offsets


def _packed_shard(capacity: int):
    def run(shard: pa.Table) -> pa.Table:
        shard = shard.sort_by([("rest", "descending"), ("size", "descending"), ("doc_id", "ascending"), ("place", "ascending")])
        sizes = shard.column("size").to_pylist()
        rows, bins, offsets = packed(sizes, shard.column("source").to_pylist(), shard.column("cluster").to_pylist(), capacity)
        seen: dict[int, int] = {}
        pieces = []
        for row in rows:
            pieces.append(seen.get(row, 0))
            seen[row] = pieces[-1] + 1
        lengths = [min(capacity, sizes[r] - p * capacity) for r, p in zip(rows, pieces)]
        taken = shard.select(["doc_id", "source", "cluster", "shard"]).take(pa.array(rows, pa.int64()))
        return pa.table(
            {
                "doc_id": taken.column("doc_id"),
                "source": taken.column("source"),
                "cluster": taken.column("cluster"),
                "piece": pa.array(pieces, pa.int32()),
                "first_word": pa.array([p * capacity for p in pieces], pa.int64()),
                "n_words": pa.array(lengths, pa.int64()),
                "shard": taken.column("shard"),
                "bin": pa.array(bins, pa.int32()),
                "bin_offset": pa.array(offsets, pa.int64()),
            }
        )

    return run


def pack(docs: DataFrame, cluster: Column | None = None, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per piece: doc_id, source, cluster, piece, first_word, n_words, shard, bin, bin_offset.

    A bin (`shard`, `bin`) holds up to `capacity` words. It never holds two pieces of one source, nor two
    of one duplicate cluster; `cluster` defaults to a hash of the text with white space normalised, so copies
    never meet. Documents go largest first to the tightest open bin that fits and has no conflict, and
    open a new bin if there is none. A longer document is cut into pieces of `capacity` words that fill
    bins of their own, and a last piece that is packed like a document.

    Documents are dealt to shards by a hash of id and size, so a source or cluster with a third of all rows
    is spread over all shards; packing again gives the same bins. A document without words, or a null
    text, has no piece. A null source, or a null cluster, conflicts with nothing. Repeated rows are
    separate documents of one cluster. Other columns are ignored, whatever their names. No rows give
    no rows.
    """
    shards = max(1, -(-docs.count() // shard_rows))
    cluster = F.xxhash64(normalised(F.col("text"))) if cluster is None else cluster
    rows = (
        docs.select("doc_id", F.col("source"), cluster.cast("long").alias("cluster"), word_count(F.col("text")).alias("size"))
        .where("size > 0")
        .withColumn("rest", (F.col("size") - 1) % capacity + 1)
        .withColumn("place", F.xxhash64("doc_id", "cluster", "size"))
        .withColumn("shard", F.pmod(F.xxhash64("doc_id", "size", "cluster", F.lit("shard")), F.lit(shards)).cast("int"))
    )
    return rows.groupBy("shard").applyInArrow(
        _packed_shard(capacity),
        "doc_id long, source string, cluster long, piece int, first_word long, n_words long, shard int, bin int, bin_offset long",
    )


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
