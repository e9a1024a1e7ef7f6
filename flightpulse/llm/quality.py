"""Text quality by a byte-level convolutional network in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flightpulse.llm.shared import DOCUMENT, fold, labelled_sample, logistic, table, utf8

#: Bytes under a filter, bytes between two of its places, filters, and numbers for each byte.
WIDTH, STRIDE, FILTERS, EMBEDDING = 8, 4, 32, 8
#: Places of the filters in a chunk, and between the beginnings of two chunks: chunks overlap by half.
CHUNK, STEP = 64, 32
HIDDEN = 24
#: Labelled rows of either class that the network is fitted on, at most; whole texts, however long.
PER_CLASS = 1500
#: Steps of the optimiser, and rows of one: a small sample is gone through more often.
STEPS, ROWS = 560, 32
RATE = 0.004
FOLDS = 3
#: Chunks that are scored at once.
BLOCK = 2048

Parameters = dict[str, np.ndarray]


def initial(seed: int = 7) -> Parameters:
    draw = np.random.default_rng(seed)
    inputs = 3 * FILTERS
    return {
        "bytes": draw.normal(0, 1, (256, EMBEDDING)).astype(np.float32),
        "filters": draw.normal(0, 1 / np.sqrt(WIDTH * EMBEDDING), (WIDTH * EMBEDDING, FILTERS)).astype(np.float32),
        "offsets": np.zeros(FILTERS, np.float32),
        "hidden": draw.normal(0, 1 / np.sqrt(inputs), (inputs, HIDDEN)).astype(np.float32),
        "hidden_offsets": np.zeros(HIDDEN, np.float32),
        "out": draw.normal(0, 0.3, HIDDEN).astype(np.float32),
        "out_offset": np.zeros(1, np.float32),
    }


def chunks(data: np.ndarray) -> np.ndarray:
    """All overlapping chunks of a text as rows of bytes; the last is filled up with spaces."""
    span = (CHUNK - 1) * STRIDE + WIDTH
    shift = STEP * STRIDE
    count = 1 + max(0, -(-(len(data) - span) // shift))
    padded = np.full(span + (count - 1) * shift, 0x20, np.uint8)
    padded[: len(data)] = data
    return np.lib.stride_tricks.as_strided(padded, (count, span), (shift, 1))


def _convolved(p: Parameters, block: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The filters' inputs, their outputs at each place of each chunk, and the chunk's pooled outputs."""
    embedded = p["bytes"][block]
    n, span, size = embedded.shape
    a, b, c = embedded.strides
    windows = np.lib.stride_tricks.as_strided(embedded, (n, CHUNK, WIDTH * size), (a, STRIDE * b, c))
    windows = windows.reshape(n * CHUNK, -1)
    active = np.maximum(windows @ p["filters"] + p["offsets"], 0).reshape(n, CHUNK, FILTERS)
    mean = active.mean(1)
    pooled = np.concatenate([mean, mean * mean, 0.3 * active.max(1)], axis=1)
    return windows, active, pooled


def chunk_units(p: Parameters, block: np.ndarray) -> np.ndarray:
    """The hidden units of each chunk."""
    parts = [
        np.maximum(_convolved(p, block[at : at + BLOCK])[2] @ p["hidden"] + p["hidden_offsets"], 0)
        for at in range(0, len(block), BLOCK)
    ]
    return np.concatenate(parts)


def probability(p: Parameters, data: np.ndarray) -> float:
    """Probability of good quality: the units' maxima over all chunks, combined by one logistic output."""
    best = np.zeros(HIDDEN, np.float32)
    view = chunks(data)
    for at in range(0, len(view), BLOCK):
        best = np.maximum(best, chunk_units(p, view[at : at + BLOCK]).max(0))
    return float(logistic(np.float64(best @ p["out"] + p["out_offset"][0])))


def _telling(p: Parameters, view: np.ndarray) -> np.ndarray:
    """The chunks of a text that hold a unit's maximum: no error flows to others."""
    return view if len(view) <= HIDDEN else view[np.unique(chunk_units(p, view).argmax(0))]


def _gradients(p: Parameters, texts: list[np.ndarray], y: np.ndarray, weight: np.ndarray) -> Parameters:
    """Gradients of the weighted log loss; a text's error flows to the chunks that hold its maxima."""
    views = [_telling(p, chunks(t)) for t in texts]
    at = np.cumsum([0] + [len(v) for v in views])
    block = np.concatenate(views)
    windows, active, pooled = _convolved(p, block)
    before = pooled @ p["hidden"] + p["hidden_offsets"]
    units = np.maximum(before, 0)
    top = np.array([units[a:b].argmax(0) + a for a, b in zip(at[:-1], at[1:])])
    best = np.take_along_axis(units, top, axis=0) if len(top) else units
    score = logistic((best @ p["out"] + p["out_offset"][0]).astype(np.float64))
    error = (weight * (score - y) / len(y)).astype(np.float32)
    g: Parameters = {"out": best.T @ error, "out_offset": error.sum(keepdims=True)}
    down = error[:, None] * p["out"][None, :] * (best > 0)
    d_units = np.zeros_like(units)
    np.add.at(d_units, (top.ravel(), np.tile(np.arange(HIDDEN), len(top))), down.ravel())
    g["hidden"] = pooled.T @ d_units
    g["hidden_offsets"] = d_units.sum(0)
    d_pooled = d_units @ p["hidden"].T
    mean = pooled[:, :FILTERS]
    d_mean = d_pooled[:, :FILTERS] + 2 * mean * d_pooled[:, FILTERS : 2 * FILTERS]
    d_active = np.repeat(d_mean[:, None, :] / CHUNK, CHUNK, axis=1)
    peak = active.argmax(1)
    rows, columns = np.indices(peak.shape)
    d_active[rows, peak, columns] += 0.3 * d_pooled[:, 2 * FILTERS :]
    d_active *= active > 0
    flat = d_active.reshape(-1, FILTERS)
    g["filters"] = windows.T @ flat
    g["offsets"] = flat.sum(0)
    d_windows = (flat @ p["filters"].T).reshape(len(block), CHUNK, WIDTH, EMBEDDING)
    d_embedded = np.zeros((len(block), block.shape[1], EMBEDDING), np.float32)
    for j in range(WIDTH):
        d_embedded[:, j : j + CHUNK * STRIDE : STRIDE][:, :CHUNK] += d_windows[:, :, j]
    order = block.ravel()
    g["bytes"] = np.stack(
        [np.bincount(order, d_embedded[..., e].ravel(), 256) for e in range(EMBEDDING)], axis=1
    ).astype(np.float32)
    return g


def fitted(texts: list[np.ndarray], y: np.ndarray, weight: np.ndarray, steps: int = STEPS, batch: int = ROWS, seed: int = 7) -> Parameters:
    """The network after `steps` steps of Adam through the shuffled sample, the rate falling to zero."""
    p = initial(seed)
    first = {k: np.zeros_like(v) for k, v in p.items()}
    second = {k: np.zeros_like(v) for k, v in p.items()}
    draw = np.random.default_rng(seed)
    order = np.empty(0, np.int64)
    for t in range(1, steps + 1):
        while len(order) < batch:
            order = np.concatenate([order, draw.permutation(len(texts))])
        rows, order = order[:batch], order[batch:]
        g = _gradients(p, [texts[i] for i in rows], y[rows], weight[rows])
        rate = RATE * (1 - (t - 1) / steps) * min(1.0, t / 20)
        for k in p:
            first[k] = 0.9 * first[k] + 0.1 * g[k]
            second[k] = 0.999 * second[k] + 0.001 * g[k] ** 2
            p[k] -= rate * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-7)
    return p


def fitted_model(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Parameters:
    """A network fitted on a bounded sample of labelled rows outside the held-out fold.

    Rows count by the number of labels they stand for, so scores follow the labels' shares. With labels of
    one class, or none, every score is that of the class, or 1.
    """
    learn = fold(F.col("doc_id"), FOLDS).isin(0, 2)
    sample, weight = labelled_sample(docs, labels, "quality", learn, per_class)
    rows = sample.where(F.col("text").isNotNull()).orderBy(F.xxhash64("doc_id"), "doc_id", "text").collect()
    y = np.array([row["label"] for row in rows], float)
    if len(set(y)) < 2:
        p = initial()
        p["out"][:] = 0
        p["out_offset"][:] = -20 if len(y) and y[0] == 0 else 20
        return p
    texts = [np.frombuffer(row["text"].encode("utf-8", "replace"), np.uint8) for row in rows]
    weights = np.array([weight[int(k)] for k in y])
    return fitted(texts, y, np.clip(weights / weights.mean(), 0.2, 5.0))


def _scored(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = model.value
        for batch in batches:
            score = np.array([probability(p, data) for data in utf8(batch.column("text"))], float)
            kept = [batch.column(n) for n in batch.schema.names if n != "text"]
            names = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=[*names, "score", "predicted"]
            )

    return run


def quality(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    The network sees every byte of a text. Labels are learned only from rows whose crc32 of doc_id modulo 3
    is not 1; a null doc_id is neither learned from nor held out. A null or empty text is scored as one
    chunk of spaces. Repeated rows give repeated rows; other columns are ignored, whatever their
    names. No documents give no rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(fitted_model(docs, labels, per_class))
    source = docs.select("doc_id", (fold(F.col("doc_id"), FOLDS) == 1).alias("held_out"), "text")
    return source.mapInArrow(_scored(model), "doc_id long, held_out boolean, score double, predicted int")


def good_documents(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """The documents that the classifier accepts, with the columns of documents that `docs` has."""
    columns = [c for c in DOCUMENT if c in docs.columns]
    model = docs.sparkSession.sparkContext.broadcast(fitted_model(docs, labels, per_class))
    source = docs.select(*columns)

    def accepted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = model.value
        for batch in batches:
            good = [probability(p, data) >= 0.5 for data in utf8(batch.column("text"))]
            yield batch.filter(pa.array(good, pa.bool_()))

    return source.mapInArrow(accepted, source.schema)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
