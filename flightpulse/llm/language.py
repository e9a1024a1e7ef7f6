"""Language identification by error-correcting output codes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flightpulse.llm.shared import fold, table, utf8

UNKNOWN = "und"
#: Hashed n-grams of 1 to LONGEST bytes share this many features.
FEATURES = 4096
LONGEST = 3
#: Labelled rows of each language that the classifiers are fitted on, at most.
PER_LANGUAGE = 800
#: Languages up to which the code has every possible split; beyond, bits for each doubling of languages.
EXHAUSTIVE = 6
BITS_PER_DOUBLING = 12
#: Below this score a prediction is flagged as ambiguous.
CERTAIN = 0.6
FOLDS = 3
STEPS = 150
STRETCH = 1 << 20

_LOWER = np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256)).astype(np.uint32)


#: Languages; their codewords (languages x bits, of -1 and 1); weights (features x bits) and offsets of the bits.
Model = tuple[list[str], np.ndarray, np.ndarray, np.ndarray]


def codewords(languages: int, seed: int = 5) -> np.ndarray:
    """A codeword of -1 and 1 for each language.

    Few languages get every split in two. More get, out of many drawn codes, the one whose two
    closest codewords differ in most bits, so that some wrong bits still decode rightly.
    """
    if languages <= 1:
        return np.ones((languages, 1), np.int8)
    if languages <= EXHAUSTIVE:
        split = np.arange(1, 1 << (languages - 1))
        return np.where((split[None, :] >> np.arange(languages)[:, None]) & 1, 1, -1).astype(np.int8)
    bits = BITS_PER_DOUBLING * int(np.ceil(np.log2(languages)))
    draw = np.random.default_rng(seed)
    best, best_distance = None, -1
    for _ in range(40):
        code = draw.choice(np.array([-1, 1], np.int8), (languages, bits))
        agree = code.astype(np.int32) @ code.T.astype(np.int32)
        np.fill_diagonal(agree, -bits)
        useful = np.abs(code.sum(0)).max() < languages
        distance = (bits - agree.max()) // 2
        if useful and distance > best_distance:
            best, best_distance = code, distance
    return best if best is not None else code


def profile(data: np.ndarray) -> np.ndarray:
    """Square roots of the shares of a text's hashed byte n-grams; of length 1, or 0 for no text."""
    counts = np.zeros(FEATURES)
    for begin in range(0, len(data), STRETCH):
        piece = _LOWER[data[max(0, begin - LONGEST + 1) : begin + STRETCH]]
        skipped = min(begin, LONGEST - 1)
        number = np.zeros(len(piece), np.uint32)
        for n in range(1, LONGEST + 1):
            number = number[: len(piece) - n + 1] * np.uint32(257) + piece[n - 1 :] + np.uint32(1)
            hashed = (number * np.uint32(2654435761)) >> np.uint32(20)
            counts += np.bincount(hashed[max(0, skipped - n + 1) :], minlength=FEATURES)
    total = counts.sum()
    return np.sqrt(counts / total) if total else counts


def fitted(x: np.ndarray, bits: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """One logistic classifier for each bit (-1 or 1), all by the same rounds of Adam."""
    x = x.astype(np.float32)
    weights = np.zeros((x.shape[1], bits.shape[1]), np.float32)
    offsets = np.zeros(bits.shape[1], np.float32)
    state = [[np.zeros_like(v), np.zeros_like(v)] for v in (weights, offsets)]
    for t in range(1, steps + 1):
        margin = bits * (x @ weights + offsets)
        pull = (-bits / (1 + np.exp(np.clip(margin, -30, 30))) / len(x)).astype(np.float32)
        for value, (first, second), slope in zip((weights, offsets), state, (x.T @ pull + 1e-6 * weights, pull.sum(0))):
            first += 0.1 * (slope - first)
            second += 0.01 * (slope**2 - second)
            value -= 0.3 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
    return weights, offsets


def decoded(code: np.ndarray, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest codeword of each row, and its share of all languages' weights.

    A bit counts by the logistic loss of its margin, so an unsure bit hardly tells and a sure one does;
    a language's weight is e to minus the loss of its codeword.
    """
    loss = np.logaddexp(0, -margins[:, None, :] * code[None, :, :]).sum(2)
    weight = np.exp(-(loss - loss.min(1, keepdims=True)))
    return loss.argmin(1), weight.max(1) / weight.sum(1)


def _profiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [profile(data).astype(np.float32) for data in utf8(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(found, pa.list_(pa.float32()))], names=["lang", "profile"])


#: Rows of a language that are ranked for the sample, as a multiple of the sample's.
LOOKED_AT = 4


def fitted_model(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """Classifiers fitted on at most `per_language` rows of each language, those with the smallest hash of id and text.

    Only rows with a language and a text whose crc32 of doc_id modulo 3 is not 1 are learned from; equal rows
    count once. A language's count tells below which hash its rows are looked at, so that however many it
    has, a few times `per_language` of them are ranked.
    """
    known = docs.where(fold(F.col("doc_id"), FOLDS).isin(0, 2) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    known = known.select("doc_id", "lang", "text", F.xxhash64("text").alias("mark"))
    bounds = known.groupBy("lang").agg((F.lit(float(LOOKED_AT * per_language << 31)) / F.count("*")).alias("bound"))
    place = F.pmod(F.xxhash64("doc_id", "mark"), F.lit(1 << 31))
    few = known.select("doc_id", "lang", "mark").join(F.broadcast(bounds), "lang").where(place < F.col("bound")).select("doc_id", "lang", "mark").distinct()
    order = Window.partitionBy("lang").orderBy(place, "doc_id", "mark")
    chosen = few.withColumn("place", F.row_number().over(order)).where(F.col("place") <= per_language).drop("place")
    sample = known.join(F.broadcast(chosen), ["doc_id", "lang", "mark"]).dropDuplicates(["doc_id", "lang", "mark"])
    rows = sample.select("lang", "text").mapInArrow(_profiled, "lang string, profile array<float>").toArrow()
    languages = sorted(set(rows.column("lang").to_pylist()))
    if not languages:
        return ([], np.ones((0, 1)), np.zeros((FEATURES, 1)), np.zeros(1))
    x = rows.column("profile").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, FEATURES)
    code = codewords(len(languages))
    place = {name: i for i, name in enumerate(languages)}
    bits = code[[place[name] for name in rows.column("lang").to_pylist()]].astype(np.float32)
    order = np.lexsort((*x[:, :8].T, bits @ np.arange(1, bits.shape[1] + 1)))
    weights, offsets = fitted(x[order], bits[order])
    return languages, code, weights.astype(np.float64), offsets.astype(np.float64)


def _identified(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, code, weights, offsets = shared.value
        for batch in batches:
            lettered = batch.column("lettered").to_numpy(zero_copy_only=False)
            margins = np.array(
                [
                    profile(data) @ weights + offsets if letter else np.zeros(code.shape[1])
                    for letter, data in zip(lettered, utf8(batch.column("text")))
                ]
            ).reshape(batch.num_rows, -1)
            if known and batch.num_rows:
                best, score = decoded(code, margins)
                names = [known[i] if letter else UNKNOWN for i, letter in zip(best, lettered)]
                score = np.where(lettered, score, 0.0)
            else:
                names, score = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows)
            columns = [
                *(batch.column(n) for n in ("doc_id", "held_out")),
                pa.array(names, pa.string()),
                pa.array(score, pa.float64()),
                pa.array(score < CERTAIN, pa.bool_()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "lang_pred", "score", "ambiguous"])

    return run


def languages(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, ambiguous.

    A text that is null or has no letter is `und` with score 0, as is every text where no language was
    learned. `ambiguous` flags scores below CERTAIN. A null doc_id is neither learned from nor held out.
    Repeated rows give repeated rows; other columns are ignored, whatever their names. No documents
    give no rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(fitted_model(docs, per_language))
    source = docs.select(
        "doc_id",
        (fold(F.col("doc_id"), FOLDS) == 1).alias("held_out"),
        F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("lettered"),
        "text",
    )
    return source.mapInArrow(_identified(model), "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(table(spark, sf_dir, "documents"))
