"""What the operators of this subpackage have in common."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, and what separates words: ASCII white space only.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
#: Columns of the documents table, in order.
DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def fold(doc_id: Column, parts: int) -> Column:
    """The part of a document for held-out rows: crc32 of its id as text, modulo `parts`; a null id is in part -1."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % parts, F.lit(-1)).cast("int")


def shared_folder(spark: SparkSession) -> str:
    """The session's folder for intermediate tables, which all machines see.

    It is spark.checkpoint.dir. Where that is unset, a local session gets a folder of its own; a
    cluster must name one.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """`df` kept in the shared folder, which ends its lineage; Spark removes it when nothing refers to it."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """`df` as a Parquet table in the shared folder, read from there; it goes when that folder is cleared."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def utf8(column: pa.Array) -> Iterator[np.ndarray]:
    """The UTF-8 bytes of each text; none for null."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if not len(column):
        return
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    present = column.is_valid().to_numpy(zero_copy_only=False)
    for i in range(len(column)):
        yield whole[at[i] : at[i + 1]] if present[i] else whole[:0]


def _marked(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", F.xxhash64("text").alias("mark"))


def sampled_rows(docs: DataFrame, labels: DataFrame, column: str, learn: Column, per_class: int) -> tuple[DataFrame, dict[int, float]]:
    """doc_id, mark (a hash of the text), label of at most `per_class` labelled documents of either class, stored, and each class's weight.

    The rows with the smallest hash of doc_id are taken of those whose doc_id passes `learn` and whose label is
    0 or 1; a doc_id with both labels counts as 1. Rows that share a doc_id count by their texts, equal ones once,
    so the bound holds however often an id repeats. A class's weight is the number of labels that each of
    its sampled rows stands for. The sample's ids are the only thing that is broadcast.
    """
    known = labels.select("doc_id", F.col(column).cast("int").alias("label")).where(learn & F.col("label").isin(0, 1))
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    counts = {row["label"]: row["n"] for row in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    chosen = [known.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for k in (0, 1)]
    found = stored(_marked(docs).select("doc_id", "mark").join(F.broadcast(chosen[0].unionAll(chosen[1])), "doc_id").distinct())
    kept = [found.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id", "mark").limit(per_class) for k in (0, 1)]
    return stored(kept[0].unionAll(kept[1])), {k: max(1.0, n / per_class) for k, n in counts.items()}


def sampled_texts(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """doc_id, text, label of sampled rows."""
    return _marked(docs).join(F.broadcast(rows), ["doc_id", "mark"]).dropDuplicates(["doc_id", "mark"]).select("doc_id", "text", "label")


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, learn: Column, per_class: int) -> tuple[DataFrame, dict[int, float]]:
    """doc_id, text, label of the documents that `sampled_rows` chooses, and each class's weight."""
    rows, weight = sampled_rows(docs, labels, column, learn, per_class)
    return sampled_texts(docs, rows), weight


def fitted_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, decay: float = 1e-6, steps: int = 50) -> np.ndarray:
    """Coefficients, the intercept last, of a logistic regression by Newton's method."""
    design = np.column_stack([x, np.ones(len(x))])
    beta = np.zeros(design.shape[1])
    penalty = decay * len(x) * np.eye(len(beta))
    penalty[-1, -1] = 1e-6
    for _ in range(steps):
        p = logistic(design @ beta)
        slope = design.T @ (weight * (y - p)) - penalty @ beta
        curve = (design * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ design + penalty
        step = np.linalg.solve(curve, slope)
        beta += step * min(1.0, 4.0 / np.abs(step).max()) if step.any() else 0
        if np.abs(step).max() < 1e-8:
            break
    return beta


def logistic(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40.0, 40.0)))
