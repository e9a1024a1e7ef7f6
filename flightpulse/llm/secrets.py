"""Secret scan: candidate strings, and a random forest that removes false findings."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flightpulse.llm.shared import fold, stored, table

#: Words of the dictionary: the most frequent of the corpus, and their lengths.
DICTIONARY = 4096
WORD_LENGTHS = (3, 8)
#: Distinct words that a task counts before it passes them on.
COUNTED = 300_000
#: Labelled findings of either kind that the forest is fitted on, at most.
PER_LABEL = 2500
TREES, DEPTH, LEAST_ROWS = 40, 9, 3
#: Characters on either side of a candidate in which its neighbouring words are sought.
CONTEXT = 40
#: Rows that the average rate of neighbouring words counts as.
PRIOR_ROWS = 20.0
FOLDS = 3

CANDIDATE = re.compile(r"[A-Za-z0-9_+/=~.@-]{12,}")
_WORD = re.compile(rf"[a-z]{{{WORD_LENGTHS[0]},{WORD_LENGTHS[1]}}}")
_NEIGHBOUR = re.compile(r"[A-Za-z][A-Za-z_]*")

# The published form of a cloud access key, names that introduce a credential, and the
# forms of strings that are none.
_ACCESS_KEY = re.compile(r"(?:AKIA|ASIA)[A-Z0-9]{16}")
_ASSIGNMENT = re.compile(r"(?:password|passwd|pwd|secret|token|api_?key|access_?key)[\"']?\s*[=:]\s*[\"']?", re.IGNORECASE)
_GIVEN = re.compile(_ASSIGNMENT.pattern.removesuffix(r"[\"']?") + r"""(?:"((?:[^"\\\n]|\\.)+)"|'((?:[^'\\\n]|\\.)+)'|["']?(\S+))""", re.IGNORECASE)
_ADDRESS = re.compile(r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+")
_NUMBER = re.compile(r"[0-9.+-]+")
_PLACEHOLDER = re.compile(r"(?i)x{4,}|(?:example|changeme|placeholder|your[_-])|(.)\1{7,}")
_PATH = re.compile(r"(?:[A-Za-z0-9_~.-]*/){2,}[A-Za-z0-9_~.-]*")

FEATURES = (
    "length", "entropy", "digits", "upper", "lower", "marks", "transitions", "longest_run", "hex", "dictionary",
    "path", "address", "assigned", "before_rate", "after_rate",
)
_CLASS = np.full(128, 3, np.int8)
_CLASS[ord("0") : ord("9") + 1] = 0
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("a") : ord("z") + 1] = 2


def candidates(text: str) -> Iterator[tuple[int, str]]:
    """Begin and value of strings that could be a secret: whatever is given to a credential's name, of any length and
    characters, and unbroken long strings with a digit; a name that is assigned to is cut off."""
    given = set()
    for found in _GIVEN.finditer(text):
        kind = found.lastindex
        value = found.group(kind) if kind < 3 else found.group(kind).rstrip("\"',;.=-")
        if value:
            given.add(found.start(kind))
            yield found.start(kind), value
    for found in CANDIDATE.finditer(text):
        begin, value = found.start(), found.group()
        name = _ASSIGNMENT.match(value)
        if name:
            begin, value = begin + name.end(), value[name.end() :]
        kept = value.rstrip(".=-")
        if begin not in given and _long(kept):
            yield begin, kept


def _long(value: str) -> bool:
    return len(value) >= 12 and any(c.isdigit() for c in value) and CANDIDATE.fullmatch(value) is not None


def rule_label(value: str, before: str) -> int | None:
    """1 or 0 where the form alone tells, for learning; None for other candidates."""
    if _PLACEHOLDER.search(value) or _ADDRESS.fullmatch(value) or _NUMBER.fullmatch(value) or _PATH.fullmatch(value):
        return 0
    if _ACCESS_KEY.fullmatch(value):
        return 1
    assigned = list(_ASSIGNMENT.finditer(before))
    return 1 if _long(value) and assigned and assigned[-1].end() == len(before) else None


def covered(value: str, words: set[str]) -> float:
    """Share of a value's characters in dictionary words, longest words first."""
    low, at, inside = value.lower(), 0, 0
    while at < len(low):
        for length in range(WORD_LENGTHS[1], WORD_LENGTHS[0] - 1, -1):
            if low[at : at + length] in words:
                inside += length
                at += length
                break
        else:
            at += 1
    return inside / len(value)


def described(value: str, before: str, words: set[str]) -> list[float]:
    """The features of a candidate but for the rates of its neighbouring words."""
    kinds = _CLASS[np.minimum(np.array([ord(c) for c in value]), 127)]
    counts = np.array(list(Counter(value).values()), float) / len(value)
    changes = np.flatnonzero(np.diff(kinds)) + 1
    runs = np.diff(np.concatenate([[0], changes, [len(value)]]))
    shares = np.bincount(kinds, minlength=4) / len(value)
    assigned = bool(re.search(r"[=:]\s*[\"']?$", before))
    return [
        float(len(value)), float(-(counts * np.log2(counts)).sum()), *map(float, shares), len(changes) / len(value),
        float(runs.max()), float(re.fullmatch("[0-9a-fA-F]+", value) is not None), covered(value, words),
        float(value.count("/") + before.endswith(("/", "\\"))), float("@" in value), float(assigned),
    ]


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def given(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    counts: Counter = Counter()
    for batch in batches:
        for text in batch.column("text"):
            counts.update(_WORD.findall((text.as_py() or "").lower()))
            if len(counts) > COUNTED:
                yield given(counts)
                counts = Counter()
    yield given(counts)


def _found(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        for batch in batches:
            rows = []
            for doc_id, learned, text in zip(*(batch.column(n).to_pylist() for n in ("doc_id", "learned", "text"))):
                for begin, value in candidates(text or ""):
                    before = text[max(0, begin - CONTEXT) : begin]
                    after = text[begin + len(value) : begin + len(value) + CONTEXT]
                    names = _NEIGHBOUR.findall(before)
                    next_names = _NEIGHBOUR.findall(after)
                    rows.append(
                        (
                            doc_id, learned, begin, begin + len(value), value[: min(4, len(value) // 2)].ljust(len(value), "*"),
                            names[-1].lower() if names else "", next_names[0].lower() if next_names else "",
                            rule_label(value, before), described(value, before, words),
                        )
                    )
            columns = list(zip(*rows)) if rows else [()] * len(_FOUND)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _FOUND.values())], names=list(_FOUND))

    return run


_FOUND = {
    "doc_id": pa.int64(), "learned": pa.bool_(), "begin": pa.int64(), "end": pa.int64(), "masked": pa.string(),
    "before": pa.string(), "after": pa.string(), "label": pa.int32(), "features": pa.list_(pa.float64()),
}


def fitted_tree(x: np.ndarray, y: np.ndarray, draw: np.random.Generator) -> list[tuple[int, float, int, int, float]]:
    """Nodes (feature, threshold, left, right, share of label 1) of a tree; feature -1 marks a leaf."""
    nodes: list[tuple[int, float, int, int, float]] = []
    tries = max(1, int(np.sqrt(x.shape[1])) + 1)

    def grow(rows: np.ndarray, depth: int) -> int:
        at, share = len(nodes), float(y[rows].mean())
        nodes.append((-1, 0.0, 0, 0, share))
        best = (share * (1 - share) * len(rows) - 1e-9, -1, 0.0)
        if depth < DEPTH and len(rows) >= 2 * LEAST_ROWS and 0 < share < 1:
            for f in draw.choice(x.shape[1], tries, replace=False):
                order = rows[np.argsort(x[rows, f], kind="stable")]
                values, ones = x[order, f], np.cumsum(y[order])
                left = np.arange(1, len(rows))
                cuts = left[(values[1:] > values[:-1]) & (left >= LEAST_ROWS) & (len(rows) - left >= LEAST_ROWS)]
                if len(cuts):
                    a, b = ones[cuts - 1], ones[-1] - ones[cuts - 1]
                    impurity = a * (1 - a / cuts) + b * (1 - b / (len(rows) - cuts))
                    k = int(impurity.argmin())
                    if impurity[k] < best[0]:
                        best = (impurity[k], int(f), float(values[cuts[k] - 1]))
        if best[1] >= 0:
            goes = x[rows, best[1]] <= best[2]
            nodes[at] = (best[1], best[2], grow(rows[goes], depth + 1), grow(rows[~goes], depth + 1), share)
        return at

    grow(draw.integers(0, len(x), len(x)), 0)
    return nodes


def forest_scores(forest: list, x: np.ndarray) -> np.ndarray:
    """Mean share over the trees' leaves."""
    score = np.zeros(len(x))
    for nodes in forest:
        feature, threshold, left, right, share = (np.array(column) for column in zip(*nodes))
        at = np.zeros(len(x), np.int64)
        for _ in range(DEPTH):
            inner = feature[at] >= 0
            goes = x[np.arange(len(x)), np.maximum(feature[at], 0)] <= threshold[at]
            at = np.where(inner, np.where(goes, left[at], right[at]), at)
        score += share[at]
    return score / max(1, len(forest))


def _rates(words: list[str], y: np.ndarray) -> dict[str, float]:
    """Share of secrets among the learned findings beside each word, drawn towards the average; '' has the average."""
    average = float(y.mean())
    total, ones = Counter(words), Counter(w for w, k in zip(words, y) if k)
    rates = {w: (ones[w] + PRIOR_ROWS * average) / (n + PRIOR_ROWS) for w, n in total.items() if n >= LEAST_ROWS}
    return {**rates, "": average}


def _with_rates(rows: list[list[float]], before: list[str], after: list[str], rates: tuple[dict, dict]) -> np.ndarray:
    extra = [[rates[0].get(b, rates[0][""]), rates[1].get(a, rates[1][""])] for b, a in zip(before, after)]
    return np.column_stack([np.array(rows, float).reshape(len(rows), -1), np.array(extra, float).reshape(len(rows), 2)])


def _scored(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, rates = shared.value
        for batch in batches:
            if forest and batch.num_rows:
                x = _with_rates(*(batch.column(n).to_pylist() for n in ("features", "before", "after")), rates)
                score = forest_scores(forest, x)
            else:  # without labels of both kinds, the rule's label or an even chance
                score = np.array([0.5 if k is None else float(k) for k in batch.column("label").to_pylist()], float)
            names = ["doc_id", "begin", "end", "masked", "label"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), pa.array(score), pa.array(score >= 0.5)], names=[*names, "score", "is_secret"]
            )

    return run


def secret_findings(docs: DataFrame, labels: DataFrame | None = None, per_label: int = PER_LABEL, trees: int = TREES) -> DataFrame:
    """One row per candidate: doc_id, begin, end, masked, label, score, is_secret.

    Candidates are all values given to a credential's name, and unbroken strings of 12 or more characters with a
    digit. Of the former, the form alone tells only for unbroken long ones with a digit. The forest judges them by length,
    mix of and changes between kinds of characters, the share that dictionary words cover, paths,
    assignment, and the words beside them. It is fitted on a bounded sample of labelled findings: `labels`
    (doc_id, begin, label), or else the candidates whose form alone tells (a published key form or an
    assigned credential; a number, an address, a path, a placeholder). Documents whose crc32 of doc_id
    modulo 3 is 1, or whose doc_id is null, are not learned from. The dictionary is counted over all documents.

    `begin` and `end` count characters; `masked` shows four, and of short values less than half or half. Null and empty texts have no candidates. Repeated
    rows give repeated findings; other columns are ignored, whatever their names. No documents give
    no rows.
    """
    context = docs.sparkSession.sparkContext
    counted = docs.select("text").mapInArrow(_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    dictionary = {row["word"] for row in counted.orderBy(F.desc("n"), "word").limit(DICTIONARY).collect()}
    source = docs.select("doc_id", fold(F.col("doc_id"), FOLDS).isin(0, 2).alias("learned"), "text")
    found = stored(
        source.mapInArrow(
            _found(context.broadcast(dictionary)),
            "doc_id long, learned boolean, begin long, end long, masked string, before string, after string, label int, features array<double>",
        )
    )
    if labels is not None:
        given = labels.groupBy("doc_id", "begin").agg(F.max("label").cast("int").alias("given"))
        found = stored(found.drop("label").join(given, ["doc_id", "begin"], "left").withColumnRenamed("given", "label"))
    known = found.where("learned and label in (0, 1)").select("doc_id", "begin", "before", "after", "features", "label")
    rows = [
        row
        for k in (0, 1)
        for row in known.where(F.col("label") == k).orderBy(F.xxhash64("doc_id", "begin"), "doc_id", "begin").limit(per_label).collect()
    ]
    y = np.array([row["label"] for row in rows], float)
    forest: list = []
    rates: tuple[dict, dict] = ({"": 0.5}, {"": 0.5})
    if len(set(y)) == 2:
        before, after = [row["before"] for row in rows], [row["after"] for row in rows]
        rates = (_rates(before, y), _rates(after, y))
        x = _with_rates([row["features"] for row in rows], before, after, rates)
        draw = np.random.default_rng(3)
        forest = [fitted_tree(x, y, draw) for _ in range(trees)]
    return found.select("doc_id", "begin", "end", "masked", "label", "before", "after", "features").mapInArrow(
        _scored(context.broadcast((forest, rates))),
        "doc_id long, begin long, end long, masked string, label int, score double, is_secret boolean",
    )


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_findings(table(spark, sf_dir, "documents"))
