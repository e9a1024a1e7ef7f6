"""Toxicity by class-conditional Kneser-Ney models: of the letters inside words, and of byte classes."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flightpulse.llm.shared import fitted_logistic, fold, logistic, sampled_rows, sampled_texts, table, utf8

#: Symbols of the model of byte classes, and of its n-grams. The model of words has neither alphabet nor table size.
SYMBOLS = 32
ORDER = 4
DISCOUNT = 0.75
#: Lengths of the passages that are compared, in symbols, beside the whole text.
PASSAGES = (8, 16, 32, 128)
#: Labelled rows of either class that the models are fitted on, at most; a quarter of them calibrates.
PER_CLASS = 20_000
FOLDS = 5
#: Bytes of a text that are scored at once.
STRETCH = 1 << 20
#: Characters of an n-gram inside a word, blanks before and after it included. Of 6, 8 and 10, and of penalties from 1e-4 to 1e-2,
#: 10 and 1e-4 had the least log-loss on fold 1 of sf0.1 after learning from folds 2 to 4; fold 0 was not read.
LETTERS = 10
#: A word of at least so many characters, as any text without blanks, counts by overlapping spans of so many, each half of it on.
SPAN = 16
#: Numbers of a text's most toxic words, and what a word's score must pass to count towards the text's rate.
WORST = (1, 2, 4, 8)
MARGINS = (0.0, 1.0, 2.0, 4.0)
#: Characters of texts whose distinct words are counted or scored together; of a text that are split into words, or of
#: a word that are counted or scored, at once. N-grams that a task counts before it passes them on, and whose ratios it
#: works out at once, those of one ENDING always together.
TOGETHER = 1 << 21
PIECE = 1 << 17
KEPT = 1 << 20
#: Places of the characters before an n-gram's last one by which n-grams are dealt: those of the shortest history.
ENDING = slice(LETTERS - 4, LETTERS - 1)
#: Columns of n-grams on their way: all that end alike as one text of LETTERS characters each, with their counts.
GRAMS = "ending string, grams string, ordinary array<int>, toxic array<int>"
#: Features of a text by both models, and the penalty on their coefficients.
FEATURES = 1 + len(PASSAGES) + 1 + len(MARGINS) + len(WORST)
DECAY = 1e-4


def _alphabet() -> np.ndarray:
    """Symbol of each byte: white space, 26 letters of either case, other ASCII, first and later bytes of other characters."""
    byte = np.arange(256)
    symbol = np.where(byte < 128, 27, np.where(byte >= 0xC0, 28, 29 + byte % 3))
    for first in (ord("a"), ord("A")):
        symbol[first : first + 26] = np.arange(1, 27)
    symbol[[0x20, 9, 10, 11, 12, 13]] = 0
    return symbol.astype(np.int32)


_SYMBOL = _alphabet()


def ngrams(data: np.ndarray) -> Iterator[np.ndarray]:
    """Numbers of all n-grams of a text, in stretches; the text stands between blanks."""
    padded = ORDER - 1
    for begin in range(0, max(1, len(data)), STRETCH):
        symbols = _SYMBOL[data[max(0, begin - padded) : begin + STRETCH]]
        if begin == 0:
            symbols = np.concatenate([np.zeros(padded, np.int32), symbols])
        if begin + STRETCH >= len(data):
            symbols = np.append(symbols, np.int32(0))
        count = len(symbols) - padded
        number = symbols[:count].copy()
        for j in range(1, ORDER):
            number = number * SYMBOLS + symbols[j : j + count]
        yield number


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of n-grams in a task: unlabelled, ordinary and toxic rows, each added up a few million n-grams at a time."""
    counts = np.zeros((3, SYMBOLS**ORDER), np.int64)
    waiting: list[list[np.ndarray]] = [[], [], []]

    def add(k: int) -> None:
        if waiting[k]:
            counts[k] += np.bincount(np.concatenate(waiting[k]), minlength=SYMBOLS**ORDER)
            waiting[k].clear()

    held = [0, 0, 0]
    for batch in batches:
        for label, data in zip(batch.column("label").to_pylist(), utf8(batch.column("text"))):
            k = 0 if label is None else 1 + label
            for numbers in ngrams(data):
                waiting[k].append(numbers)
                held[k] += len(numbers)
                if held[k] > TOGETHER:
                    add(k)
                    held[k] = 0
    for k in range(3):
        add(k)
    counts[0] += counts[1] + counts[2]
    seen = np.flatnonzero(counts[0])
    yield pa.RecordBatch.from_arrays(
        [pa.array(seen, pa.int64()), *(pa.array(c[seen], pa.int64()) for c in counts)], names=["ngram", "every", "ordinary", "toxic"]
    )


def log_ratios(every: np.ndarray, ordinary: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Log of toxic by ordinary probability of each n-gram's last symbol after the ones before it.

    Each class has its own discounted counts of whole n-grams. What the discount frees is spread by one
    lower order that both share: the number of different left neighbours of each shorter n-gram in the
    corpus, discounted and backed off in turn down to an even spread.
    """
    lower = np.full(SYMBOLS, 1.0 / SYMBOLS)
    continuations = {ORDER - 1: (every.reshape((SYMBOLS,) * ORDER) > 0).sum(0)}
    for order in range(ORDER - 2, 0, -1):
        continuations[order] = (continuations[order + 1] > 0).sum(0)

    def interpolated(counts: np.ndarray, lower: np.ndarray) -> np.ndarray:
        counts = counts.astype(np.float64)
        total, kinds = counts.sum(-1, keepdims=True), (counts > 0).sum(-1, keepdims=True)
        own = (np.maximum(counts - DISCOUNT, 0) + DISCOUNT * kinds * lower) / np.maximum(total, 1)
        return np.where(total > 0, own, np.broadcast_to(lower, counts.shape))

    for order in range(1, ORDER):
        lower = interpolated(continuations[order], lower)
    shape = (SYMBOLS,) * ORDER
    ratio = np.log(interpolated(toxic.reshape(shape), lower)) - np.log(interpolated(ordinary.reshape(shape), lower))
    return ratio.ravel().astype(np.float32)


def features(data: np.ndarray, ratios: np.ndarray) -> list[float]:
    """Log-likelihood ratio by symbol of the whole text, and of its most toxic passage of each length."""
    total, length, tail = 0.0, 0, np.empty(0)
    best = [-np.inf] * len(PASSAGES)
    for numbers in ngrams(data):
        scores = ratios[numbers].astype(np.float64)
        total += scores.sum()
        length += len(scores)
        sums = np.concatenate([[0.0], np.cumsum(np.concatenate([tail, scores]))])
        for k, width in enumerate(PASSAGES):
            span = min(width, len(sums) - 1)
            best[k] = max(best[k], (sums[span:] - sums[: len(sums) - span]).max() / width)
        tail = np.concatenate([tail, scores])[-(max(PASSAGES) - 1) :]
    return [total / length, *best]


_BLANK = re.compile(r"\s")


def pieces_of(text: str) -> Iterator[str]:
    """A text in lower case, about PIECE characters at a time, cut at blanks only; a run without blanks is one word, however long."""
    begin = 0
    while begin < len(text):
        blank = _BLANK.search(text, begin + PIECE) if begin + PIECE < len(text) else None
        end = blank.start() if blank else len(text)
        yield text[begin:end].lower()
        begin = end


def _windows(text: str) -> np.ndarray:
    """A row of code points for each LETTERS characters of a text."""
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    codes = np.where(codes == 0, np.uint32(0xFFFD), codes)
    return np.lib.stride_tricks.sliding_window_view(codes, LETTERS) if len(codes) >= LETTERS else np.empty((0, LETTERS), np.uint32)


def _inside(words: list[str]) -> tuple[str, np.ndarray]:
    """The words with LETTERS - 1 blanks before each and one after, and where the n-grams of their characters begin in that."""
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    begins = np.cumsum(lengths) - lengths + np.arange(len(words)) * (LETTERS - 1)
    at = np.arange(lengths.sum()) + np.repeat(begins - (np.cumsum(lengths) - lengths), lengths)
    pad = " " * (LETTERS - 1)
    return pad + (" " + pad).join(words) + " ", at


def letters(words: list[str]) -> np.ndarray:
    """A row of LETTERS code points for each character of each word and the blank after it; blanks stand before a word."""
    text, at = _inside(words)
    return _windows(text)[at]


def letters_of_long(word: str) -> Iterator[np.ndarray]:
    """The same rows of one word, PIECE characters at a time."""
    for begin in range(0, len(word) + 1, PIECE):
        before = word[max(0, begin - LETTERS + 1) : begin].rjust(LETTERS - 1)
        part = word[begin : begin + PIECE]
        yield _windows(before + part + (" " if begin + PIECE > len(word) else ""))


_FACTORS = np.random.default_rng(11).integers(1, 1 << 63, LETTERS + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def hashed(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit numbers of n-grams, and of what stands before their last characters."""
    history = np.full(len(rows), _FACTORS[-1])
    for j in range(LETTERS - 1):
        history += rows[:, j].astype(np.uint64) * _FACTORS[j]
    return history - _FACTORS[-1] + rows[:, -1].astype(np.uint64) * _FACTORS[LETTERS - 1], history


def _numbers(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """What `hashed` gives for `letters` of the words."""
    text, at = _inside(words)
    number, before = hashed(_windows(text))
    return number[at], before[at]


class DistinctWords:
    """Words of consecutive pieces of text: the distinct ones, which of them each word is, and the piece that each word is in."""

    def __init__(self, pieces: list[str]) -> None:
        split = pc.utf8_split_whitespace(pa.array(pieces, pa.large_string()))
        encoded = split.flatten().dictionary_encode()
        self.words: list[str] = encoded.dictionary.to_pylist()
        self.which = encoded.indices.to_numpy()
        self.piece = np.repeat(np.arange(len(pieces)), split.value_lengths().to_numpy())
        if "" in self.words:  # before a leading blank, or after the last one
            none = self.words.index("")
            given = self.which != none
            self.which, self.piece = self.which[given], self.piece[given]
            self.which = self.which - (self.which > none)
            del self.words[none]
        self.lengths = np.fromiter(map(len, self.words), np.int64, len(self.words))


def together(texts: Iterator[str]) -> Iterator[tuple[list[int], DistinctWords]]:
    """All words of texts, those of some TOGETHER characters at a time, and the place of the text that each piece is from."""
    owners: list[int] = []
    pieces: list[str] = []
    characters = 0
    for owner, text in enumerate(texts):
        for piece in pieces_of(text):
            owners.append(owner)
            pieces.append(piece)
            characters += len(piece)
            if characters > TOGETHER:
                yield owners, DistinctWords(pieces)
                owners, pieces, characters = [], [], 0
    if pieces:
        yield owners, DistinctWords(pieces)


def in_parts(words: list[str], lengths: np.ndarray) -> Iterator[list[str]]:
    """The words in turn, those of about TOGETHER / 8 characters, blanks before them included, at a time."""
    part = (np.cumsum(lengths + LETTERS) - 1) // (TOGETHER // 8)
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(words)]
    for begin, end in zip(cuts, cuts[1:]):
        if begin < end:
            yield words[begin:end]


class _Grams:
    """N-grams with their counts in ordinary and in toxic rows, equal ones added up."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, rows: np.ndarray, ordinary: np.ndarray, toxic: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Takes n-grams in; gives all out if even the distinct ones are many."""
        self.parts.append((rows, ordinary, toxic))
        self.held += len(rows)
        if self.held > KEPT:
            self.merge()
            if self.held > KEPT // 2:
                yield from self.given()

    def merge(self) -> None:
        rows, ordinary, toxic = (np.concatenate(part) for part in zip(*self.parts))
        _, first, inverse = np.unique(hashed(rows)[0], return_index=True, return_inverse=True)
        self.parts = [(rows[first], np.bincount(inverse, ordinary), np.bincount(inverse, toxic))]
        self.held = len(first)

    def given(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            self.merge()
            (rows, ordinary, toxic), self.parts, self.held = self.parts[0], [], 0
            ending, left, rest = (
                (rows[:, a].astype(np.uint64) << np.uint64(42)) | (rows[:, b].astype(np.uint64) << np.uint64(21)) | rows[:, c]
                for a, b, c in ((LETTERS - 2, LETTERS - 3, LETTERS - 4), (LETTERS - 5, LETTERS - 6, LETTERS - 7), (2, 1, LETTERS - 1))
            )
            order = np.lexsort((rest, left, ending))
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(ending[order])) + 1, [len(order)]])
            text = rows[order].tobytes().decode("utf-32-le")
            grams = [text[LETTERS * a : LETTERS * b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
            counts = (pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(n[order].astype(np.int32))) for n in (ordinary, toxic))
            columns = [pa.array([g[ENDING] for g in grams], pa.string()), pa.array(grams, pa.string()), *counts]
            yield pa.RecordBatch.from_arrays(columns, names=["ending", "grams", "ordinary", "toxic"])


def _lettered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All n-grams inside words in a task, with their counts in ordinary and in toxic labelled rows."""
    grams = _Grams()
    for batch in batches:
        labels = np.array([-1 if label is None else label for label in batch.column("label").to_pylist()])
        for owners, found in together(text.as_py() or "" for text in batch.column("text")):
            label = labels[owners][found.piece]
            counts = [np.bincount(found.which, label == k, len(found.words)) for k in (0, 1)]
            usual = np.flatnonzero(found.lengths <= PIECE)
            done = 0
            for words in in_parts([found.words[i] for i in usual], found.lengths[usual]):
                these = usual[done : done + len(words)]
                done += len(words)
                yield from grams.add(letters(words), *(np.repeat(n[these], found.lengths[these] + 1) for n in counts))
            for i in np.flatnonzero(found.lengths > PIECE):
                for rows in letters_of_long(found.words[i]):
                    yield from grams.add(rows, *(np.full(len(rows), n[i]) for n in counts))
    yield from grams.given()


def letter_ratios(grams: str, ordinary: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted numbers and the ratio of each n-gram that a class has, and of each history of one, from all n-grams of whole
    groups of one ENDING, as one text, and their counts; equal n-grams are added up.

    Each class has its discounted counts. What the discount frees is spread by the numbers of different left
    neighbours that shorter n-grams have in the corpus, which both classes share, down to an even spread
    over the characters that follow. After a history that both have, a character that neither has seen
    there has the ratio of what the discounts freed; it is kept under the history's number.
    """
    rows = np.frombuffer(grams.encode("utf-32-le"), np.uint32).reshape(-1, LETTERS)
    number, before = hashed(rows)
    number, at, inverse = np.unique(number, return_index=True, return_inverse=True)
    rows, before = rows[at], before[at]
    counts = [np.bincount(inverse, n, len(number)) for n in (toxic, ordinary)]

    # From the whole n-grams down to four characters: the distinct shorter ones, and how many distinct longer ones each ends.
    levels, at, suffix, history = [], np.arange(len(number)), number, before
    for size in range(LETTERS - 1, 3, -1):
        gone = rows[at, LETTERS - 1 - size].astype(np.uint64) * _FACTORS[LETTERS - 1 - size]
        suffix, first, shorter = np.unique(suffix - gone, return_index=True, return_inverse=True)
        history, at = (history - gone)[first], at[first]
        levels.append((shorter, np.bincount(shorter), history))
    lower = None
    for shorter, n, history in reversed(levels):
        group = np.unique(history, return_inverse=True)[1]
        total, kinds = np.bincount(group, n)[group], np.bincount(group)[group]
        lower = ((np.maximum(n - DISCOUNT, 0) + DISCOUNT * kinds * (1.0 / kinds if lower is None else lower)) / total)[shorter]

    _, first, group = np.unique(before, return_index=True, return_inverse=True)
    logs, freed = [], []
    for n in counts:
        total, kinds = np.bincount(group, n)[group], np.bincount(group, n > 0)[group]
        back = np.where(total > 0, DISCOUNT * kinds / np.maximum(total, 1), 1.0)
        logs.append(np.log(np.maximum(n - DISCOUNT, 0) / np.maximum(total, 1) + back * lower))
        freed.append(np.log(back[first]))
    seen = counts[0] + counts[1] > 0
    begun = freed[0] != freed[1]
    numbers = np.concatenate([number[seen], before[first][begun]])
    ratios = np.concatenate([(logs[0] - logs[1])[seen], (freed[0] - freed[1])[begun]]).astype(np.float32)
    numbers, first = np.unique(numbers, return_index=True)
    return numbers, ratios[first]


def _letter_ratios(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ratios of n-grams that come in the order of their endings, those of a few endings at a time."""
    waiting: list[tuple[str, np.ndarray, np.ndarray]] = []
    held, last = 0, None

    def worked_out() -> pa.RecordBatch:
        grams, ordinary, toxic = zip(*waiting)
        numbers, ratios = letter_ratios("".join(grams), np.concatenate(ordinary), np.concatenate(toxic))
        return pa.RecordBatch.from_arrays([pa.array(numbers.view(np.int64)), pa.array(ratios)], names=["number", "ratio"])

    for batch in batches:
        for i in range(batch.num_rows):
            ending, grams, ordinary, toxic = (column[i] for column in batch.columns)
            if held > KEPT and ending.as_py() != last:
                yield worked_out()
                waiting, held = [], 0
            last = ending.as_py()
            waiting.append((grams.as_py(), ordinary.values.to_numpy(), toxic.values.to_numpy()))
            held += len(ordinary)
    if waiting:
        yield worked_out()


class WordScores:
    """Scores of words by the ratios of their n-grams, whose numbers are sorted."""

    def __init__(self, numbers: np.ndarray, ratios: np.ndarray) -> None:
        self.numbers, self.ratios = numbers, ratios
        # Numbers are hashes, spread evenly: their leading bits lead to where they begin in the sorted table.
        bits = max(1, len(numbers).bit_length() - 1)
        self.shift = np.uint64(64 - bits)
        self.begins = np.searchsorted(numbers >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)
        self.most = int(np.diff(self.begins).max())

    def _of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each number is in the table, and its ratio, or zero."""
        lead = (numbers >> self.shift).astype(np.int64)
        at, end = self.begins[lead], self.begins[lead + 1]
        found, ratio = np.zeros(len(numbers), bool), np.zeros(len(numbers), np.float32)
        left = np.flatnonzero(at < end)
        for _ in range(self.most):
            here = at[left]
            same = self.numbers[here] == numbers[left]
            hit = left[same]
            found[hit], ratio[hit] = True, self.ratios[here[same]]
            left = left[~same & (here + 1 < end[left])]
            if not len(left):
                break
            at[left] += 1
        return found, ratio

    def _summed(self, number: np.ndarray, before: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Sums of the characters' ratios from each of `begins` to the next."""
        if not len(self.numbers) or not len(begins):
            return np.zeros(len(begins))
        found, ratio = self._of(number)
        new = np.flatnonzero(~found)
        ratio[new] = self._of(before[new])[1]
        return np.add.reduceat(ratio.astype(np.float64), begins)

    def scored(self, words: list[str]) -> np.ndarray:
        """The sum of the ratios of each word's characters and the blank after it."""
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
        return self._summed(*_numbers(words), np.cumsum(lengths) - lengths)

    def spans(self, word: str) -> tuple[np.ndarray, float]:
        """Sums over overlapping spans of a long word, which cover every character, and the sum over all characters once."""
        half = SPAN // 2
        parts = [letters([word])] if len(word) <= PIECE else letters_of_long(word)
        sums = np.concatenate([self._summed(*hashed(rows), np.arange(0, len(rows), half)) for rows in parts])
        return sums[:-1] + sums[1:], sums.sum()

    def distinct_scores(self, found: DistinctWords) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The scores that the distinct words count by, one after another, how many each has, and the sum of each word's ratios."""
        entries, whole = np.ones(len(found.words), np.int64), np.zeros(len(found.words))
        short = np.flatnonzero(found.lengths < SPAN)
        parts = in_parts([found.words[i] for i in short], found.lengths[short])
        whole[short] = np.concatenate([np.empty(0), *map(self.scored, parts)])
        spans = {}
        for i in np.flatnonzero(found.lengths >= SPAN).tolist():
            spans[i], whole[i] = self.spans(found.words[i])
            entries[i] = len(spans[i])
        scores = np.repeat(whole, entries)
        begins = np.cumsum(entries) - entries
        for i, sums in spans.items():
            scores[begins[i] : begins[i] + len(sums)] = sums
        return scores, entries, whole

    def features(self, texts: Iterator[str]) -> list[list[float]]:
        """Of each text's words: the ratio by symbol, what passes each margin by word, and the means of the worst few."""
        gathered: list[np.ndarray] = []
        worst: list[np.ndarray] = []

        def numbered(texts: Iterator[str]) -> Iterator[str]:
            for text in texts:
                gathered.append(np.zeros(3 + len(MARGINS)))
                worst.append(np.empty(0))
                yield text

        for owners, found in together(numbered(texts)):
            scores, entries, whole = self.distinct_scores(found)
            n, which, piece = len(owners), found.which, found.piece
            sums = [np.bincount(piece, whole[which], n), np.bincount(piece, found.lengths[which] + 1, n)]
            many = entries[which]
            ends = np.cumsum(many)
            begins = np.cumsum(entries) - entries
            score = scores[np.repeat(begins[which] - (ends - many), many) + np.arange(ends[-1] if len(ends) else 0)]
            piece = np.repeat(piece, many)
            count = np.bincount(piece, minlength=n)
            sums += [count, *(np.bincount(piece, np.maximum(score - m, 0), n) for m in MARGINS)]
            cuts = np.concatenate([[0], np.cumsum(count)])
            for k, (owner, row) in enumerate(zip(owners, np.array(sums, float).T)):
                few = score[cuts[k] : cuts[k + 1]]
                few = few if len(few) <= max(WORST) else np.partition(few, len(few) - max(WORST))[-max(WORST) :]
                gathered[owner] += row
                worst[owner] = -np.sort(-np.concatenate([worst[owner], few]))[: max(WORST)]
        return [
            [total / max(1, symbols), *(np.array(above) / max(1, count)), *(few[:k].sum() / k for k in WORST)]
            for (total, symbols, count, *above), few in zip(gathered, worst)
        ]


def text_features(batch: pa.RecordBatch, ratios: np.ndarray, scores: WordScores) -> list[list[float]]:
    """Features of each text by both models."""
    texts = batch.column("text")
    inside = scores.features(text.as_py() or "" for text in texts)
    return [features(data, ratios) + words for data, words in zip(utf8(texts), inside)]


def _featured(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratios, table = model.value
        scores = WordScores(*table)
        for batch in batches:
            found = text_features(batch, ratios, scores)
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(found, pa.list_(pa.float64()))], names=["label", "features"])

    return run


def _scored(model, beta: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratios, table = model.value
        scores = WordScores(*table)
        for batch in batches:
            found = np.array(text_features(batch, ratios, scores)).reshape(-1, FEATURES)
            score = logistic(found @ beta[:-1] + beta[-1])
            columns = [*(batch.column(n) for n in ("doc_id", "held_out")), pa.array(score), pa.array((score >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "score", "predicted"])

    return run


def fitted_model(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> tuple[Broadcast, np.ndarray]:
    """Log ratios of byte classes and the table of ratios inside words, broadcast once, and the coefficients that turn a
    text's features into a score.

    Shared counts come from all documents outside the held-out fold, labelled or not; class counts from
    three quarters of the bounded sample; the calibration from the remaining quarter. N-grams inside words
    are counted, and their ratios worked out, in tables keyed by the n-gram itself. What reaches the
    driver are at most SYMBOLS ** ORDER sums of byte classes, 12 bytes for each n-gram inside words that a
    class has, and the features of the calibration rows. Without rows of both classes all scores are 0.
    """
    context = docs.sparkSession.sparkContext
    learn = fold(F.col("doc_id"), FOLDS) > 0
    kept, weight = sampled_rows(docs, labels, "toxic", learn, per_class)
    none = (np.empty(0, np.uint64), np.empty(0, np.float32))
    if len(weight) < 2:
        return context.broadcast((np.zeros(SYMBOLS**ORDER, np.float32), none)), np.array([0.0] * FEATURES + [-40.0])
    calibrates = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(4)) == 0
    ids = kept.where(~calibrates).select("doc_id", "label")
    told = docs.select("doc_id", "text").where(learn).join(F.broadcast(ids.dropDuplicates(["doc_id"])), "doc_id", "left").select("label", "text")
    counted = (
        told.mapInArrow(_counted, "ngram long, every long, ordinary long, toxic long")
        .groupBy("ngram")
        .agg(*(F.sum(c).alias(c) for c in ("every", "ordinary", "toxic")))
        .toPandas()
    )
    dense = np.zeros((3, SYMBOLS**ORDER), np.int64)
    for k, name in enumerate(("every", "ordinary", "toxic")):
        dense[k, counted["ngram"].to_numpy()] = counted[name].to_numpy()
    ratios = log_ratios(*dense)
    found = (
        told.mapInArrow(_lettered, GRAMS)
        .repartition("ending")
        .sortWithinPartitions("ending")
        .mapInArrow(_letter_ratios, "number long, ratio float")
        .toArrow()
    )
    numbers = found.column("number").to_numpy().view(np.uint64)
    order = np.argsort(numbers)
    inside = (numbers[order], found.column("ratio").to_numpy()[order])
    shared = context.broadcast((ratios, inside))
    rows = sampled_texts(docs, kept.where(calibrates)).select("label", "text").mapInArrow(_featured(shared), "label int, features array<double>").collect()
    y = np.array([row["label"] for row in rows], float)
    if len(set(y)) < 2:
        return shared, np.array([1.0] + [0.0] * FEATURES)
    x = np.array([row["features"] for row in rows])
    weights = np.array([weight[int(k)] for k in y])
    return shared, fitted_logistic(x, y, weights / weights.mean(), DECAY)


def toxicity(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    `score` rises with the ratio of toxic to ordinary likelihood, by symbol of the whole text and of its
    most toxic passages, and by the letters of its words, on average and in the most toxic ones, so a few
    words in a long text still show, and in any script. Words of SPAN characters or more, and scripts without
    blanks, are scored in overlapping spans that cover them; very long texts and words are scored piece by piece. Labels are learned only from rows
    whose crc32 of doc_id modulo 5 is not 0; a null doc_id is never learned from nor held out. A null
    or blank text has the score of a single blank. Repeated rows give repeated rows; other columns are
    ignored, whatever their names. No documents give no rows.
    """
    model, beta = fitted_model(docs, labels, per_class)
    source = docs.select("doc_id", (fold(F.col("doc_id"), FOLDS) == 0).alias("held_out"), "text")
    return source.mapInArrow(_scored(model, beta), "doc_id long, held_out boolean, score double, predicted int")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
