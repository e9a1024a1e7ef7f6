"""Alignment of the tokens that two tokenizers give the same texts."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flightpulse.llm.shared import stored, table, written
from flightpulse.llm.token_counts import PRE_TOKEN

BYTE_VOCABULARY = "byte_bpe_50k.json"
PIECE_VOCABULARY = "piece_bpe_32k.model"
#: Chunks whose alignment a task remembers; when full, the memory starts anew. It bounds memory only.
REMEMBERED = 400_000
#: A task's memory holds chunks of this many characters in all, so that few long ones do not fill it.
REMEMBERED_CHARACTERS = 1 << 23
#: Characters of texts that are cut into chunks, and distinct chunks that are aligned, at a time.
STRETCH = 1 << 20
TOGETHER = 10_000
#: Pairs of ids that are sent to all tasks, at most.
FREQUENT = 1 << 20

Encoder = Callable[[list[str]], list[list[int]]]

# A blank after a character that no edition of Unicode holds for white space; not one that ends the text, as
# a piece model puts no blank before nothing.
_CUT = re.compile(r" (?<=[!-~\w] )(?=.)", re.DOTALL)
_BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")


def byte_alphabet() -> dict[str, int]:
    """The byte of each character that byte-level vocabularies write bytes as.

    Printable characters of Latin-1 stand for themselves; all other bytes, in order, are U+0100 and on.
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(others)}


def byte_level_encoder(path: str) -> tuple[Encoder, dict[int, bytes]]:
    """The ids of a blank and a text, whose special strings are plain text, for many texts; the bytes of each id.

    Where the file's merges come in the order of their results' ids, a faster library works on the same
    vocabulary. It may know another edition of Unicode, so texts with characters that an early edition
    lacks go to the file's own library.
    """
    import tiktoken
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    tokenizer.encode_special_tokens = True
    byte = byte_alphabet()
    vocabulary = tokenizer.get_vocab(with_added_tokens=False)
    special = {token.content for token in tokenizer.get_added_tokens_decoder().values()}
    spelt = {i: bytes(byte[c] for c in piece) if all(c in byte for c in piece) else piece.encode() for piece, i in tokenizer.get_vocab().items()}
    merges = json.loads(tokenizer.to_str())["model"]["merges"]
    made = [vocabulary["".join(pair if isinstance(pair, list) else pair.split(" "))] for pair in merges]
    ranks = {spelt[i]: i for piece, i in vocabulary.items() if piece not in special}
    in_order = made == sorted(made) and len(set(made)) == len(made) and len(ranks) == 256 + len(made)
    fast = tiktoken.Encoding("ranks", pat_str=PRE_TOKEN, mergeable_ranks=ranks, special_tokens={}) if in_order else None
    young = young_characters()

    def encode(texts: list[str]) -> list[list[int]]:
        found: list[list[int] | None] = [None] * len(texts)
        if fast is not None:
            found = [None if young.search(text) else fast.encode_ordinary(" " + text) for text in texts]
        slow = [k for k, ids in enumerate(found) if ids is None]
        for k, encoded in zip(slow, tokenizer.encode_batch_fast([" " + texts[k] for k in slow], add_special_tokens=False)):
            found[k] = encoded.ids
        return found

    return encode, spelt


def young_characters() -> re.Pattern:
    """A character that Unicode 3.2 does not know, or beyond its first plane."""
    early = unicodedata.ucd_3_2_0.category
    unknown = [c for c in range(1, 1 << 16) if early(chr(c)) in ("Cn", "Cs")]
    begins = [c for k, c in enumerate(unknown) if not k or unknown[k - 1] != c - 1]
    ends = [c for k, c in enumerate(unknown) if k + 1 == len(unknown) or unknown[k + 1] != c + 1]
    return re.compile("[" + "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in zip(begins, ends)) + "\\U00010000-\\U0010ffff]")


def piece_encoder(path: str) -> tuple[Encoder, dict[int, bytes]]:
    """The same for a sentence-piece model, which puts a blank before a text by itself."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(len(model))]
    if any("▁" in piece.lstrip("▁") for piece in pieces):
        raise ValueError("a vocabulary whose pieces span words is not supported")
    spelt = {}
    for i, piece in enumerate(pieces):
        coded = _BYTE_PIECE.fullmatch(piece) if model.is_byte(i) else None
        spelt[i] = bytes([int(coded[1], 16)]) if coded else piece.replace("▁", " ").encode()
    return lambda texts: model.encode(texts, num_threads=1), spelt


def common_cuts(a_ends: list[int], b_ends: list[int]) -> tuple[list[int], list[int], list[int]]:
    """The ends that both sides have, ascending, and how many tokens of either side lie before each.

    Each side's cumulative ends lead to the index of the token that ends there; the ends that both
    dictionaries have are the cuts, and their indexes slice both lists of ids into groups.
    """
    a_index = {end: k for k, end in enumerate(a_ends, 1)}
    b_index = {end: k for k, end in enumerate(b_ends, 1)}
    common = sorted(a_index.keys() & b_index.keys())
    return common, [a_index[end] for end in common], [b_index[end] for end in common]


def _spread(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """begin[k], begin[k] + 1, ... for count[k] numbers, of each k in turn."""
    total = np.cumsum(count)
    return np.repeat(begin - total + count, count) + np.arange(total[-1] if len(total) else 0)


def _named(names: np.ndarray, mark: str) -> np.ndarray:
    return np.array([name + mark for name in names], object)


#: Of a text: tokens of A and of B, groups, links as A id << 32 | B id, their numbers, and the groups in writing.
Aligned = tuple[int, int, int, np.ndarray, np.ndarray, str]
NOTHING: Aligned = (0, 0, 0, np.empty(0, np.int64), np.empty(0, np.int64), "")


class Aligner:
    """Alignments of texts by their chunks.

    A text is cut at blanks that follow a letter, digit or mark; a chunk is what lies between two cuts, with a
    blank before it. Neither tokenizer has a token across such a cut: the byte-level one never joins
    white space to what stands before it, and no piece of the other has a blank behind another character. So
    both give a text the tokens of its chunks in order, a cut is an end on both sides, and a text's groups
    are its chunks' groups. Each distinct chunk is aligned once, as long as it is remembered, many in a row.
    """

    def __init__(self, byte_path: str, piece_path: str) -> None:
        self.encode_a, self.spelt_a = byte_level_encoder(byte_path)
        self.encode_b, self.spelt_b = piece_encoder(piece_path)
        sides = [(self.encode_a, self.spelt_a), (self.encode_b, self.spelt_b)]
        self.length_a, self.length_b = (np.array([len(spelt.get(i, b"")) for i in range(max(spelt) + 1)]) for _, spelt in sides)
        names = np.array([str(i) for i in range(max(len(self.length_a), len(self.length_b)))], object)
        self.name = {mark: _named(names, mark) for mark in ",|;\n"}
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.characters = 0
        self.text: list[str] = []
        self.counts = np.empty((0, 3), np.int64)  # tokens of A, tokens of B, groups; -1 where a side does not spell the chunk
        self.links = np.empty(0, np.int64)
        self.link_at = np.zeros(1, np.int64)

    def _spelt_out(self, chunks: list[str], a: list[list[int]], b: list[list[int]]) -> list[bool]:
        """Whether both sides' tokens spell a chunk with a blank before it."""
        whole = [(" " + chunk).encode() for chunk in chunks]
        sides = ((a, self.spelt_a), (b, self.spelt_b))
        if all(b"".join([spelt[i] for ids in side for i in ids]) == b"".join(whole) for side, spelt in sides):
            return [True] * len(chunks)
        return [all(b"".join([spelt[i] for i in side[k]]) == text for side, spelt in sides) for k, text in enumerate(whole)]

    def _aligned(self, chunks: list[str]) -> None:
        """Adds the alignments of some chunks, whose tokens are laid end to end."""
        a, b = self.encode_a(chunks), self.encode_b(chunks)
        right = self._spelt_out(chunks, a, b)
        good = np.flatnonzero(right)
        a, b = [a[k] for k in good], [b[k] for k in good]
        counts = np.full((len(chunks), 3), -1, np.int64)
        texts = [""] * len(chunks)
        n_links = np.zeros(len(chunks), np.int64)
        links = np.empty(0, np.int64)
        if len(good):
            a_ids, b_ids = (np.fromiter(chain.from_iterable(side), np.int64) for side in (a, b))
            a_ends, b_ends = np.cumsum(self.length_a[a_ids]), np.cumsum(self.length_b[b_ids])
            common, a_cut, b_cut = common_cuts(a_ends.tolist(), b_ends.tolist())
            in_a, in_b = np.diff(a_cut, prepend=0), np.diff(b_cut, prepend=0)
            a_from, b_from = np.array(a_cut) - in_a, np.array(b_cut) - in_b
            # links: each token of A with all tokens of B in its group
            group = np.repeat(np.arange(len(common)), in_a)
            links = np.repeat(a_ids, in_b[group]) << 32 | b_ids[_spread(b_from[group], in_b[group])]
            # the last group of each chunk
            per_chunk = np.array([len(ids) for ids in a])
            last = np.searchsorted(a_cut, np.cumsum(per_chunk))
            counts[good] = np.stack([per_chunk, [len(ids) for ids in b], np.diff(last, prepend=-1)], axis=1)
            n_links[good] = np.diff(np.cumsum(in_a * in_b)[last], prepend=0)
            # in writing: the tokens of both sides in turn, each with the mark that follows it
            written_out = np.empty(len(a_ids) + len(b_ids), object)
            a_place, b_place = _spread(a_from + b_from, in_a), _spread(np.array(a_cut) + b_from, in_b)
            written_out[a_place], written_out[b_place] = self.name[","][a_ids], self.name[","][b_ids]
            a_last, b_last = np.array(a_cut) - 1, np.array(b_cut) - 1
            written_out[a_place[a_last]] = self.name["|"][a_ids[a_last]]
            written_out[b_place[b_last]] = self.name[";"][b_ids[b_last]]
            written_out[b_place[b_last[last]]] = self.name["\n"][b_ids[b_last[last]]]
            for k, text in zip(good, "".join(written_out.tolist()).split("\n")):
                texts[k] = text
        self.known.update(zip(chunks, range(len(self.text), len(self.text) + len(chunks))))
        self.characters += sum(map(len, chunks))
        self.text += texts
        self.counts = np.concatenate([self.counts, counts])
        self.links = np.concatenate([self.links, links])
        self.link_at = np.concatenate([self.link_at, self.link_at[-1] + np.cumsum(n_links)])

    def learn(self, lists: list[list[str]]) -> None:
        """Aligns the chunks that are not known yet."""
        new = set().union(*lists).difference(self.known)
        if len(self.known) + len(new) > REMEMBERED or self.characters > REMEMBERED_CHARACTERS:
            self.forget()
            new = set().union(*lists)
        ordered = list(new)
        for at in range(0, len(ordered), TOGETHER):
            self._aligned(ordered[at : at + TOGETHER])

    def joined(self, chunks: list[str]) -> Aligned | None:
        """The alignment of known chunks in a row; none if one of them is not spelt out."""
        at = [self.known[chunk] for chunk in chunks]
        rows = np.array(at)
        counts = self.counts[rows]
        if (counts < 0).any():
            return None
        begin = self.link_at[rows]
        links, times = np.unique(self.links[_spread(begin, self.link_at[rows + 1] - begin)], return_counts=True)
        text = self.text
        return (*counts.sum(0).tolist(), links, times, ";".join([text[k] for k in at]))

    def long_text(self, text: str) -> Aligned | None:
        """A text's alignment, a stretch of it at a time."""
        total, at = np.zeros(3, np.int64), 0
        links, times, written_out = np.empty(0, np.int64), np.empty(0, np.int64), []
        while at < len(text):
            cut = _CUT.search(text, at + STRETCH)
            end = cut.start() if cut else len(text)
            chunks = _CUT.split(text[at:end])
            self.learn([chunks])
            found = self.joined(chunks)
            if found is None:
                return None
            total += found[:3]
            links, place = np.unique(np.concatenate([links, found[3]]), return_inverse=True)
            times = np.bincount(place, np.concatenate([times, found[4]]), len(links)).astype(np.int64)
            written_out.append(found[5])
            at = end + 1
        return (*total.tolist(), links, times, ";".join(written_out))

    def texts(self, texts: list[str | None]) -> list[Aligned]:
        """The alignment of each text."""
        spoken = [text if text and "▁" not in text else "" for text in texts]
        lists = [_CUT.split(text) if 0 < len(text) <= STRETCH else [] for text in spoken]
        self.learn(lists)
        found = [self.joined(chunks) if chunks else None for chunks in lists]
        found = [self.long_text(text) if len(text) > STRETCH else result for text, result in zip(spoken, found)]
        return [result or NOTHING for result in found]


ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, a array<int>, b array<int>, links array<long>"


def _aligned_documents(byte_path: str | None, piece_path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        paths = byte_path, piece_path
        if None in paths:
            import public_tokenizers

            paths = byte_path or public_tokenizers.path(BYTE_VOCABULARY), piece_path or public_tokenizers.path(PIECE_VOCABULARY)
        aligner = Aligner(*paths)
        names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "a", "b", "links"]

        def listed(values: np.ndarray, at: np.ndarray, kind: type) -> pa.ListArray:
            return pa.ListArray.from_arrays(pa.array(at), pa.array(values.astype(kind)))

        def gathered(ids: pa.Array, texts: list[str | None]) -> pa.RecordBatch:
            found = aligner.texts(texts)
            n_a, n_b, n_groups, links, times, groups = zip(*found)
            at = np.cumsum([0, *map(len, links)], dtype=np.int32)
            pairs = np.concatenate(links)
            counts = [pa.array(c, pa.int64()) for c in (n_a, n_b, n_groups, [int(t.sum()) for t in times])]
            lists = listed(pairs >> 32, at, np.int32), listed(pairs & 0xFFFFFFFF, at, np.int32), listed(np.concatenate(times), at, np.int64)
            return pa.RecordBatch.from_arrays([ids, *counts, pa.array(groups, pa.string()), *lists], names=names)

        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            size = np.cumsum(pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
            at = 0
            while at < batch.num_rows:  # about a stretch of characters at a time
                done = size[at - 1] if at else 0
                end = max(at + 1, int(np.searchsorted(size, done + STRETCH)))
                yield gathered(ids.slice(at, end - at), texts.slice(at, end - at).to_pylist())
                at = end

    return run


def alignments(docs: DataFrame, byte_path: str | None = None, piece_path: str | None = None) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, groups, a, b, links.

    A blank and the text are tokenized by a byte-level vocabulary (side A; special strings are plain text), the text
    by a sentence-piece model that adds the blank itself (side B). `groups` is the whole alignment: groups
    between common ends of tokens, as `a1,a2|b1;a3|b2,b3` with decimal ids in order. A link is a pair
    of an A and a B token that share a group; `a`, `b` and `links` list each pair of ids that is linked, once,
    with its number of links. By default, the public vocabularies that are installed with the executors are used.

    A null or empty text, or one that either side's tokens do not spell byte by byte, has no tokens: zeros, an
    empty text and empty lists. Repeated rows give repeated rows; a null doc_id stays null. Texts of any length
    count whole, a stretch at a time; memory follows the longest run without a blank. Other columns are
    ignored, whatever their names. No documents give no rows.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_aligned_documents(byte_path, piece_path), ALIGNED)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """a, b, documents, best: in how many rows of `alignments` two ids are linked, and whether that is A's highest."""
    pairs = aligned.select(F.explode(F.arrays_zip("a", "b")).alias("pair")).groupBy("pair.a", "pair.b").agg(F.count("*").alias("documents"))
    highest = pairs.groupBy("a").agg(F.max("documents").alias("highest"))
    return pairs.join(highest, "a").select("a", "b", "documents", (F.col("documents") == F.col("highest")).alias("best"))


def frequent_from(counts: DataFrame, most: int) -> int:
    """The least power of two such that at most `most` pairs are in as many documents or more."""
    power = F.floor(F.log2("documents")).cast("int").alias("power")
    sizes = {row["power"]: row["n"] for row in counts.groupBy(power).agg(F.count("*").alias("n")).collect()}  # at most 63 rows
    total = 0
    for power in sorted(sizes, reverse=True):
        total += sizes[power]
        if total > most:
            return 2 << power
    return 1


def scored(aligned: DataFrame, counts: DataFrame, most: int = FREQUENT) -> DataFrame:
    """The rows of `aligned` without their pairs, with n_best and count_sum over all their links.

    Both are stored tables. The most frequent pairs, at most `most` of them, go to the documents, where
    a document's links are summed at once. If there are more pairs, the rare ones' links are dealt by pair; as each is
    in fewer documents than the frequent ones, they are the smaller part of the links and no pair is hot.
    """
    rest = [c for c in aligned.columns if c not in ("a", "b", "links")]
    rows = aligned.withColumn("row", F.monotonically_increasing_id())
    pairs = rows.select("row", F.explode(F.arrays_zip("a", "b", "links")).alias("pair")).select("row", "pair.*")
    least = frequent_from(counts, most)
    found = pairs.join(F.broadcast(counts.where(F.col("documents") >= least)), ["a", "b"], "left")
    if least > 1:
        rare = counts.where(F.col("documents") < least)
        others = found.where(F.col("documents").isNull()).select("row", "a", "b", "links").join(rare, ["a", "b"])
        columns = ["row", "links", "documents", "best"]
        found = found.where(F.col("documents").isNotNull()).select(columns).unionAll(others.select(columns))
    sums = found.groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("links"))).alias("n_best"), F.sum(F.col("links") * F.col("documents")).alias("count_sum")
    )
    zero = F.lit(0).cast("long")
    return rows.select("row", *rest).join(sums, "row", "left").select(*rest, *[F.coalesce(c, zero).alias(c) for c in ("n_best", "count_sum")])


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the alignments of all `documents`."""
    digest = F.when(F.length("groups") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256")
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", digest, "a", "b", "links"]
    aligned = stored(alignments(table(spark, sf_dir, "documents")).select(*columns))
    return scored(aligned, written(pair_counts(aligned)))
