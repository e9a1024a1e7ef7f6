"""Token counts from distinct pre-tokens, without making token ids."""

from __future__ import annotations

import json
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flightpulse.llm.shared import table

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 512
#: Pre-tokens whose count a task remembers; when full, the memory starts anew. It bounds memory only.
REMEMBERED = 400_000
#: Pre-tokens of one document that are listed at once.
LISTED = 1 << 20
# Fixed value: the split into pre-tokens that byte-level vocabularies of this family are defined with.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class PieceCounter:
    """Pieces of each pre-token by a vocabulary file, counted once for all documents of a batch."""

    def __init__(self, path: str) -> None:
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        described = json.loads(self.tokenizer.to_str())
        split = described["pre_tokenizer"] or {}
        if split.get("type") != "ByteLevel" or split.get("add_prefix_space") or described["normalizer"]:
            raise ValueError("a byte-level vocabulary without normaliser is needed")
        special = described["added_tokens"]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in special):
            raise ValueError("added tokens that take in their surroundings are not supported")
        self.pattern = regex.compile(PRE_TOKEN)
        strings = sorted((t["content"] for t in special), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, strings))) if strings else None
        # Two libraries may know different editions of Unicode. Characters that an early edition has are
        # the same in both; texts with others are split by the tokenizer itself.
        early = unicodedata.ucd_3_2_0.category
        unknown = [early(chr(c)) in ("Cn", "Cs") for c in range(1 << 16)] + [True]
        edges = [c for c in range(1, 1 << 16) if unknown[c] != unknown[c - 1]]
        ranges = zip(edges[::2], edges[1::2] + [1 << 16])
        self.young = re.compile("[" + "".join(f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in ranges) + "\\U00010000-\\U0010ffff]")
        self.known: dict[str, int] = {}

    def split(self, text: str) -> Iterator[str]:
        if self.young.search(text):
            return (text[begin:end] for _, (begin, end) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text))
        if len(text) <= LISTED:
            return self.pattern.findall(text)
        return (m.group() for m in self.pattern.finditer(text))

    def frequencies(self, text: str) -> tuple[Counter, int]:
        """How often each pre-token is in a text, and the number of special strings between them."""
        parts = self.special.split(text) if self.special else [text]
        found: Counter = Counter()
        for part in parts:
            found.update(self.split(part))
        return found, len(parts) - 1

    def count(self, texts: list[str | None]) -> list[int]:
        """Tokens of each text: the pieces of the batch's distinct pre-tokens, joined to each text's frequencies."""
        frequencies = [self.frequencies(text or "") for text in texts]
        new = set().union(*(found for found, _ in frequencies)).difference(self.known) if texts else set()
        if len(self.known) + len(new) > REMEMBERED:
            self.known = {}
            new = set().union(*(found for found, _ in frequencies))
        ordered = list(new)
        for at in range(0, len(ordered), 10_000):
            part = ordered[at : at + 10_000]
            encoded = self.tokenizer.encode_batch_fast(part, add_special_tokens=False)
            self.known.update(zip(part, map(len, encoded)))
        pieces = self.known
        return [sum(n * pieces[word] for word, n in found.items()) + extra for found, extra in frequencies]


def _counted(path: str | None, group: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        if path is None:
            import public_tokenizers

            counter = PieceCounter(public_tokenizers.path(VOCABULARY))
        else:
            counter = PieceCounter(path)
        for batch in batches:
            for at in range(0, batch.num_rows, group):
                part = batch.slice(at, group)
                tokens = counter.count(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("n_bytes"), pa.array(tokens, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"]
                )

    return run


def token_counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT, group: int = 512) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit.

    `path` names a byte-level vocabulary file that all executors can open; by default, it is the public
    one that is installed with them. `group` documents are split into pre-tokens together; each distinct
    pre-token's pieces are counted once and joined to the documents' frequencies. Special strings inside
    a text are one token each. A null or empty text has no bytes and no tokens. Repeated rows give
    repeated rows; other columns are ignored, whatever their names.
    """
    source = docs.select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text"
    )
    counted = source.mapInArrow(_counted(path, group), "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
