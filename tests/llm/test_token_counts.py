import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from flightpulse.llm.token_counts import PieceCounter, op8_token_counts, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["\x1c", "\x85", "\xa0", " ", " ", "　", "​", "﻿", "²", "١", "ſ", "'S", "'s", "'re", "\r\n", "\t", "  ", "<|endoftext|>",
       "a", "B", "é", "中", "😀", "́", "ª", "\x00", "_", "ꙮ", "\U00018f4c", "౜"]


def library(texts):
    tokenizer = Tokenizer.from_file(PATH)
    return [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("seed", range(3))
def test_equals_the_library_on_odd_characters(seed):
    draw = random.Random(seed)
    texts = ["".join(draw.choice(ODD) for _ in range(draw.randrange(14))) for _ in range(3000)]
    assert PieceCounter(PATH).count(texts) == library(texts)


def test_memory_that_starts_anew(monkeypatch):
    monkeypatch.setattr("flightpulse.llm.token_counts.REMEMBERED", 5)
    monkeypatch.setattr("flightpulse.llm.token_counts.LISTED", 10)
    counter = PieceCounter(PATH)
    texts = ["one two three", "four five <|endoftext|> six seven eight nine", "", "one four unbelievable"]
    assert [counter.count([t])[0] for t in texts] == counter.count(texts) == library(texts)


def test_test_table_and_odd_documents(spark, sf_dir, odd_documents, no_documents):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for source, found in ((documents, op8_token_counts(spark, sf_dir)), (odd_documents, token_counts(odd_documents))):
        rows = source.collect()
        tokens = library([r["text"] or "" for r in rows])
        expected = [(r["doc_id"], len((r["text"] or "").encode()), n, n > 512) for r, n in zip(rows, tokens)]
        assert sorted(map(tuple, found.collect()), key=str) == sorted(expected, key=str)
    assert token_counts(no_documents).collect() == []
