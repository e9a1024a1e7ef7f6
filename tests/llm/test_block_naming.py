import hashlib
import re

import pytest

from flightpulse.llm.block_naming import exact_duplicates, op6_exact_dedup, without_duplicates


def plain(rows):
    groups = {}
    for i, text in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0d]+", " ", text or ""), []).append(i)
    answer = []
    for content, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        answer += [(i, keep, len(ids), hashlib.sha256(content.encode()).hexdigest()) for i in ids]
    return sorted(answer, key=str)


@pytest.mark.parametrize(("block_bytes", "mark_bits"), [(1, 64), (3, 2), (64, 1), (2048, 64)])
def test_equals_a_plain_version(odd_documents, block_bytes, mark_bits):
    rows = [(r["doc_id"], (r["text"] or "")[:90] or None) for r in odd_documents.collect()]
    frame = odd_documents.sparkSession.createDataFrame(rows, "doc_id long, text string").coalesce(1) if block_bytes < 64 else odd_documents
    rows = [(r["doc_id"], r["text"]) for r in frame.collect()]
    found = exact_duplicates(frame, block_bytes=block_bytes, mark_bits=mark_bits).collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in found), key=str) == plain(rows)
    kept = [r["text_sha256"] for r in found if r["kept"]]
    assert len(kept) == len(set(kept)) == len({r["text_sha256"] for r in found})
    assert all(r["doc_id"] == r["keep_id"] for r in found if r["kept"])


@pytest.mark.parametrize("mark_bits", [64, 1])
def test_neighbouring_contents_keep_their_names_apart(spark, mark_bits):
    texts = ["aabb", "bbaa", "aab", "aabbaabb", "aabba", "abab", "aabbaabbaabb", "a", "aa", "aabb", "aabba"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    found = exact_duplicates(frame, block_bytes=2, mark_bits=mark_bits).collect()
    assert {r["doc_id"]: r["keep_id"] for r in found} == {i: texts.index(t) for i, t in enumerate(texts)}


def test_documents_that_stay(odd_documents, no_documents):
    stay = without_duplicates(odd_documents)
    assert stay.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted((r["doc_id"] for r in stay.collect()), key=str) == sorted([1, 2, 3, 5, 6, 9, 10, None], key=str)
    assert without_duplicates(no_documents).collect() == []


def test_test_table(spark, mid_dir):
    documents = spark.read.parquet(f"{mid_dir}/documents.parquet").select("doc_id", "text").collect()
    found = op6_exact_dedup(spark, mid_dir).collect()
    expected = plain([(r["doc_id"], r["text"]) for r in documents])
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in found), key=str) == expected
