import hashlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
from flightpulse.llm import alignment  # noqa: E402
from flightpulse.llm.shared import table  # noqa: E402

PATHS = [public_tokenizers.path(n) for n in (alignment.BYTE_VOCABULARY, alignment.PIECE_VOCABULARY)]


def plain_groups(text):
    """Groups of a whole text, tokenized at once, found by walking both sides."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer, decoders

    tokenizer = plain_groups.a = getattr(plain_groups, "a", None) or Tokenizer.from_file(PATHS[0])
    tokenizer.encode_special_tokens = True
    model = plain_groups.b = getattr(plain_groups, "b", None) or SentencePieceProcessor(model_file=PATHS[1])
    if not text:
        return []
    whole = (" " + text).encode()
    encoded = tokenizer.encode(" " + text, add_special_tokens=False)
    assert decoders.ByteLevel().decode(encoded.tokens) == " " + text
    byte = alignment.byte_alphabet()
    a = [(i, len(t)) for i, t in zip(encoded.ids, encoded.tokens)]
    assert all(c in byte for t in encoded.tokens for c in t)
    b, spelt = [], b""
    for i in model.encode(text):
        piece = model.id_to_piece(i)
        data = bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode()
        b.append((i, len(data)))
        spelt += data
    if spelt != whole:
        return []
    groups, left, right, at_a, at_b = [], [], [], 0, 0
    while a or b:
        if at_a <= at_b:
            i, n = a.pop(0)
            left.append(i)
            at_a += n
        else:
            i, n = b.pop(0)
            right.append(i)
            at_b += n
        if at_a == at_b:
            groups.append((left, right))
            left, right = [], []
    return groups


def plain_rows(documents):
    groups = [(doc_id, plain_groups(text)) for doc_id, text in documents]
    counts = Counter(pair for _, found in groups for pair in {(x, y) for a, b in found for x in a for y in b})
    highest = defaultdict(int)
    for (a, _), n in counts.items():
        highest[a] = max(highest[a], n)
    rows = []
    for doc_id, found in groups:
        links = [(x, y) for a, b in found for x in a for y in b]
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in found)
        rows.append(
            (
                doc_id,
                sum(len(a) for a, _ in found),
                sum(len(b) for _, b in found),
                len(found),
                len(links),
                sum(counts[pair] == highest[pair[0]] for pair in links),
                sum(counts[pair] for pair in links),
                hashlib.sha256(text.encode()).hexdigest() if text else "",
            )
        )
    return rows


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
ODD = [
    "  two  blanks\n here \t\n  x ",
    "special <|endoftext|> <s> </s> <unk> <0x0A> strings",
    "a▁b joined by the mark of a blank",
    "日本語のテキスト и русский \U0001f600‍\x00\x1c \x85 　 \xa0 é",
    "don't  I'll  we've 12,345.67 3½ ٠١",
    "a " * 40 + "\r\n" + " " * 30 + "end   ",
    "x" * 5000 + " " + "1" * 3000,
]


def ordered(rows):
    return sorted(rows, key=str)


def test_chunks_give_the_groups_of_whole_texts(monkeypatch):
    aligner = alignment.Aligner(*PATHS)
    for stretch in (1 << 20, 7):
        monkeypatch.setattr(alignment, "STRETCH", stretch)
        for text in ODD:
            found = plain_groups(text)
            want = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in found)
            assert aligner.texts([None, text, ""])[1][5] == want, text
    assert aligner.texts(ODD)[2] is alignment.NOTHING


def test_query_equals_the_plain_version(spark, sf_dir):
    documents = [tuple(r) for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    found = alignment.op11_alignment(spark, sf_dir).select(*COLUMNS).collect()
    assert ordered(map(tuple, found)) == ordered(plain_rows(documents))


def test_odd_documents_and_rare_pairs(spark, odd_documents, no_documents):
    extra = spark.createDataFrame(enumerate(ODD, 100), "doc_id long, text string")
    docs = odd_documents.select("doc_id", "text").unionAll(extra).withColumn("a", F.lit("extra")).withColumn("groups", F.lit(1))
    want = ordered(plain_rows([(r["doc_id"], r["text"]) for r in docs.collect()]))
    digest = F.when(F.length("groups") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256")
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", digest, "a", "b", "links"]
    aligned = alignment.stored(alignment.alignments(docs).select(*columns))
    counts = alignment.written(alignment.pair_counts(aligned))
    n = counts.count()
    for most in (n, n // 2, 3, 0):  # all pairs go to the documents, or the frequent ones only, or none
        least = alignment.frequent_from(counts, most)
        assert counts.where(F.col("documents") >= least).count() <= most and (least == 1) == (most == n)
        assert ordered(map(tuple, alignment.scored(aligned, counts, most).select(*COLUMNS).collect())) == want
    assert alignment.alignments(no_documents).collect() == []
    assert alignment.pair_counts(alignment.alignments(no_documents)).collect() == []


def test_a_long_text_keeps_memory_small():
    import tracemalloc

    aligner = alignment.Aligner(*PATHS)
    text = "some words of a long text " * 200_000  # 5.2 MB
    tracemalloc.start()
    found = aligner.texts([text])[0]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found[0] == 6 * 200_000 + 1 and found[2] == found[1] and peak < 40 * len(text)
