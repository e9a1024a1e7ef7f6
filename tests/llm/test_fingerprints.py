import re
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from flightpulse.llm import fingerprints
from flightpulse.llm.shared import table


def plain_fingerprint(text):
    folded = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", folded)
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """The smallest id reachable from each row, by comparing all pairs of fingerprints."""
    distinct = sorted(set(fp for _, fp in prints))
    values = np.array(distinct, np.uint64)
    label = list(range(len(distinct)))

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    for i in range(len(distinct)):
        for j in np.flatnonzero(np.bitwise_count(values[i] ^ values[i + 1 :]) <= 4) + i + 1:
            label[max(root(i), root(j))] = min(root(i), root(j))
    place = {fp: root(k) for k, fp in enumerate(distinct)}
    least = {}
    for doc_id, fp in prints:
        if doc_id is not None:
            least[place[fp]] = min(least.get(place[fp], doc_id), doc_id)
    return [(doc_id, fp, least.get(place[fp])) for doc_id, fp in prints]


def rows_of(frame):
    return sorted(((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in frame.collect()), key=str)


def test_query_equals_the_plain_version(spark, mid_dir):
    documents = [tuple(r) for r in table(spark, mid_dir, "documents").select("doc_id", "text").collect()]
    want = [(i, f"{fp:016x}", c) for i, fp, c in plain_components([(i, plain_fingerprint(t)) for i, t in documents])]
    found = [tuple(r) for r in fingerprints.op13_simhash(spark, mid_dir).select("doc_id", "fingerprint", "component_id").collect()]
    assert sorted(found) == sorted(want)
    assert len({c for _, _, c in found}) < len(found)


def test_odd_documents(spark, odd_documents, no_documents):
    prints = [(r["doc_id"], plain_fingerprint(r["text"])) for r in odd_documents.collect()]
    frame = odd_documents.withColumn("fp", F.lit("extra")).withColumn("root", F.lit(1)).withColumn("node", F.lit(1))
    assert rows_of(fingerprints.similar_fingerprints(frame)) == sorted(plain_components(prints), key=str)
    assert fingerprints.similar_fingerprints(no_documents).collect() == []


def test_stretches_do_not_change_a_fingerprint():
    texts = ["one two\tthree\x0bfour five six", "a", "a b c", "", " \n ", "Ünï CÖDE words É here and there", "w" * 5000, "x y " * 3000]
    for text in texts:
        for stretch in (1, 7, 100, 1 << 20):
            assert fingerprints.fingerprint(text.encode(), stretch=stretch) == plain_fingerprint(text), (text[:20], stretch)


def test_four_shared_bytes_share_a_key():
    triples = fingerprints.key_positions()
    assert len(triples) == 20 and len(fingerprints.key_positions()) < 56
    for shared in combinations(range(8), 4):
        assert any(set(triple) <= set(shared) for triple in triples)


@pytest.mark.parametrize("block_rows", [fingerprints.BLOCK, 40])
def test_links_of_crowded_entries(spark, monkeypatch, block_rows):
    """Balls of near fingerprints, chains, and pairs at distances 4 and 5, in entries of few and of many blocks."""
    draw = np.random.default_rng(8)
    centres = draw.integers(0, 1 << 63, 3, dtype=np.uint64)
    prints = {int(c) for c in centres}
    for c in centres[:2]:
        for _ in range(250):
            bits = draw.choice(64, draw.integers(1, 9), replace=False)
            prints.add(int(c) ^ sum(1 << int(b) for b in bits))
    chain = int(centres[2])
    for start in range(0, 40, 4):
        chain ^= 0xF << start
        prints.add(chain)
    prints.add(chain ^ (0x1F << 50))
    prints |= {0, 0b1111, 1 << 63, (1 << 64) - 1}
    rows = [(k, fp) for k, fp in enumerate(sorted(prints))]
    frame = spark.createDataFrame([(fp - (1 << 64) if fp >> 63 else fp,) for _, fp in rows], "fp long")
    monkeypatch.setattr(fingerprints, "SHORT", 16)
    links = [(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in fingerprints.fingerprint_links(frame, block_rows).collect()]
    assert all((a ^ b).bit_count() >= 1 and a != b for a, b in links)
    label = {fp: fp for _, fp in rows}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in links:
        label[max(root(a), root(b))] = min(root(a), root(b))
    found = {}
    for k, fp in rows:
        found.setdefault(root(fp), []).append(k)
    want = {}
    for k, _, c in plain_components(rows):
        want.setdefault(c, []).append(k)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, want.values()))
    assert len(links) < 20 * len(rows) * (1 if block_rows > 1000 else 12)
