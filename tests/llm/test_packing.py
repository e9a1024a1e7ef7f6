import random
import re

import pytest

from flightpulse.llm.packing import op5_packing, pack, packed


def plain(sizes, sources, clusters, capacity):
    """Every bin is looked at for every piece."""
    bins, placed, whole = [], [], []
    for i, size in enumerate(sizes):
        whole += [i] * (size // capacity)
        rest = size % capacity
        if not rest:
            continue
        fits = [
            (b["left"], n) for n, b in enumerate(bins)
            if b["left"] >= rest and not (sources[i] is not None and sources[i] in b["sources"])
            and not (clusters[i] is not None and clusters[i] in b["clusters"])
        ]
        if fits:
            n = min(fits)[1]
        else:
            n = len(bins)
            bins.append({"left": capacity, "sources": set(), "clusters": set()})
        placed.append((i, n, capacity - bins[n]["left"]))
        bins[n]["left"] -= rest
        bins[n]["sources"].add(sources[i])
        bins[n]["clusters"].add(clusters[i])
    return placed, [(i, len(bins) + k, 0) for k, i in enumerate(whole)]


@pytest.mark.parametrize("seed", range(8))
def test_equals_a_plain_search(seed):
    draw = random.Random(seed)
    rows = sorted(
        (
            (draw.choice((draw.randrange(1, 30), draw.randrange(1, 140), 100, 200)), draw.choice([None, *"abcdefgh"] + ["hot"] * 4), draw.randrange(40))
            for _ in range(300)
        ),
        key=lambda r: -r[0],
    )
    sizes, sources, clusters = map(list, zip(*rows))
    rows, bins, offsets = packed(sizes, sources, clusters, 100)
    placed, whole = plain(sizes, sources, clusters, 100)
    assert sorted(zip(rows, bins, offsets)) == sorted(placed + whole)


def test_more_sources_and_clusters_than_a_word_has_bits():
    sizes, sources, clusters = [3] * 400, [f"s{i % 130}" for i in range(400)], [i % 150 for i in range(400)]
    rows, bins, offsets = packed(sizes, sources, clusters, 60)
    placed, whole = plain(sizes, sources, clusters, 60)
    assert sorted(zip(rows, bins, offsets)) == sorted(placed + whole)


def checked(pieces, words, capacity):
    by_bin, by_doc = {}, {}
    for r in pieces:
        by_bin.setdefault((r["shard"], r["bin"]), []).append(r)
        by_doc.setdefault(r["doc_id"], []).append(r)
    for rows in by_bin.values():
        rows.sort(key=lambda r: r["bin_offset"])
        at = 0
        for r in rows:
            assert r["bin_offset"] == at and r["n_words"] > 0
            at += r["n_words"]
        assert at <= capacity
        sources = [r["source"] for r in rows if r["source"] is not None]
        assert len(sources) == len(set(sources)) and len({r["cluster"] for r in rows}) == len(rows)
    assert {i: sum(r["n_words"] for r in rows) for i, rows in by_doc.items()} == words


def test_odd_documents(odd_documents, no_documents):
    words = {}
    for r in odd_documents.collect():
        if n := len(re.findall(r"[^\x20\x09-\x0d]+", r["text"] or "")):
            words[r["doc_id"]] = words.get(r["doc_id"], 0) + n
    pieces = pack(odd_documents, capacity=1000, shard_rows=5).collect()
    checked(pieces, words, 1000)
    assert {r["first_word"] for r in pieces if r["doc_id"] == 6} == {1000 * k for k in range(15)}
    assert pack(no_documents).collect() == []


def test_test_table(spark, mid_dir):
    words = {
        r["doc_id"]: n for r in spark.read.parquet(f"{mid_dir}/documents.parquet").collect()
        if (n := len(re.findall(r"[^\x20\x09-\x0d]+", r["text"] or "")))
    }
    pieces = op5_packing(spark, mid_dir).collect()
    checked(pieces, words, 2048)
    assert sorted(map(tuple, pieces)) == sorted(map(tuple, op5_packing(spark, mid_dir).collect()))
