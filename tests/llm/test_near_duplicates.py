import random
import re

import numpy as np
import pytest

import pyarrow as pa

from flightpulse.llm import near_duplicates as near
from flightpulse.llm.components import connected_components
from flightpulse.llm.near_duplicates import _Powers, near_duplicates, op4_near_dedup, shingle_set, sketch, without_near_duplicates, word_hashes

LOWER = {i: i + 32 for i in range(65, 91)}


def plain_sets(rows, k=4):
    sets = {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))) if w else frozenset()
    return sets


def plain_components(sets):
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for at, a in enumerate(ids):
        for b in ids[at + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def family(rows, seed=1):
    """Texts that differ from one of three originals by some replaced words."""
    draw = random.Random(seed)
    originals = [[f"w{draw.randrange(5000)}" for _ in range(draw.choice((30, 120, 400)))] for _ in range(3)]
    texts = []
    for i in range(rows):
        words = list(originals[i % 3])
        for _ in range(draw.randrange(0, max(2, len(words) // 15))):
            words[draw.randrange(len(words))] = f"x{draw.randrange(10**6)}"
        texts.append((i, " ".join(words)))
    return texts


@pytest.mark.parametrize(("block", "stretch"), [(1024, 2048), (7, 16)])
def test_families_of_graded_similarity(spark, monkeypatch, block, stretch):
    monkeypatch.setattr(near, "BLOCK", block)
    monkeypatch.setattr(near, "STRETCH", stretch)
    rows = family(240)
    sets = plain_sets(rows)
    expected = plain_components(sets)
    found = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == expected
    assert {r["doc_id"]: r["n_shingles"] for r in found} == {i: len(s) for i, s in sets.items()}
    assert {r["doc_id"] for r in found if r["kept"]} == set(expected.values())


def test_test_table(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    found = op4_near_dedup(spark, sf_dir).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == plain_components(plain_sets(rows))


def test_odd_documents(odd_documents, no_documents):
    found = {(r["doc_id"], r["n_shingles"]): (r["component_id"], r["kept"]) for r in near_duplicates(odd_documents).collect()}
    assert found[(2, 3)] == (1, False) and found[(1, 3)] == (1, True) and found[(8, 3)] == (1, False)
    assert found[(3, 0)] == (3, True) and found[(4, 0)] == (4, True) and found[(None, 0)] == (None, True)
    assert found[(None, 1)] == (None, True)
    assert found[(7, 5)] == (6, False) and found[(11, 1)] == (10, False)
    assert near_duplicates(odd_documents).count() == odd_documents.count()
    stay = without_near_duplicates(odd_documents)
    assert stay.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted((r["doc_id"] for r in stay.collect()), key=str) == sorted([1, 3, 4, 5, 6, 9, 10, None, None], key=str)
    assert near_duplicates(no_documents).collect() == []
    assert without_near_duplicates(no_documents).collect() == []


@pytest.mark.parametrize("size", [1, 5, 90, 2000])
def test_every_coordinate_is_filled_and_estimates_the_similarity(size):
    draw = np.random.default_rng(size)
    pool = draw.integers(0, 2**63, 3 * size + 3, dtype=np.uint64)
    a, b = np.unique(pool[: 2 * size + 1]), np.unique(pool[size // 2 : 2 * size + 1 + size // 2])
    similarity = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    left, right = sketch(a, 512), sketch(b, 512)
    assert (left != np.uint64(2**64 - 1)).all()
    assert abs((left == right).mean() - similarity) < 0.12


def test_shingles_follow_words_not_spaces():
    powers = _Powers()
    of = lambda text: shingle_set(np.frombuffer(text.encode(), np.uint8), 4, powers).tolist()
    assert of("A b c d e") == of("  a\tB\x0bc \n d   E ")
    assert of("ab c d e") != of("a bc d e") and of("É b c d") != of("é b c d")
    assert len(of("a b")) == 1 and of("a b") != of("b a") and of(" \n") == []


@pytest.mark.parametrize("shape", ["chain", "star", "mixed", "none"])
def test_components(spark, shape):
    draw = random.Random(3)
    edges = {
        "chain": [(i, i + 1) for i in range(60)],
        "star": [(500, i) for i in range(80)],
        "mixed": [(draw.randrange(150), draw.randrange(150)) for _ in range(90)],
        "none": [],
    }[shape]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    found = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    touched = {x for a, b in edges if a != b for x in (a, b)}
    assert {r["node"]: r["root"] for r in found} == {x: find(x) for x in touched}
    assert len(found) == len(touched)


@pytest.mark.parametrize("stretch", [5, 2048])
def test_links_between_blocks(monkeypatch, stretch):
    monkeypatch.setattr(near, "STRETCH", stretch)
    draw = random.Random(stretch)
    base = list(range(100, 160))
    sets = {}
    for i in range(60):
        kept = draw.sample(base, draw.randrange(40, 60))
        sets[bytes([i])] = sorted(kept + [1000 * (i + 1) + k for k in range(draw.randrange(0, 8))])
    root = {key: bytes([200 + draw.randrange(12)]) for key in sets}
    left, right = list(sets)[:35], list(sets)[20:]  # some on both sides

    def side(keys, mark):
        columns = {"key": keys, "root": [root[k] for k in keys], "elements": [sets[k] for k in keys]}
        types = {"key": pa.binary(), "root": pa.binary(), "elements": pa.list_(pa.int64())}
        return pa.table({f"{c}_{mark}": pa.array(v, types[c]) for c, v in columns.items()})

    expected = set()
    for a in left:
        for b in right:
            common = len(set(sets[a]) & set(sets[b]))
            if root[a] != root[b] and 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                expected.add(frozenset((root[a], root[b])))
    found = near._linked_roots(side(left, "a"), side(right, "b")).to_pylist()
    assert {frozenset((r["a"], r["b"])) for r in found} == expected and len(found) == len(expected) > 3
    assert near._linked_roots(side([], "a"), side(right, "b")).num_rows == 0


def test_links_of_extremely_long_texts_are_counted_in_whole_numbers(monkeypatch):
    monkeypatch.setattr(near, "STRETCH", 1 << 20)
    common = next(c for c in range(2_700_000, 2_800_000, 4) if float(np.float32(100) * np.float32(c)) < 100 * c)
    sets = [np.arange(common), np.arange(common + common // 4)]  # exactly at 0.8
    side = lambda mark, k: pa.table({f"key_{mark}": pa.array([b"%d" % k], pa.binary()), f"root_{mark}": pa.array([b"%d" % k], pa.binary()), f"elements_{mark}": pa.array([sets[k]], pa.list_(pa.int64()))})
    assert near._linked_roots(side("a", 0), side("b", 1)).num_rows == 1


@pytest.mark.parametrize("length", [10, 14])
def test_words_of_one_byte_each_and_its_complement_stay_apart(length):
    word = "a"
    for _ in range(length):
        word += word.translate({97: 98, 98: 97})
    text = f"{word} {word.translate({97: 98, 98: 97})}"
    assert len(set(word_hashes(np.frombuffer(text.encode(), np.uint8), _Powers()).tolist())) == 2


@pytest.mark.parametrize("piece", [1, 3, 64, 1 << 20])
def test_word_hashes_do_not_depend_on_pieces(monkeypatch, piece):
    draw = random.Random(4)
    text = " ".join("".join(draw.choice("abcDEé時\t") for _ in range(draw.randrange(1, 90))) for _ in range(300)).encode()
    words = re.findall(rb"[^\x20\x09-\x0d]+", text.lower())
    monkeypatch.setattr(near, "PIECE", piece)
    hashes = word_hashes(np.frombuffer(text, np.uint8), _Powers()).tolist()
    assert len(hashes) == len(words) and len(set(zip(words, hashes))) == len(set(words)) == len(set(hashes))
    assert word_hashes(np.frombuffer(b" \n ", np.uint8), _Powers()).tolist() == []


def test_sets_and_sketches_of_long_texts_do_not_depend_on_pieces(monkeypatch):
    draw = random.Random(9)
    data = np.frombuffer(" ".join(f"w{draw.randrange(400)}" for _ in range(3000)).encode(), np.uint8)
    elements = shingle_set(data, 4, _Powers())
    values = sketch(elements, 96)
    monkeypatch.setattr(near, "PIECE", 50)
    assert (shingle_set(data, 4, _Powers()) == elements).all() and (sketch(elements, 96) == values).all()


def test_a_bucket_of_long_members_is_cut_by_shingles(spark, monkeypatch):
    monkeypatch.setattr(near, "BLOCK_SHINGLES", 500)
    rows = family(120, seed=3)
    found = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == plain_components(plain_sets(rows))
