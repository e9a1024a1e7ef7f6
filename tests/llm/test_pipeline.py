from collections import Counter

import corpus_pipeline
import pytest
from test_block_naming import plain as plain_exact
from test_mixing import plain_mix
from test_near_duplicates import plain_components, plain_sets
from test_packing import checked

from flightpulse.llm.quality import quality

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    """The rows after each stage, written and read again in between."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = [docs.collect()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / f"{k}.parquet")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        assert k == len(corpus_pipeline.STAGES) - 1 or docs.columns == COLUMNS
        found.append(docs.collect())
    return found


def test_rejected_documents_go(spark, sf_dir, stages):
    scores = quality(*(spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "labels"))).collect()
    assert {r["doc_id"] for r in stages[1]} == {r["doc_id"] for r in scores if r["predicted"] == 1}
    assert 0 < len(stages[1]) < len(stages[0])


def test_one_of_equal_texts_stays(stages):
    expected = {keep for _, keep, _, _ in plain_exact([(r["doc_id"], r["text"]) for r in stages[1]])}
    assert Counter(r["doc_id"] for r in stages[2]) == Counter(expected) and len(stages[2]) < len(stages[1])


def test_one_of_each_component_stays(stages):
    expected = set(plain_components(plain_sets([(r["doc_id"], r["text"]) for r in stages[2]], 5)).values())
    assert Counter(r["doc_id"] for r in stages[3]) == Counter(expected) and len(stages[3]) < len(stages[2])


def test_sources_are_mixed(stages):
    taken, _ = plain_mix([(r["doc_id"], r["text"], r["source"]) for r in stages[3]])
    expected = {i: -(-n // size) for i, size, _, n in taken if n}
    assert Counter(r["doc_id"] for r in stages[4]) == Counter(expected)


def test_sequences_hold_all_words(stages):
    words = {}
    for r in stages[4]:
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + len((r["text"] or "").split())
    checked(stages[5], {i: n for i, n in words.items() if n}, 2048)


def test_run_gives_the_last_stage(spark, sf_dir, stages):
    order = lambda rows: sorted(tuple(r) for r in rows)
    assert order(corpus_pipeline.run(spark, sf_dir).collect()) == order(stages[5])


def test_odd_documents_pass_all_stages(spark, odd_documents, no_documents, labels, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for name, docs in (("odd", odd_documents), ("none", no_documents)):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            path = f"{tmp_path}/{name}-{k}.parquet"
            stage(spark, docs, str(tmp_path)).write.parquet(path)
            docs = spark.read.parquet(path)
        assert (docs.count() == 0) == (name == "none")
