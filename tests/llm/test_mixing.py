import hashlib
import re
from collections import defaultdict

import pytest

from flightpulse.llm.mixing import mix, mixed_documents, op1_mix, source_targets

WORDS = re.compile(r"[^\x20\x09-\x0d]+")


def shared_out(sizes, weights, share, limit):
    """Shares by weight; what exceeds a limit is shared anew until nothing does."""
    total, stopped = share * sum(sizes.values()), {}
    weight = {s: weights[i % len(weights)] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s)))}
    while True:
        rest = [s for s in sizes if s not in stopped]
        left = total - sum(stopped.values())
        given = {s: left * weight[s] / sum(weight[r] for r in rest) for s in rest}
        over = {s: limit * sizes[s] for s in rest if given[s] > limit * sizes[s]}
        if not over:
            return {**given, **stopped}
        stopped.update(over)
        if len(stopped) == len(sizes):
            return stopped


def plain_mix(rows, weights=(3, 1, 2), share=1.5, limit=2.0, seed="mix"):
    sized = [(i, s, len(WORDS.findall(t or ""))) for i, t, s in rows]
    sizes = defaultdict(int)
    for _, s, n in sized:
        sizes[s] += n
    target = shared_out(dict(sizes), weights, share, limit)
    answer = []
    for source, total in sizes.items():
        key = lambda r: (hashlib.md5(":".join([seed] + ([str(r[0])] if r[0] is not None else [])).encode()).hexdigest(), r[0] is not None, r[0] or 0, r[2])
        passes = int(target[source] // total) if total else 0
        rest, begin = int(target[source]) - passes * total, 0
        for i, _, n in sorted((r for r in sized if r[1] == source), key=key):
            answer.append((i, n, total, passes * n + max(0, min(n, rest - begin))))
            begin += n
    return sorted(answer, key=str), target


@pytest.mark.parametrize("range_rows", [2, 8192])
def test_equals_a_plain_version(spark, odd_documents, range_rows):
    rows = [(r["doc_id"], r["text"], r["source"]) for r in odd_documents.collect()]
    expected, target = plain_mix(rows)
    found = mix(odd_documents, range_rows=range_rows).collect()
    assert sorted(((r["doc_id"], r["size"], r["source_size"], r["taken"]) for r in found), key=str) == expected
    assert {round(r["target"], 6) for r in found} == {round(t, 6) for t in target.values()}
    assert all(r["taken"] <= 2 * r["size"] for r in found)


@pytest.mark.parametrize("sizes", [[100, 1, 1], [5, 5, 5, 5], [1, 0, 50, 3, 1000], [0, 0], [7]])
def test_targets_stop_at_their_limit(spark, sizes):
    named = {f"s{i}": n for i, n in enumerate(sizes)}
    frame = spark.createDataFrame([("a" + s, n) for s, n in named.items()], "src string, source_size long")
    found = {r["src"][1:]: r["target"] for r in source_targets(frame).collect()}
    expected = shared_out(named, (3, 1, 2), 1.5, 2.0)
    assert found == pytest.approx(expected)


def test_budget_is_exact_on_the_test_table(spark, mid_dir):
    found = op1_mix(spark, mid_dir).toPandas()
    documents = spark.read.parquet(f"{mid_dir}/documents.parquet").select("doc_id", "source").toPandas()
    by_source = found.merge(documents, on="doc_id").groupby("source").agg({"taken": "sum", "target": "max", "size": "sum", "source_size": "max"})
    assert (by_source["taken"] == by_source["target"].astype(int)).all()
    assert (by_source["size"] == by_source["source_size"]).all()


def test_documents_come_whole_and_as_often_as_taken(odd_documents):
    taken = {}
    for r in mix(odd_documents).collect():
        taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + r["passes"] + r["begun"]
    found = mixed_documents(odd_documents)
    assert found.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    times = {}
    texts = {(r["doc_id"], r["text"]) for r in odd_documents.collect()}
    for r in found.collect():
        assert (r["doc_id"], r["text"]) in texts
        times[r["doc_id"]] = times.get(r["doc_id"], 0) + 1
    assert times == {k: n for k, n in taken.items() if n}


def test_nothing_of_nothing(no_documents):
    assert mix(no_documents).collect() == []
    assert mixed_documents(no_documents).collect() == []


def test_plan_has_no_python(spark, mid_dir):
    plan = op1_mix(spark, mid_dir)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
