import math

import pytest

from loamdex.llm import mixing


def corpus(spark, sizes, length=10):
    rows, i = [], 0
    for source, n in sizes.items():
        for _ in range(n):
            rows.append((i, " ".join(["w"] * length), source, "x"))
            i += 1
    return spark.createDataFrame(rows, "doc_id long, text string, source string, epoch string")


def shares(rows):
    total = {}
    for r in rows:
        total[r.source] = total.get(r.source, 0) + r.n_tokens
    return {s: t / sum(total.values()) for s, t in total.items()}


def test_entropy_is_met(spark):
    docs = corpus(spark, {"a": 600, "b": 200, "c": 100, "d": 50})
    rows = mixing.mix(docs, entropy=0.95, max_epochs=10, blocks=8).collect()
    got = shares(rows)
    entropy = -sum(p * math.log(p) for p in got.values()) / math.log(4)
    assert entropy == pytest.approx(0.95, abs=0.01)
    assert sum(r.n_tokens for r in rows) == pytest.approx(9500, abs=4 * 10)


def test_repetition_limit_binds(spark):
    docs = corpus(spark, {"a": 900, "b": 10})
    rows = mixing.mix(docs, entropy=1.0, max_epochs=3, blocks=4).collect()
    times = {}
    for r in rows:
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    assert max(times.values()) == 3
    assert sum(r.source == "b" for r in rows) == pytest.approx(30, abs=1)


def test_epochs_are_permutations_and_budget_holds(spark):
    docs = corpus(spark, {"a": 120, "b": 40})
    rows = mixing.mix(docs, budget=3000, entropy=1.0, max_epochs=8, blocks=4).collect()
    assert sum(r.n_tokens for r in rows) <= 3000
    seen = set()
    for r in rows:
        assert (r.doc_id, r.epoch) not in seen
        seen.add((r.doc_id, r.epoch))
    by_epoch = lambda e: [r.doc_id for r in sorted((r for r in rows if r.source == "b" and r.epoch == e), key=lambda r: r.key)]
    assert sorted(by_epoch(0)) == sorted(by_epoch(1)) and by_epoch(0) != by_epoch(1)


def test_cover_leaves_nothing_out(spark):
    docs = corpus(spark, {"a": 300, "b": 100, "c": 30})
    rows = mixing.mix_rows(docs, "cover", max_epochs=2.0, blocks=4)
    assert rows.columns == docs.columns
    times = {}
    for r in rows.collect():
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    assert len(times) == 430 and max(times.values()) == 2
    assert all(times[i] == 1 for i in range(300)) and sum(times[i] for i in range(400, 430)) == pytest.approx(60, abs=1)


def test_edges(spark):
    rows = [(None, "a b", None, "x"), (1, None, "s", "x"), (1, "a", "s", "x"), (1, "a", "s", "x"), (2, "", "empty", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, epoch string")
    found = mixing.mix(docs, blocks=2).collect()
    assert {r.source for r in found} == {"", "s"}
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.mix_rows(docs.limit(0)).count() == 0
    assert mixing.mix(docs.filter("doc_id = 2")).count() == 0
