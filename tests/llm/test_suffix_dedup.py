import hashlib
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from loamdex.llm import suffix_dedup
from loamdex.llm.suffix_dedup import WINDOW
from tests.llm.data import docs, table


def brute(rows):
    """rows: (doc_id, text). The contract by a dictionary of first places."""
    first = {}
    data = [(i, (t or "").encode()) for i, t in rows]
    for i, b in data:
        for s in range(len(b) - WINDOW + 1):
            key = b[s : s + WINDOW]
            if key not in first or (i, s) < first[key]:
                first[key] = (i, s)
    out = []
    for i, b in data:
        gone = np.zeros(len(b) + 1, bool)
        for s in range(len(b) - WINDOW + 1):
            if first[b[s : s + WINDOW]] < (i, s):
                gone[s : s + WINDOW] = True
        kept = bytes(c for c, g in zip(b, gone, strict=False) if not g)
        out.append((i, len(b), int(gone.sum()), int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])).sum()) if len(b) else 0, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def check(spark, rows):
    frame = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n_bytes string")
    assert sorted(map(tuple, suffix_dedup.digests(frame).collect())) == brute(rows)


@settings(max_examples=150, deadline=None, derandomize=True)
@given(st.one_of(st.binary(max_size=400), st.text("ab", max_size=500).map(str.encode), st.text("abc\0", max_size=300).map(str.encode)))
def test_suffix_array_is_sorted(data):
    text = np.frombuffer(data, np.uint8)
    order = suffix_dedup.suffix_array(text).tolist()
    assert sorted(order) == list(range(len(data)))
    keys = [data[i : i + WINDOW] for i in order]
    assert keys == sorted(keys)


def test_planted(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeéñ ") for _ in range(rng.randint(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, other, long = text(30), text(60), text(4000)
    rows = [
        (1, text(40) + passage + text(30)), (2, passage), (3, text(10) + passage), (4, passage + passage), (5, None), (6, ""), (7, "a" * 350), (8, "a" * 99), (9, "a" * 100),
        (10, "ab" * 120), (11, "ba" * 120), (12, other), (13, other), (14, other[:150] + "X" + other[150:]), (15, long), (16, long[3000:9000]), (17, long[100:250] + "é" + long[200:420]), (18, "line\n" * 60),
    ]
    check(spark, rows)


def test_repeated_rows_and_ids(spark):
    a, b = "x%d " * 60 % tuple(range(60)), "y%d " * 60 % tuple(range(60))
    check(spark, [(1, a), (1, a), (2, a + b), (3, b), (3, b)])
    frame = docs(spark, [a]).selectExpr("CAST(NULL AS LONG) AS doc_id", "text").union(docs(spark, [a]).select("doc_id", "text"))
    found = {r.doc_id: r.n_removed for r in suffix_dedup.digests(frame).collect()}
    assert found == {1: 0, None: len(a)}
    assert suffix_dedup.digests(frame.limit(0)).count() == 0


def test_a_copy_among_rows_of_one_id(spark):
    a, b, c, d = ("".join(f"{x}{i} " for i in range(70)) for x in "wxyz")
    rows = [(1, a), (None, a), (None, b), (2, c), (3, c), (3, d)]
    found = suffix_dedup.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert sorted((str(r.doc_id), r.kept_sha256) for r in found) == sorted([("1", sha(a)), ("None", sha("")), ("None", sha(b)), ("2", sha(c)), ("3", sha("")), ("3", sha(d))])


def test_hot_phrase(spark, monkeypatch):
    monkeypatch.setattr("loamdex.llm.anchors.HOT", 5)
    rng = random.Random(1)
    text = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    phrase, passage = text(60), text(130)
    check(spark, [(i, text(150) + phrase + text(150) + (passage if i % 2 else "") + text(9)) for i in range(30)])


def test_equal_segments_are_folded_in_any_order(spark, monkeypatch):
    rng = random.Random(2)
    text = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    shared, longer = text(260), text(400)
    rows = [(i, text(rng.randint(0, 150)) + shared + text(90) + (longer if i % 3 else shared)) for i in range(40)]
    rng.shuffle(rows)
    rows += [rows[0], (rows[1][0], shared + rows[1][1])]
    for fold, hot in ((1 << 16, 2048), (3, 2048), (1 << 16, 5)):
        monkeypatch.setattr("loamdex.llm.anchors.FOLD", fold)
        monkeypatch.setattr("loamdex.llm.anchors.HOT", hot)
        check(spark, rows)


def test_test_table(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, "documents").collect()]
    check(spark, rows)
