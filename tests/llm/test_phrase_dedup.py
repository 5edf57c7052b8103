import hashlib
import random
import re

from loamdex.llm import phrase_dedup
from loamdex.llm.phrase_dedup import WINDOW
from tests.llm.data import docs, table


def brute(rows):
    data = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for i, w in data:
        for s in range(len(w) - WINDOW + 1):
            key = tuple(w[s : s + WINDOW])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, w in data:
        gone = set()
        for s in range(len(w) - WINDOW + 1):
            if first[tuple(w[s : s + WINDOW])] < i:
                gone.update(range(s, s + WINDOW))
        kept = [x for p, x in enumerate(w) if p not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out)


def check(spark, rows):
    frame = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n_words string")
    assert sorted(map(tuple, phrase_dedup.digests(frame).collect())) == brute(rows)


def maker(seed):
    rng = random.Random(seed)
    return lambda n: " ".join("".join(rng.choice("abcdé") for _ in range(rng.randint(1, 5))) for _ in range(n))


def test_planted(spark):
    text = maker(2)
    passage, other, long = text(80), text(200), text(5000)
    words = other.split()
    rows = [
        (1, text(40) + " " + passage + " " + text(30)), (2, passage), (3, text(10) + "\n\n" + passage.replace(" ", "\t", 9)), (4, passage + " " + passage), (5, None), (6, " \n"), (7, "la " * 200), (8, "la " * 60), (9, "la " * 49),
        (10, "la lu " * 90), (11, "lu la " * 90), (12, other), (13, other), (14, " ".join(words[:120] + ["X"] + words[120:])), (15, long), (16, " ".join(long.split()[300:900])), (17, " ".join(words[100:160] + long.split()[4000:4070])),
    ]
    check(spark, rows)


def test_repeats_within_a_document_stay(spark):
    text = maker(3)
    a = text(60)
    check(spark, [(1, a + " x " + a), (1, a), (2, text(99))])
    frame = docs(spark, [a]).selectExpr("CAST(NULL AS LONG) AS doc_id", "text").union(docs(spark, [a]).select("doc_id", "text"))
    assert {r.doc_id: r.n_removed for r in phrase_dedup.digests(frame).collect()} == {1: 0, None: 60}
    assert phrase_dedup.digests(frame.limit(0)).count() == 0


def test_a_copy_among_rows_of_one_id(spark):
    text = maker(5)
    a, b, c, d = (text(70) for _ in range(4))
    rows = [(1, a), (None, a), (None, b), (2, c), (3, c), (3, d)]
    found = phrase_dedup.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert sorted((str(r.doc_id), r.kept_sha256) for r in found) == sorted([("1", sha(a)), ("None", sha("")), ("None", sha(b)), ("2", sha(c)), ("3", sha("")), ("3", sha(d))])


def test_hot_phrase(spark, monkeypatch):
    monkeypatch.setattr("loamdex.llm.anchors.HOT", 5)
    text = maker(4)
    phrase, passage = text(30), text(64)
    check(spark, [(i, " ".join([text(60), phrase, text(60), passage if i % 2 else "", text(3)])) for i in range(30)])


def test_the_automaton_locates_the_occurrences(spark, monkeypatch):
    text = maker(6)
    a, b = text(70), text(90)
    frame = spark.createDataFrame([(1, a), (2, f"x {a}"), (3, b), (4, f"{b} {a}")], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in phrase_dedup.digests(frame).collect()} == {1: 0, 2: 70, 3: 0, 4: 160}
    shard = phrase_dedup.Shard([(a.encode(), 1), (b.encode(), 3)])
    assert sorted(shard.locate(f"{b} {a}".encode())) == [(0, 90, 3), (90, 160, 1)]
    assert shard.locate(f"{' '.join(a.split()[:49])} {b[:9]}".encode()) == [] == phrase_dedup.Shard([]).locate(a.encode())


def test_test_table(spark):
    check(spark, [(r.doc_id, r.text) for r in table(spark, "documents").collect()])
