"""Quality rules and the rule ensemble."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamdex.llm import quality_rules, rule_ensemble
from tests.llm.data import table


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute(text):
    w = words(text)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    again = {i + j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(3)}
    lines, seen = 0, set()
    for line in (text or "").split("\n"):
        if words(line):
            lines += line in seen
            seen.add(line)
    symbols = sum((text or "").count(c) for c in "#*$%&|<>")
    return len(w), sum(map(len, w)), symbols, lines, len(again), len(w) < 50 or 100 * len(again) > 50 * len(w)


TEXTS = [None, "", " \n\t", "a", "a b", "a b c", "a b c a b c", "a a a a", "x y z\nx y z\n\nx y z ", "#*$%&|<> é\x0bñ\x0c", "one  two three   four\r\nfive", "la " * 3000, " ".join(map(str, range(60))), "😀 a 😀 a 😀 a"]


def frame(spark, texts):
    rows = [(i if i else None, t, "en" if i % 2 else None, "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n_words string")


def test_base_statistics(spark):
    texts = [*TEXTS, *(r.text for r in table(spark, "documents").limit(60).collect())]
    labels = spark.createDataFrame([], "doc_id long, quality int")
    found = quality_rules.apply_rules(frame(spark, texts), labels).collect()
    for r in found:
        wanted = brute(texts[r.doc_id or 0])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == wanted
        assert r.kept == (not wanted[-1])
    assert len(found) == len(texts)
    assert quality_rules.apply_rules(frame(spark, TEXTS).limit(0), labels).count() == 0


def tail(n, k, a):
    log = lambda j: math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(a) + (n - j) * math.log(1 - a)
    return sum(math.exp(log(j)) for j in range(k + 1))


def statistics(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_lines long, n_repeat_words long")


def test_the_tail_is_exact(spark):
    cases = [(n, k, a) for a in (0.02, 0.3) for n in (1, 5, 30, 400, 20_000, 2_000_000) for k in {0, 1, 7, int(a * n / 2), int(0.98 * a * n)} if k < a * n]
    for a in (0.02, 0.3):
        for r in spark.createDataFrame([(n, k) for n, k, b in cases if b == a], "n long, k long").withColumn("p", quality_rules.tail(a)).collect():
            assert r.p == pytest.approx(tail(r.n, r.k, a), rel=1e-6), r


def test_the_strictest_level_before_a_failure(spark):
    n = 3000
    rows = [(i, "en", 100, 500, 50 if i % 500 == 0 else (8 if i % 10 == 0 else 0), 0, 10, 0) for i in range(n)]
    labels = spark.createDataFrame([(i, 1) for i in range(n)] + [(0, 0), (1, None)], "doc_id long, quality int")
    good = n - 1  # one document is labelled both ways
    for k, passes in ((5, True), (299, False)):
        assert (tail(good, k, 0.02) <= 0.05) == passes
    # Level 2 fails, so level 3, which alone would pass, isn't looked at.
    for ladder, level in (((0.2, 0.05, 0.01, 0.5), 1), ((0.2, 0.05), 1), ((0.01, 0.5), None)):
        found = quality_rules.certified_levels(statistics(spark, rows), labels, 0.02, 0.05, {"symbol_ratio": ladder}).collect()
        assert [tuple(r) for r in found] == ([("en", level)] if level is not None else [])


def test_strata_share_the_risk(spark):
    """Of strata of 250, 250 and 140 good texts, the third could certify nothing at a third of delta, but two can at half."""
    sizes = {"en": 250, "fr": 250, "de": 140}
    rows = [(100_000 * s + i, lang, 100, 500, 0, 0, 10, 0) for s, (lang, n) in enumerate(sizes.items()) for i in range(n)]
    labels = spark.createDataFrame([(r[0], 1) for r in rows], "doc_id long, quality int")
    found = quality_rules.certified_levels(statistics(spark, rows), labels, 0.02, 0.05).collect()
    assert sorted(map(tuple, found)) == [("en", 5), ("fr", 5)]
    assert 0.98**140 > 0.05 / 3 and 0.98**250 < 0.05 / 2


def test_rules_apply_where_certified(spark):
    """Texts at, below and above a cutoff, ties included, in a stratum with a certified level and in one without."""
    plain = " ".join(str(i + 1000) for i in range(60))  # 240 characters in words
    good = [plain] * 160
    marked = lambda k: " ".join([plain, *("$" * k + str(i + 2000) for i in range(10))])
    texts = good + [marked(2), marked(9), marked(7), None, plain]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)] + [(1000, marked(9), "fr"), (1001, marked(9), None)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(len(good))], "doc_id long, quality int")
    found = {r.doc_id: r.kept for r in quality_rules.apply_rules(docs, labels, ladder={"symbol_ratio": (0.9, 0.2)}).collect()}
    # 20 / 300 is below; 70 / 350 is the cutoff itself, which isn't above; 90 / 370 is.
    assert [found[i] for i in (160, 161, 162, 163, 164, 1000, 1001)] == [True, False, True, False, True, True, True]
    assert all(found[i] for i in range(160))


def test_few_labels_certify_nothing(spark):
    docs = frame(spark, [" ".join(map(str, range(60)))] * 40)
    labels = spark.createDataFrame([(i, 1) for i in range(40)], "doc_id long, quality int")
    assert quality_rules.apply_rules(docs, labels).filter("kept").count() == 40


def test_rules_are_paths_and_lasso_is_sparse():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 6))
    y = ((x[:, 0] > 0.5) & (x[:, 1] < 0.4)).astype(float)
    b, rules = rule_ensemble.fit(x, y)
    every = rule_ensemble.extract_rules(x, y)
    assert 0 < len(rules) < len(every)
    assert all(1 <= len(r) <= rule_ensemble.DEPTH for r, _ in rules)
    score = b + rule_ensemble.rule_matrix(x, [r for r, _ in rules]) @ np.array([w for _, w in rules])
    assert ((score > 0) == y).mean() > 0.97


def test_compiled_score_equals_the_model(spark):
    rng = np.random.default_rng(2)
    x = rng.random((50, 2))
    weighted = [(((0, True, 0.5),), 1.5), (((0, False, 0.3), (1, True, 0.2)), -2.0)]
    rows = spark.createDataFrame([(int(i), float(a), float(b)) for i, (a, b) in enumerate(x)], "i int, a double, b double")
    found = [r.s for r in rows.select("i", rule_ensemble.compile_score(["a", "b"], 0.25, weighted).alias("s")).orderBy("i").collect()]
    wanted = 0.25 + rule_ensemble.rule_matrix(x, [r for r, _ in weighted]) @ np.array([1.5, -2.0])
    assert found == pytest.approx((1 / (1 + np.exp(-wanted))).tolist())


def test_held_out_accuracy(spark):
    labels = table(spark, "labels")
    found = rule_ensemble.classify(table(spark, "documents"), labels)
    assert found.count() == table(spark, "documents").count()
    both = found.join(labels, "doc_id").select("doc_id", "held_out", "score", "predicted", "quality").collect()
    for r in both:
        import zlib

        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1
    held = [r for r in both if r.held_out]
    assert sum(r.predicted == r.quality for r in held) >= 0.8 * len(held)


def test_labels_of_held_out_rows_play_no_part(spark):
    docs, labels = table(spark, "documents"), table(spark, "labels")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    changed = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    score = lambda x: {r.doc_id: r.score for r in rule_ensemble.classify(docs, x).collect()}
    assert score(labels) == score(changed)


def test_edges(spark):
    docs = frame(spark, TEXTS)
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    found = rule_ensemble.classify(docs, none).collect()
    assert len(found) == len(TEXTS) and {r.score for r in found} == {0.5}
    one = spark.createDataFrame([(i, 1) for i in range(1, 9)], "doc_id long, quality int")
    assert all(r.score > 0.9 for r in rule_ensemble.classify(docs, one).collect())
    assert rule_ensemble.classify(docs.limit(0), none).count() == 0
