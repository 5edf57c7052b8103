import math
import os
import random
import re
import time
import zlib

import numpy as np
import pytest

from loamdex.llm import toxicity
from tests.llm.data import SF, table


@pytest.fixture(scope="module")
def model(spark):
    text = "you stupid idiot and pathetic loser the moron is a clown with trash of worthless disgusting scum all in an hour it is good to be here"
    docs = spark.createDataFrame([(f"{text} " * 20,), (None,), ("",)], "text string")
    return toxicity.language_model({r.code: r.n for r in toxicity.trigram_counts(docs).collect()})


def test_trigram_counts(spark):
    docs = spark.createDataFrame([("Ab ab",), ("a",)], "text string")
    a, b = toxicity.CLASS["a"], toxicity.CLASS["b"]
    code = lambda x, y, z: (x * 64 + y) * 64 + z
    assert {r.code: r.n for r in toxicity.trigram_counts(docs).collect()} == {code(0, 0, a): 3, code(0, a, b): 2, code(a, b, 0): 2, code(0, a, 0): 1}


def test_model_is_a_distribution(model):
    assert np.allclose(np.exp(np.array(model)).sum(2), 1, atol=1e-4)


@pytest.mark.parametrize(("raw", "wanted"), [
    ("1d10t", "idiot"), ("st00pid", "stoopid"), ("$tup1d!!", "stupid"), ("l0s3r,", "loser"), ("m0r0n", "moron"), ("s-t-u-p-i-d", "stupid"), ("stuuuuupid", "stupid"), ("P4THET1C", "pathetic"),
    ("hello", "hello"), ("2024", "2024"), ("good,", "good"), ("***", ""),
])
def test_restoring(model, raw, wanted):
    if raw == "st00pid":
        assert toxicity.restore(raw, model) in ("stoopid", "stopid")
    else:
        assert toxicity.restore(raw, model) == wanted


def test_letters_apart(model):
    assert "idiot" in toxicity.restored_tokens("you i d i o t here", model, {})
    assert "stupid" in toxicity.restored_tokens("s. t. u. p. i. d", model, {})


def test_spelled_runs_are_those_of_the_pattern():
    """One scan finds what a pattern that tries all ends does."""
    r, pattern = random.Random(1), re.compile(r"(?<!\S)(?:[^\W_][ .\-_*]+){3,}[^\W_](?!\S)")
    for _ in range(30_000):
        text = "".join(r.choice(["a", "b", " ", " ", ".", "-", "ab", "\n", "é", "_", "!"]) for _ in range(r.randrange(25)))
        assert list(toxicity.spelled(text)) == [m[0] for m in pattern.finditer(text)], repr(text)


@pytest.mark.parametrize("unit", ["a. ", "a .", "ab. ", "a.", "a b c d\n", "a-b ", ". "])
def test_long_texts_take_linear_time(unit, model):
    text = unit * (300_000 // len(unit)) + "x!"
    began = time.process_time()
    list(toxicity.spelled(text))
    assert time.process_time() - began < 0.5


def test_viterbi_is_the_best_path(model):
    """Against all readings of a short lattice."""
    import itertools

    def cost(letters, extra):
        state, total = (0, 0), extra
        for c in letters:
            z = toxicity.CLASS.get(c, toxicity.OTHER)
            total -= model[state[0]][state[1]][z]
            state = (state[1], z)
        return total - model[state[0]][state[1]][0]

    for token in ("1d10t", "l00ser", "c1111own", "ab"):
        every = [("".join(p for p, _ in path), sum(k for _, k in path)) for path in itertools.product(*toxicity.lattice(token))]
        best = min(every, key=lambda x: cost(*x))
        assert math.isclose(cost(*best), min(cost(*x) for x in every))
        assert cost(toxicity.decode(token, model), 0) <= cost(*best) + 1e-6


def test_disguised_as_by_its_pattern():
    """Against the same rule as one pattern, which is slow on long tokens."""
    import random
    import re

    signs = r"[0-9@$!|+€£¡(<]"
    plain = re.compile(rf"[^\W\d_].*{signs}+.*[^\W\d_]|{signs}+[^\W\d_]+.*[^\W\d_]|[^\W\d_]+[0-9@$|€£]+$")
    rng = random.Random(2)
    for _ in range(20_000):
        token = "".join(rng.choice("ab1$!-_é٣") for _ in range(rng.randint(1, 7)))
        assert toxicity.disguised(token) == bool(plain.search(token)), token


@pytest.mark.parametrize("token", ["a" * 50_000 + "1" * 50_000 + "-", "a" * 100_000, "a1" * 50_000, "1" * 100_000, "a-" * 50_000, "!" * 99_999 + "a"])
def test_very_long_tokens(model, token):
    import time

    begin = time.process_time()
    toxicity.restored_tokens(f"x {token} y", model, {})
    assert time.process_time() - begin < 5  # linear; patterns that go back take hours


def plain_scores(docs, labels):
    """`score_texts` in plain loops, for labels below the sample's size. `docs` is [(doc_id, text)], `labels` {doc_id: toxic}."""
    from collections import Counter

    import xxhash

    codes = Counter()
    for _, text in docs:
        classes = [toxicity.CLASS.get(c.lower(), toxicity.OTHER) if c.isalnum() and ord(c) < 1 << 16 else 0 for c in text or ""]
        word: list[int] = []
        for c in [*classes, 0]:
            if c:
                word.append(c)
            elif word:
                ends = [0, 0, *word, 0]
                codes.update((a * 64 + b) * 64 + c for a, b, c in zip(ends, ends[1:], ends[2:]))
                word = []
    model = toxicity.language_model(codes)
    tokens = lambda text: toxicity.restored_tokens(text or "", model, {})
    by_key = {}
    for i, text in docs:
        if i in labels and zlib.crc32(str(i).encode()) % 3 != 1:
            w = (text or "").split()
            key = min(xxhash.xxh64_intdigest(" ".join(w[j : j + 3])) >> 1 for j in range(max(1, len(w) - 2)))
            by_key[key] = min(by_key.get(key, (i, labels[i], text)), (i, labels[i], text))
    first = [(y, tokens(t)) for k, (_, y, t) in by_key.items() if k % 2 == 0]
    second = [(y, tokens(t)) for k, (_, y, t) in by_key.items() if k % 2]
    bad, good = (sum(len(t) for y, t in first if y == want) for want in (1, 0))
    times = [Counter(f for y, t in first if y == want for x in t for f in toxicity.features(x)) for want in (0, 1)]
    odds = {f: math.log((n + 0.5) / (bad + 1)) - math.log((times[0][f] + 0.5) / (good + 1)) for f, n in times[1].items() if n >= toxicity.LEAST_TIMES}
    odds = {f: o for f, o in odds.items() if o >= toxicity.LEAST_ODDS}

    def seen(found):
        return toxicity.summary([v for t in found if (v := toxicity.token_odds(t, odds)) > 0], len(found))

    w = toxicity.fit_logistic(np.array([seen(t) for _, t in second]), np.array([y for y, _ in second], float))
    return {(i, t): 1 / (1 + math.exp(-max(-30.0, min(30.0, w[0] + float(np.dot(w[1:], seen(tokens(t)))))))) for i, t in docs}


def test_against_plain_loops(spark):
    """The whole operator, on the test table with further toxic texts, an empty one and a null one."""
    docs = [(r.doc_id, r.text) for r in table(spark, "documents").collect()]
    labels = {r.doc_id: r.toxic for r in table(spark, "labels").collect()}
    words = ["stupid", "moron", "1d10t", "l0ser"]
    for i in range(120):
        labels[10_000 + i] = int(i % 2 == 0)
        docs.append((10_000 + i, f"{docs[i][1][:200]} {words[i % 4]} {words[(i + 1) % 4]}" if i % 2 == 0 else docs[i][1][100:400]))
    docs += [(20_000, None), (20_001, "")]
    found = toxicity.score_texts(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(list(labels.items()), "doc_id long, toxic int")).collect()
    wanted = {i: v for (i, _), v in plain_scores(docs, labels).items()}
    assert len(found) == len(docs) and max(abs(r.score - wanted[r.doc_id]) for r in found) < 1e-6


def test_held_out_accuracy_and_folds(spark):
    folder = next(f for f in ("/root/testdata/sf0.1", SF) if os.path.isdir(f))  # the least table with some hundred toxic labels to learn from
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    found = toxicity.score_texts(docs, labels)
    rows = found.join(labels, "doc_id").select("doc_id", "held_out", "score", "predicted", "toxic").collect()
    assert found.count() == docs.count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1
    held = [r for r in rows if r.held_out]
    clean, toxic = [r for r in held if not r.toxic], [r for r in held if r.toxic]
    assert sum(r.predicted for r in clean) <= 0.05 * len(clean)
    assert sum(r.predicted for r in toxic) >= 0.8 * len(toxic) > 0


def test_planted(spark):
    """Toxic words are learnt, and found in disguise, in texts of their own."""
    import random

    rng = random.Random(3)
    plain = [f"{a}{b}" for a in ("ba", "co", "di", "fu", "ge") for b in ("lor", "men", "nat", "pir", "sed")]
    toxic = ["stupid", "idiot", "loser", "moron"]
    rows, labels = [], []
    for i in range(600):
        words = [rng.choice(plain) for _ in range(40)]
        bad = i % 4 == 0
        if bad:
            for w in rng.sample(toxic, 3):
                words[rng.randrange(40)] = w
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    extra = [(1000, " ".join(plain) + " st0pid 1d10t l0s3r"), (1001, " ".join(plain)), (1002, None), (1003, ""), (None, "idiot stupid loser moron " + " ".join(plain)), (1001, " ".join(plain))]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows + extra], "doc_id long, text string, score string")
    found = toxicity.score_texts(docs, spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, toxic int")).collect()
    by = {}
    for r in found:
        by.setdefault(r.doc_id, []).append(r.predicted)
    assert by[1000] == [1] and by[None] == [1] and by[1001] == [0, 0] and by[1002] == [0] and by[1003] == [0]
    held = [r for r in found if r.held_out and r.doc_id is not None and r.doc_id < 600]
    assert sum(r.predicted == int(r.doc_id % 4 == 0) for r in held) >= 0.97 * len(held)


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    found = toxicity.score_texts(docs, none).collect()
    assert [r.predicted for r in found] == [0, 0]
    assert toxicity.score_texts(docs.limit(0), none).count() == 0
