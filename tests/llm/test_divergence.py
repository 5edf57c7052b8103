"""Source divergence against dense loops."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from loamdex.llm import divergence

from .data import SF, table

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def plain(rows, min_docs=30, prior=5, top=50):
    """rows: (text, lang, source)."""
    docs, n, sources = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        found = Counter(x.translate(LOW) for x in TERM.findall(text or ""))
        sources[lang].add(source)
        n[lang, source].update(found)
        docs[lang].update(found.keys())
    out = []
    for lang, own in sources.items():
        kept = [t for t, d in docs[lang].items() if d >= min_docs]

        def share(counts, kept=kept):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + prior) // (total + prior * len(kept)) for t in kept}

        q = share(sum((n[lang, s] for s in own), Counter()))
        p = {s: share(n[lang, s]) for s in own}
        for s in own:
            pair = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in own if o != s)
            term = sorted((q[t] - p[s][t], t.encode(), t) for t in kept if n[lang, s][t] and p[s][t] > q[t])[:top]
            out += [(lang, s, part, item, -v, rank) for part, listed in (("pair", pair), ("term", term)) for rank, (v, _, item) in enumerate(listed, 1)]
    return sorted(out)


def found(spark, rows, **settings):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "text string, lang string, source string, term string, value int")
    return sorted(map(tuple, divergence.audit(df, **settings).collect()))


def corpus(seed, n, vocabulary=80, sources=7):
    r = random.Random(seed)
    words = ["".join(r.choice("abcÄéß한") for _ in range(r.randrange(1, 6))) for _ in range(vocabulary)]
    return [(" ".join(r.choice(words[i % 5 :: 1 + i % 3]) for _ in range(r.randrange(40))) + r.choice(["", " A-b_c 12x\tZ"]), r.choice(["en", "en", "de"]), f"s{r.randrange(sources)}") for i in range(n)]


@pytest.mark.parametrize("settings", [{}, {"min_docs": 2, "top": 7}, {"min_docs": 1, "top": 1, "prior": 1}, {"min_docs": 10_000}])
def test_random(spark, settings):
    rows = corpus(1, 400)
    assert found(spark, rows, **settings) == plain(rows, **settings)


def test_edges(spark):
    rows = corpus(2, 150) + [(None, "en", "s0"), ("abc", None, None), ("", "xx", "alone"), (None, None, "s1"), ("abc ABC abç Abc\u0000abc", "en", None)]
    rows += [rows[3]] * 40 + [("word " * 50_000 + "other", "en", "long")]
    for settings in ({}, {"min_docs": 1}):
        assert found(spark, rows, **settings) == plain(rows, **settings)
    assert found(spark, []) == []


def test_ties_are_settled_by_bytes(spark):
    """All terms of a source occur once, and many share long prefixes."""
    terms = [f"{'prefix' * 5}{a}{b}" for a in "abcdefghij" for b in "klmnoéßz"] + ["prefix" * 5, "prefix", "é", "z"]
    rows = [(" ".join(terms), "en", "a"), ("z z z y", "en", "b"), ("y " * 40, "en", "c")]
    want = plain(rows, min_docs=1)
    assert found(spark, rows, min_docs=1) == want
    assert len([r for r in want if r[1] == "a" and r[2] == "term"]) == 50


def test_top_k_of_any_values(spark):
    r = random.Random(3)
    rows = [(r.choice("ab"), r.choice([0, 1, 65535, 65536, 2**31, r.randrange(2**32)]), f"{i % 9}\0" * (i % 4) + f"{i}") for i in range(900)] + [("a", 5, "x"), ("a", 5, "x\0"), ("c", 1, "")]
    df = spark.createDataFrame(rows, "g string, v long, i string")
    for k in (1, 20, 10_000):
        out = sorted(map(tuple, divergence.top_k(df, ["g"], "v", "i", k).collect()))
        want = []
        for g in "abc":
            best = sorted([x for x in rows if x[0] == g], key=lambda x: (-x[1], x[2].encode()))[:k]
            want += [(*x, rank) for rank, x in enumerate(best, 1)]
        assert out == sorted(want)


def test_share_is_exact(spark):
    r = random.Random(4)
    rows = [(r.randrange(10 ** r.randrange(1, 13)), r.randrange(10 ** r.randrange(1, 13)), r.randrange(1, 10 ** r.randrange(1, 8))) for _ in range(2000)] + [(0, 0, 0), (10**9 - 5, 10**9, 0), (2, 7, 0)]
    df = spark.createDataFrame(rows, "n long, t long, v long")
    for n, t, v, p in df.select("n", "t", "v", divergence.share(df.n, df.t, df.v)).collect():
        assert p == 1 + (10**9 * (n + 5) // (t + 5 * v) if t + 5 * v else 0)


def test_whole_table_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert sorted(map(tuple, divergence.audit(table(spark, "documents")).collect())) == sorted(con.execute(divergence.oracle()).fetchall())
