"""The analysed block index against sums over all postings, and what a search reads of it."""

import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loamdex import service
from loamdex.functions.analysis import query_units, stem, stems_sql
from loamdex.operators import block_index, bm25


def docs_of(spark, rows):
    df = spark.createDataFrame(rows, "doc_id string, title string, body string")
    more = {"source": F.lit("web"), "space": F.lit("s"), "tags": F.array(F.lit("t")), "categories": F.array(F.lit("t")), "hierarchy": F.array(F.lit("s")), "author": F.lit("Ann")}
    return df.withColumns(more | {"created_at": F.lit(None).cast("timestamp"), "updated_at": F.to_timestamp(F.lit("2024-01-01")), "static_score": F.lit(0.0)})


ROWS = [
    ("a", "Payments", "The payment of fees, by foo_bar and others."), ("b", "Paying", "foo and bar apart; a bar foo"), ("c", "Café society", "naïve relational operators were running"),
    ("d", "Other", "nothing of that"), ("e", "foo bar", "in the title"), ("f", None, None), ("g", "split", "foo at its end"), ("h", "bar", "of two fields: foo"),
]


@pytest.fixture(scope="module")
def saved(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index"))
    service.build(docs_of(spark, ROWS), path)
    return path


def ids(df):
    return [r.doc_id for r in df.collect()]


def test_units():
    assert query_units("Payments x foo_bar 마트를 __ ÉTATS-unis") == [("payment",), ("foo", "bar"), ("마트",), ("etat",), ("uni",)]


def test_service_finds_inflections_and_folded_words(spark, saved):
    found = lambda q, **s: sorted(ids(service.Service.open(spark, saved, settings=service.Settings(**s)).search(q)[0]))
    for rerank in (True, False):
        assert found("payment", rerank=rerank) == ["a"]
        assert found("cafe", rerank=rerank) == ["c"] and found("NAIVE run", rerank=rerank) == ["c"]
    assert ids(service.Service.open(spark, saved).advanced_search(title="payment")) == ["a"]
    assert ids(service.Service.open(spark, saved).advanced_search(title="cafés", body="operator")) == ["c"]


def test_split_words_stand_together_in_a_field(spark, saved):
    index = block_index.load(spark, saved + "/index")
    assert sorted(ids(block_index.best(index, query_units("foo_bar"), 10).rows)) == ["a", "e"]
    assert sorted(ids(block_index.best(index, query_units("bar-foo"), 10).rows)) == ["a", "b", "e", "g", "h"]  # a hyphen parts two words
    assert ids(block_index.best(index, query_units("foo_bar"), 10, only="title").rows) == ["e"]
    assert ids(block_index.best(index, query_units("bar_foo_foo"), 10).rows) == []


def test_same_as_all_postings_and_fewer_blocks(spark):
    r = random.Random(1)
    words = [f"w{i}" for i in range(200)]
    text = lambda n: " ".join(words[min(int(r.paretovariate(0.6)) - 1, 199)] for _ in range(r.randrange(1, n)))
    rows = [(f"{i:05}", text(6), text(60)) for i in range(3000)]
    rows[77] = ("00077", "w150 w190", "w190 w190")
    docs = docs_of(spark, rows)
    built = block_index.build(docs, slot_docs=20)
    index = block_index.BlockIndex(block_index.materialize(built.blocks), built.lengths, built.totals)
    assert index.stats()[2] == 150
    for q, only in (("w0 w190 w150", None), ("w0 w1", None), ("w0 w0 w17", "title"), ("w3_w0 w20", None)):
        units = query_units(q)
        for k in (1, 10, 5000):
            all_of = [tuple(x) for x in block_index.all_scores(index, units, only).orderBy("bm25", "doc_id").limit(k).collect()]
            best = block_index.best(index, units, k, only=only, few=0)
            got = [tuple(x) for x in best.rows.collect()]
            assert [round(x[1], 9) for x in got] == [round(x[1], 9) for x in all_of]
            assert {x[0] for x in got if round(x[1], 9) > round(got[-1][1], 9) or k == 5000} <= {x[0] for x in all_of}
            if q == "w0 w190 w150" and k == 1:
                assert got[0][0] == "00077" and best.read() < 0.5 * best.blocks
    some = docs.filter("cast(doc_id as int) % 3 = 0")
    allowed = block_index.best(index, query_units("w0 w9"), 10, some, few=0).rows.collect()
    wanted = block_index.all_scores(index, query_units("w0 w9")).join(some.select("doc_id"), "doc_id").orderBy("bm25", "doc_id").limit(10).collect()
    assert [round(x.bm25, 9) for x in allowed] == [round(x.bm25, 9) for x in wanted]


def test_heads_are_read_without_postings_and_pruned_by_term(spark, saved):
    index = block_index.load(spark, saved + "/index")
    plan = block_index.Scorer(index, query_units("payments fees")).bounds()._jdf.queryExecution().executedPlan().toString()
    schema = plan.split("ReadSchema: ")[1]
    assert "postings" not in schema and "In(term, [fee,payment])" in plan


def contents(index):
    rows = index.blocks.select("term", F.explode("postings").alias("p")).select("term", "p.*").collect()
    heads = index.blocks.groupBy("term").agg(F.sum("n"), F.sum("n_title"), F.sum("n_body"), F.max("max_title"), F.max("max_body"), F.min("least_length")).collect()
    stats = index.stats()
    return sorted(map(repr, rows)), sorted(map(tuple, heads)), sorted((r.doc_id, r.length) for r in index.lengths.collect()), stats[:2]


def test_refresh_is_a_new_build(spark):
    one = docs_of(spark, [(f"{i}", f"title {i % 7}", f"body words {i % 5} of number {i}") for i in range(60)])
    stored = block_index.build(one, slot_docs=10)
    changed = docs_of(spark, [("3", "changed now", "other text"), ("100", "new", "title words"), ("7", None, None)])
    live = one.filter("doc_id NOT IN ('3', '7', '9', '10')").select("doc_id").union(changed.select("doc_id"))
    rows = one.join(live, "doc_id", "left_semi").join(changed.select("doc_id"), "doc_id", "left_anti").unionByName(changed)
    fresh = block_index.refresh(stored, changed, live, slot_docs=10)
    assert contents(fresh) == contents(block_index.build(rows, slot_docs=10)) and fresh.stats()[2] == 6
    grown = block_index.refresh(stored, changed, live, slot_docs=3)  # as if the documents had doubled: all are dealt anew
    assert contents(grown) == contents(block_index.build(rows, slot_docs=3)) and grown.stats()[2] == 20


def test_stems_are_those_of_the_sql(spark):
    r = random.Random(2)
    ends = ["", "s", "ies", "sses", "ed", "ing", "eed", "ational", "ation", "izer", "ization", "iveness", "biliti", "ability", "ical", "ful", "icate", "ement", "sion", "e", "ll", "y", "yed", "ance", "tted", "yying"]
    words = {"".join(r.choice("aeioustnrlydgm") for _ in range(r.randrange(1, 8))) + r.choice(ends) for _ in range(20_000)} | {"café", "한국어", "straße", "2024s", "yes"}
    con = duckdb.connect()
    con.register("given", pd.DataFrame({"word": sorted(words)}))
    for word, wanted in con.execute(f"WITH {stems_sql('given')} SELECT word, stem FROM stems").fetchall():
        assert stem(word) == wanted, word


def test_fielded_search_of_an_index_reads_no_texts(spark, saved):
    docs, index = spark.read.parquet(saved + "/documents"), block_index.load(spark, saved + "/index")
    found = bm25.advanced_search(docs.drop("body"), "payment", None, index=index)
    assert ids(found) == ["a"]


def test_scores_that_are_equal_at_nine_places_are_ties(spark):
    """A word of all documents has next to no weight, so a slightly shorter text doesn't come first."""
    docs = docs_of(spark, [("a", "", "word " * 500 + "more"), ("z", "", "word " * 500)])
    index = block_index.build(docs)
    assert ids(bm25.keyword_search(docs, "word", 2, index=index)) == ["a", "z"]
    assert ids(block_index.best(index, query_units("word"), 1, few=0).rows) == ["a"]


def test_no_posting_is_shuffled_by_the_build(spark):
    """Blocks are made where a slot's texts meet: what is stored has no exchange behind it, and blocks are whole."""
    docs = docs_of(spark, ROWS)
    index = block_index.build(docs, slot_docs=3)
    assert "Aggregate" not in index.blocks._jdf.queryExecution().optimizedPlan().toString()
    assert index.blocks.count() == index.blocks.select("term", "slot").distinct().count()
    slow = block_index._blocks(block_index._counted(block_index.postings(docs, 3))).select(*index.blocks.columns)
    assert sorted(map(str, index.blocks.collect())) == sorted(map(str, slow.collect()))
    assert index.lengths.count() == len(ROWS) and block_index.build(docs.limit(0)).blocks.collect() == []
