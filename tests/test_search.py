"""Search operators on toy rows, with values computed by hand or by the formula."""

import pytest
from pyspark.sql import functions as F

from loamdex import service
from loamdex.operators import bm25, filters, fusion, graph, index, vector

TOY = [
    ("d1", "apple pie guide", "apple banana running runs the quick brown fox"), ("d2", "other title", "apple apple apple pie banana"), ("d3", "zebra", "cherry only here words"),
    ("d4", "running shoes", "shoes shoes fast"), ("d5", "Écran café", "lorem ipsum dolor"),
]


@pytest.fixture(scope="module")
def toy(spark):
    rows = [(*r, "web", "s", ["t"], ["t"], ["s", r[0]], "Ann", None) for r in TOY]
    docs = spark.createDataFrame(rows, "doc_id string, title string, body string, source string, space string, tags array<string>, categories array<string>, hierarchy array<string>, author string, created_at timestamp")
    return docs.withColumn("updated_at", F.to_timestamp(F.lit("2024-01-01"))).withColumn("static_score", F.lit(0.0))


def values(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]


def test_bm25_values(toy):
    wanted = {"d4": -2.112049642998, "d1": -0.550686745919, "d2": -0.329380315943}
    for scores in (bm25.scan_scores(toy, ["pie", "shoes"]), bm25.index_scores(index.build(toy), ["pie", "shoes"])):
        assert dict(values(scores, "doc_id", "bm25")) == pytest.approx(wanted, abs=1e-9)
    assert dict(values(bm25.scan_scores(toy, ["pie"], "title"), "doc_id", "bm25")) == pytest.approx({"d1": -1.798042038619}, abs=1e-9)
    twice = dict(values(bm25.scan_scores(toy, ["pie", "pie"]), "doc_id", "bm25"))
    once = dict(values(bm25.scan_scores(toy, ["pie"]), "doc_id", "bm25"))
    assert twice == pytest.approx({k: 2 * v for k, v in once.items()})


def test_fielded_search_sums_fields(toy):
    assert values(bm25.advanced_search(toy, "pie", "apple"), "doc_id") == [("d1",)]
    assert values(bm25.advanced_search(toy), "doc_id") == []
    assert values(bm25.advanced_search(toy, where=filters.field_condition(author="ann"), k=2), "doc_id") == [("d1",), ("d2",)]


def test_title_boost_doesnt_change_the_order(toy):
    rows = values(bm25.keyword_search(toy, "pie", as_of=F.to_timestamp(F.lit("2024-01-01"))), "rank", "doc_id", "score")
    assert [r[:2] for r in rows] == [(1, "d1"), (2, "d2")]
    assert rows[0][2] > rows[1][2]


def test_short_words_fall_back_to_like(toy):
    assert values(bm25.keyword_search(toy, "z o"), "doc_id") == [("d3",)]


def test_filters():
    f = filters.build_filter(["nowhere"], date_from="soon")
    assert f.sources == [] and f.date_from is None and f.condition() is None
    assert filters.build_filter(["JIRA", "x"]).sources == ["jira"]


def test_rrf(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "doc_id string, rank int")
    b = spark.createDataFrame([("y", 1)], "doc_id string, rank int")
    assert dict(values(fusion.reciprocal_rank_fusion(a, b), "doc_id", "rrf")) == pytest.approx({"x": 1 / 61, "y": 1 / 62 + 1 / 61})


def test_expand_keeps_order_and_limit():
    entries = [fusion.Entry("k8s", ("kubernetes", "쿠버네티스")), fusion.Entry("db", tuple(f"s{i}" for i in range(20)))]
    text, matched = fusion.expand("Kubernetes db", entries)
    assert text.split()[:4] == ["Kubernetes", "db", "k8s", "kubernetes"] and len(matched) == 2
    assert len(fusion.expand("db x", entries)[0].split()) == 2 + 9
    assert fusion.merge_dictionaries([fusion.Entry("A")], [fusion.Entry("a", ("z",))]) == [fusion.Entry("a", ("z",))]


def test_rerank_with_an_own_scorer(spark):
    hits = spark.createDataFrame([("a", "one", "", 0.0), ("b", "two", "", 0.0)], "doc_id string, title string, passage string, static_score double")
    found = fusion.rerank(hits, "q", scorer=lambda q, texts: [len(t) if "two" in t else -1.0 for t in texts])
    assert values(found, "rank", "doc_id") == [(1, "b"), (2, "a")]


def test_links(spark):
    pages = [("1", "s", "one", ["two", "two", "none"]), ("2", "s", "two", ["two"]), ("3", "t", "two", ["one"]), ("4", "t", "4", ["4", "two"])]
    links = graph.build_links(spark.createDataFrame(pages, "source_id string, space string, title string, outgoing array<string>"))
    assert sorted(values(links, "src", "dst")) == [("1", "2"), ("3", "1"), ("4", "3")]
    edges = spark.createDataFrame([(1, 3), (2, 3), (1, 2)], "src int, dst int")
    assert dict(values(graph.backlinks(edges), "dst", "n")) == {3: 2, 2: 1}


def test_related(toy):
    docs = toy.withColumn("hierarchy", F.when(F.col("doc_id") == "d3", F.array(F.lit("s"))).otherwise(F.array(F.lit("s"), F.col("doc_id"))))
    links = docs.sparkSession.createDataFrame([("d1", "d5")], "src string, dst string")
    assert values(graph.related(docs, links, "d1", 4), "doc_id", "score") == [("d2", 0.9), ("d4", 0.9), ("d5", 0.9), ("d3", 0.7)]
    with pytest.raises(ValueError, match="not_found"):
        graph.related(docs, links, "none")


def test_vectors(spark):
    rows = [(1, 1, [1.0, 0.0]), (2, 1, [0.6, 0.8]), (3, 2, [0.0, 0.0])]
    chunks = spark.createDataFrame(rows, "chunk_id long, doc_id long, vector array<float>")
    hits = vector.search(chunks, vector.literal([1.0, 0.0]), 3)
    assert [(c, round(s, 6)) for c, s in values(hits, "chunk_id", "score")] == [(1, 1.0), (2, 0.6), (3, 0.0)]
    assert sorted(values(vector.best_chunks(hits), "doc_id", "chunk_id")) == [(1, 1), (2, 3)]


def test_service_round_trip(spark, toy, tmp_path):
    service.build(toy, str(tmp_path))
    s = service.Service.open(spark, str(tmp_path), dictionary=[fusion.Entry("sneaker", ("shoes",))])
    hits, facets = s.search("sneaker")
    assert values(hits, "rank", "doc_id") == [(1, "d4")]
    assert values(s.search("fast shoes")[0], "snippet")[0] == ("<b>shoes</b> <b>shoes</b> <b>fast</b>",)
    assert ("source", "web", 1) in values(facets, "facet", "value", "n")
    assert values(s.search("   ")[0], "doc_id") == []
    fused = service.Service.open(spark, str(tmp_path), settings=service.Settings(rerank=False))
    assert values(fused.search("apple pie")[0], "doc_id")[0] == ("d1",)
    assert s.status().first().documents == 5
    with pytest.raises(PermissionError):
        s.reindex(str(tmp_path))


def test_postings_are_read_without_a_join(spark):
    """Only frequencies need one; rows that share a doc_id are one document's, and a body without words has its length alone."""
    rows = [(1, "a_b x", "x y x"), (1, "z z z", "x y"), (2, "", None), (3, "y", "y")]
    built = index.build(spark.createDataFrame(rows, "doc_id int, title string, body string"))
    postings = built.postings.select("term", "doc_id", "tf_title", "tf_body")
    for df in (postings, built.frequencies()):
        assert "Join" not in df._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in postings.collect()} == {("a_b", 1, 1, 0), ("x", 1, 1, 3), ("y", 1, 0, 2), ("z", 1, 3, 0), ("y", 3, 1, 1)}
    frequencies = {tuple(r) for r in built.frequencies().collect()}
    assert frequencies == {("a_b", 1, 1, 0), ("x", 1, 1, 1), ("y", 2, 1, 2), ("z", 1, 1, 0)}
    assert frequencies == {tuple(r) for r in built.postings.select("term", "df", "df_title", "df_body").distinct().collect()}
    assert sorted(tuple(r) for r in built.lengths.collect()) == [(1, 6), (2, 1), (3, 3)]


def test_document_frequencies_write_no_postings(spark, tmp_path, monkeypatch):
    """Nor do they shuffle them, but those of rows that share a doc_id. Words of rows without one are terms of no document."""
    import re

    import duckdb

    from loamdex.plans import registry

    def ids_alone(df, name):
        assert (name, df.columns) == ("shared_ids", ["doc_id"])
        return materialize(df, name)

    materialize = index.materialize
    monkeypatch.setattr(index, "materialize", ids_alone)
    long = "w " * 70 + "tail tail"  # a title of the first 120 characters
    rows = [(1, "a_b x\nx y x"), (2, None), (3, ""), (4, "y"), (5, long), (None, "x lone"), (None, "lone")]
    shared = [(1, "z z\nx"), (1, "q\na_b"), (4, "other\ny y")]
    for name, found, by_document in (("apart", rows, False), ("shared", rows + shared, True)):
        spark.createDataFrame(found, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s")}).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        df = registry.queries()["n10_document_frequencies"](spark, f"{tmp_path}/{name}")
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert ("LeftAnti" in plan) == bool(re.search(r"Exchange hashpartitioning\(term#\d+, doc_id", plan)) == by_document
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/{name}/documents.parquet/*.parquet'")
        wanted = con.execute(registry.oracle_sql()["n10_document_frequencies"]).fetchall()
        assert sorted(tuple(r) for r in df.collect()) == sorted(wanted)
        assert ("lone", 0, 0, 0) in wanted and ("tail", 1, 0, 1) in wanted


def test_stems_go_to_python_in_small_batches(spark):
    docs = spark.createDataFrame([(1, "Écrans", "motoring ponies"), (2, None, "")], "doc_id int, title string, body string")
    df = index.tokenized(docs, stem=True)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan
    assert [tuple(r) for r in df.orderBy("doc_id").collect()] == [(1, ["ecran"], ["motor", "poni"]), (2, [], [])]


def test_scores_apart_by_the_order_of_additions_are_equal(toy, spark, monkeypatch):
    noisy = spark.createDataFrame([("d1", -1.0), ("d2", -1.0000000000000002), ("d4", -2.0)], "doc_id string, bm25 double")
    monkeypatch.setattr(bm25, "index_scores", lambda *a: noisy)
    assert values(bm25.keyword_search(toy, "pie", index=index.build(toy)), "doc_id") == [("d4",), ("d1",), ("d2",)]
