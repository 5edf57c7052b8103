"""Queries of aggregates, ingest, clustering, evaluation, logs and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamdex import corpus
from loamdex.corpus import DOC_SQL, LOG_SQL, as_of
from loamdex.functions import chunking
from loamdex.functions import text as T
from loamdex.operators import cluster, evaluate, ingest, mining, snapshots, vector
from loamdex.plans.registry import literal, query
from loamdex.session import materialize, read_table, shared_dir
from loamdex.streaming import logs

AS_OF = "TIMESTAMP '2024-12-31'"


def _frame(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, schema)


@query("a1_sources", "SELECT source, lang AS space, count(*) AS n FROM documents GROUP BY ALL")
def a1(spark: SparkSession, sf: str) -> DataFrame:
    d = read_table(spark, sf, "documents")
    return d.groupBy("source", F.col("lang").alias("space")).agg(F.count("*").alias("n"))


@query("a1_suppliers_by_nation", "SELECT r_name, n_name, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def a1_nations(spark: SparkSession, sf: str) -> DataFrame:
    s, n, r = (read_table(spark, sf, t) for t in ("supplier", "nation", "region"))
    return s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).groupBy("r_name", "n_name").agg(F.count("*").alias("n"))


@query("a2_status", "SELECT 'documents' AS name, count(*) AS n FROM documents UNION ALL SELECT 'pages', count(*) FROM pages UNION ALL SELECT 'chunks', count(*) FROM embeddings UNION ALL SELECT 'source:' || source, count(*) FROM documents GROUP BY source")
def a2(spark: SparkSession, sf: str) -> DataFrame:
    count = lambda t, name: read_table(spark, sf, t).agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
    by = read_table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n")).select(F.concat(F.lit("source:"), "source").alias("name"), "n")
    return count("documents", "documents").unionByName(count("pages", "pages")).unionByName(count("embeddings", "chunks")).unionByName(by)


@query("a3_watermarks", f"WITH {DOC_SQL} SELECT source, strftime(max(updated_at), '%Y-%m-%d') AS since FROM doc GROUP BY source")
def a3(spark: SparkSession, sf: str) -> DataFrame:
    return logs.high_watermark(corpus.documents(spark, sf), as_of=as_of()).select("source", F.date_format("since", "yyyy-MM-dd").alias("since"))


@query("a6_category_coverage", "SELECT count(DISTINCT doc_id) AS covered, count(*) AS total, round(count(DISTINCT doc_id) / count(*), 6) AS part FROM (SELECT doc_id % 700 AS doc_id FROM documents)")
def a6(spark: SparkSession, sf: str) -> DataFrame:
    d = read_table(spark, sf, "documents").select((F.col("doc_id") % 700).alias("doc_id"))
    return d.agg(F.count_distinct("doc_id").alias("covered"), F.count("*").alias("total"), F.round(F.count_distinct("doc_id") / F.count("*"), 6).alias("part"))


@query("a7_missing_dates", "SELECT source, count(*) AS n FROM documents WHERE doc_id % 3 = 0 GROUP BY source ORDER BY n DESC, source")
def a7(spark: SparkSession, sf: str) -> DataFrame:
    docs = corpus.documents(spark, sf).withColumn("updated_at", F.when(F.col("doc_id") % 3 != 0, F.col("updated_at")))
    return docs.filter("updated_at IS NULL").groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source")


@query("a8_date_parse_rate", "SELECT count(*) AS seen, count(*) FILTER (doc_id % 4 <> 0) AS parsed, round(count(*) FILTER (doc_id % 4 <> 0) / count(*), 4) AS rate FROM documents WHERE doc_id % 5 <> 0")
def a8(spark: SparkSession, sf: str) -> DataFrame:
    value = F.when(F.col("doc_id") % 5 == 0, F.lit(None)).when(F.col("doc_id") % 4 == 0, "soon").otherwise("2024-01-02T00:00:00+0900")
    return ingest.date_parse_rate(read_table(spark, sf, "documents").select(value.cast("string").alias("updated_at")))


@query("a11_latency", f"WITH {LOG_SQL}, r AS (SELECT latency_ms, row_number() OVER (ORDER BY latency_ms) AS i, count(*) OVER () AS n FROM searches) SELECT any_value(n) AS n, median(latency_ms) AS p50, max(latency_ms) FILTER (i = greatest(floor(n * 0.95), 1)) AS p95 FROM r")
def a11(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.latency(corpus.search_log(spark, sf))


@query("a12_rank_quality", f"WITH {LOG_SQL} SELECT count(*) AS n, round(avg(1.0 / rank), 6) AS mrr, round(count(*) FILTER (rank = 1) / count(*), 6) AS top1 FROM selections")
def a12(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.rank_quality(corpus.selection_log(spark, sf)).select("n", F.round("mrr", 6).alias("mrr"), F.round("top1", 6).alias("top1"))


@query("a12_rank_histogram", f"WITH {LOG_SQL} SELECT rank, count(*) AS n FROM selections GROUP BY rank")
def a12_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.rank_histogram(corpus.selection_log(spark, sf))


@query("a13_abandonment", f"WITH {LOG_SQL}, l AS (SELECT * FROM searches WHERE search_id NOT IN (SELECT search_id FROM selections WHERE search_id IS NOT NULL)) SELECT (SELECT count(*) FROM searches) AS searches, count(*) AS abandoned, count(*) FILTER (n_results = 0) AS empty FROM l")
def a13(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.abandonment(corpus.search_log(spark, sf), corpus.selection_log(spark, sf))


@query("a14_confusion", """WITH k AS (SELECT lang, count(*) FILTER (quality = 1 AND n_chars > 800) AS tp, count(*) FILTER (quality = 0 AND n_chars > 800) AS fp, count(*) FILTER (quality = 0 AND n_chars <= 800) AS tn, count(*) FILTER (quality = 1 AND n_chars <= 800) AS fn FROM documents JOIN labels USING (doc_id) GROUP BY lang)
SELECT lang, tp, fp, tn, fn, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy FROM k""")
def a14(spark: SparkSession, sf: str) -> DataFrame:
    rows = read_table(spark, sf, "documents").join(read_table(spark, sf, "labels"), "doc_id").select("lang", (F.col("quality") == 1).alias("t"), (F.col("n_chars") > 800).alias("s"))
    return mining.confusion(rows, "t", "s", ["lang"]).select("lang", "tp", "fp", "tn", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "accuracy")])


_GOLDEN = "c AS (SELECT item_id AS case_id, text AS expected FROM benchmark), r AS (SELECT item_id AS case_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY doc_id) AS rank, documents.text AS title FROM benchmark JOIN documents ON contains(documents.text, benchmark.text))"


def _golden(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Items of five words or more, and the documents that hold them: both meet by whole words within the item."""
    from pyspark.sql import Window as W

    b, d = read_table(spark, sf, "benchmark"), read_table(spark, sf, "documents")
    parts = lambda text: F.split(text, r"\s+")
    keyed = b.select("item_id", F.col("text").alias("expected"), F.concat_ws(" ", F.slice(parts(F.col("text")), 2, 3)).alias("key"))
    # The words are bound as a variable of their own: as a column they would be split again for each of them.
    keys = F.transform(F.array(parts(F.col("text"))), lambda w: F.array_distinct(F.transform(w, lambda x, i: F.concat_ws(" ", x, F.get(w, i + 1), F.get(w, i + 2)))))
    runs = d.select("doc_id", F.get(keys, F.lit(0)).alias("keys"))
    met = runs.select("doc_id", F.explode("keys").alias("key")).join(keyed, "key").join(d.select("doc_id", "text"), "doc_id").filter(F.expr("contains(text, expected)"))
    results = met.select(F.col("item_id").alias("case_id"), "doc_id", F.col("text").alias("title")).withColumn("rank", F.row_number().over(W.partitionBy("case_id").orderBy("doc_id")))
    return keyed.select(F.col("item_id").alias("case_id"), "expected"), results


@query("a15_golden_ranks", f"WITH {_GOLDEN} SELECT c.case_id, coalesce(min(rank), 0)::INTEGER AS rank FROM c LEFT JOIN r ON r.case_id = c.case_id AND rank <= 5 AND contains(lower(title), lower(expected)) GROUP BY c.case_id")
def a15(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.golden_ranks(*_golden(spark, sf)).select("case_id", F.coalesce(F.col("rank"), F.lit(0)).cast("int").alias("rank"))


@query("m13_hit_rate", f"WITH {_GOLDEN}, g AS (SELECT c.case_id, min(rank) AS rank FROM c LEFT JOIN r ON r.case_id = c.case_id AND rank <= 5 AND contains(lower(title), lower(expected)) GROUP BY c.case_id) SELECT count(*) AS cases, count(rank) AS hits, round(count(rank) / count(*), 6) AS rate FROM g")
def m13(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.hit_rate(evaluate.golden_ranks(*_golden(spark, sf))).select("cases", "hits", F.round("rate", 6).alias("rate"))


_SETTINGS = [(pool, weight) for pool in (1, 3, 20) for weight in (0.0, 0.5)]


@query("m13_sweep", f"""WITH {_GOLDEN}, g AS (SELECT c.case_id, min(rank) AS rank FROM c LEFT JOIN r ON r.case_id = c.case_id AND contains(lower(title), lower(expected)) GROUP BY c.case_id), s AS (SELECT unnest([1, 3, 20]) AS pool), w AS (SELECT unnest([0.0, 0.5]::DOUBLE[]) AS weight)
SELECT pool, weight, count(*) AS cases, count(*) FILTER (rank <= pool) AS hits, round((1 - weight) * avg(CASE WHEN rank <= pool THEN 1 ELSE 0 END) + weight * avg(CASE WHEN rank <= pool THEN 1 / rank ELSE 0 END), 6) AS merit FROM g, s, w GROUP BY pool, weight""")
def m13_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """Every setting is evaluated: hits within its pool, and the weighted mean of hit rate and reciprocal rank."""
    cases, results = _golden(spark, sf)
    ranks = evaluate.golden_ranks(cases, results, 1 << 30)
    both = evaluate.sweep(_frame(spark, "pool int, weight double", _SETTINGS), ranks)
    hit = F.coalesce(F.col("rank") <= F.col("pool"), F.lit(False))
    merit = (1 - F.col("weight")) * F.avg(hit.cast("double")) + F.col("weight") * F.avg(F.when(hit, 1 / F.col("rank")).otherwise(0.0))
    return both.groupBy("pool", "weight").agg(F.count("*").alias("cases"), F.count_if(hit).alias("hits"), F.round(merit, 6).alias("merit"))


@query("a16_mcnemar", """WITH k AS (SELECT lang, count(*) FILTER (a AND NOT b) AS only_a, count(*) FILTER (b AND NOT a) AS only_b FROM (SELECT lang, doc_id % 7 = 0 AS a, doc_id % 11 = 0 AS b FROM documents) GROUP BY lang)
SELECT only_a, only_b, round(least(1, 2 * list_sum(list_transform(range(least(only_a, only_b) + 1), lambda i: exp(lgamma(only_a + only_b + 1) - lgamma(i + 1) - lgamma(only_a + only_b - i + 1) + (only_a + only_b) * ln(0.5))))), 6) AS p FROM (SELECT sum(only_a)::BIGINT AS only_a, sum(only_b)::BIGINT AS only_b FROM k)""")
def a16(spark: SparkSession, sf: str) -> DataFrame:
    d = read_table(spark, sf, "documents").select(F.col("doc_id").alias("case_id"))
    out = evaluate.mcnemar(d.withColumn("hit", F.col("case_id") % 7 == 0), d.withColumn("hit", F.col("case_id") % 11 == 0))
    return out.select("only_a", "only_b", F.round("p", 6).alias("p"))


SEGMENTS = '{"segments":[{"topic":"a","action_items":[{"task":"x"},{"task":"y"}],"contains_decision":false},{"topic":"b","action_items":[],"contains_decision":true}],"sections":[{"title":"s"}]}'


@literal("a19_extraction_counts", "SELECT 3::INTEGER AS segments, ['x', 'y'] AS tasks, true AS decisions")
def a19(spark: SparkSession, sf: str) -> DataFrame:
    kind = "struct<segments:array<struct<topic:string,action_items:array<struct<task:string>>,contains_decision:boolean>>,sections:array<struct<title:string>>>"
    r = _frame(spark, "j string", [(SEGMENTS,)]).select(F.from_json("j", kind).alias("r")).select("r.*")
    tasks = F.flatten(F.transform("segments", lambda s: F.transform(s["action_items"], lambda a: a["task"])))
    return r.select((F.size("segments") + F.size("sections")).alias("segments"), tasks.alias("tasks"), F.exists("segments", lambda s: s["contains_decision"]).alias("decisions"))


@query("m15_golden_from_logs", f"WITH {LOG_SQL}, {DOC_SQL} SELECT query, doc_id, title, count(*) AS n FROM selections JOIN searches USING (search_id) JOIN doc USING (doc_id) GROUP BY ALL HAVING count(*) >= 2")
def m15(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.golden_from_logs(corpus.search_log(spark, sf), corpus.selection_log(spark, sf), corpus.documents(spark, sf), 2)


@query("w7_last_search", f"WITH {LOG_SQL} SELECT event_id, coalesce(search_id, -1) AS search_id FROM selections")
def w7(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.selection_log(spark, sf).select("event_id", F.coalesce("search_id", F.lit(-1)).alias("search_id"))


@query("w8_purged_log", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-20'")
def w8(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.purge(read_table(spark, sf, "events"), F.to_timestamp(F.lit("2024-01-20"))).select("event_id")


@query("s17_log_sessions", f"WITH {LOG_SQL} SELECT user_id, session, count(*) AS n FROM s GROUP BY ALL")
def s17(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.event_sessions(spark, sf).groupBy("user_id", "session").agg(F.count("*").alias("n"))


@query("m16_threads", "SELECT 4 AS threads, 1040.0::DOUBLE AS ms")
def m16(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.pick_threads(_frame(spark, "threads int, ms double", [(1, 3400.0), (2, 1800.0), (4, 1040.0), (8, 1000.0), (16, 1300.0)]))


@query("m16_verdicts", "SELECT 'q' || o_orderpriority AS name, CASE WHEN avg(o_totalprice * CASE WHEN o_orderpriority LIKE '1%' THEN 1.2 WHEN o_orderpriority LIKE '2%' THEN 0.8 ELSE 1.05 END) / avg(o_totalprice) > 1.1 THEN 'worse' WHEN avg(o_totalprice * CASE WHEN o_orderpriority LIKE '1%' THEN 1.2 WHEN o_orderpriority LIKE '2%' THEN 0.8 ELSE 1.05 END) / avg(o_totalprice) < 0.9 THEN 'better' ELSE 'same' END AS verdict FROM orders GROUP BY o_orderpriority")
def m16_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    o = read_table(spark, sf, "orders").withColumn("name", F.concat(F.lit("q"), "o_orderpriority"))
    before = o.groupBy("name").agg(F.avg("o_totalprice").alias("ms"))
    factor = F.when(F.col("name").startswith("q1"), 1.2).when(F.col("name").startswith("q2"), 0.8).otherwise(1.05)
    after = o.groupBy("name").agg(F.avg(F.col("o_totalprice") * factor).alias("ms"))
    return evaluate.regression_verdict(before, after).select("name", "verdict")


# ---- ingest


_STORED = "st AS (SELECT doc_id, source, md5(text) AS content_hash, 0.5 AS static_score, text FROM documents WHERE doc_id % 5 <> 0)"
_NEW = "nw AS (SELECT doc_id, source, md5(text || CASE WHEN doc_id % 7 = 0 THEN 'x' ELSE '' END) AS content_hash, text || CASE WHEN doc_id % 7 = 0 THEN 'x' ELSE '' END AS text FROM documents WHERE doc_id % 3 <> 0)"


def _merge_input(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    d = read_table(spark, sf, "documents")
    stored = d.filter("doc_id % 5 <> 0").select("doc_id", "source", F.md5("text").alias("content_hash"), F.lit(0.5).alias("static_score"), "text")
    text = F.concat("text", F.when(F.col("doc_id") % 7 == 0, "x").otherwise(""))
    return stored, d.filter("doc_id % 3 <> 0").select("doc_id", "source", F.md5(text).alias("content_hash"), text.alias("text"))


@query("i1_merge_status", f"WITH {_STORED}, {_NEW} SELECT coalesce(st.doc_id, nw.doc_id) AS doc_id, CASE WHEN nw.doc_id IS NULL THEN 'kept' WHEN st.doc_id IS NULL THEN 'inserted' WHEN st.content_hash = nw.content_hash THEN 'skipped' ELSE 'updated' END AS status, coalesce(nw.content_hash, st.content_hash) AS content_hash, st.static_score::DOUBLE AS static_score FROM st FULL JOIN nw USING (doc_id)")
def i1(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.merge(*_merge_input(spark, sf)).select("doc_id", "status", "content_hash", "static_score")


_MERGED = f"WITH {_STORED}, {_NEW} SELECT coalesce(nw.doc_id, st.doc_id) AS doc_id, coalesce(nw.source, st.source) AS source, coalesce(nw.content_hash, st.content_hash) AS content_hash, st.static_score::DOUBLE AS static_score, length(coalesce(nw.text, st.text)) AS n_chars FROM st FULL JOIN nw USING (doc_id)"


@query("i1_bucketed_merge", f"{_MERGED} WHERE coalesce(nw.doc_id, st.doc_id) % 10 <> 4")
def i1_bucketed(spark: SparkSession, sf: str) -> DataFrame:
    """The merge as two commits to a table by buckets: all stored rows, then the new ones with some keys taken out."""
    path = f"{shared_dir(spark)}/buckets-{uuid.uuid4().hex}"
    stored, new = _merge_input(spark, sf)
    change = snapshots.Change(spark, path)
    change.put("documents", stored, ["doc_id"], 32)
    change.commit()
    change = snapshots.Change(spark, path)
    change.merge("documents", new, gone=read_table(spark, sf, "documents").filter("doc_id % 10 = 4").select("doc_id"))
    change.commit()
    return snapshots.latest(spark, path).table("documents").select("doc_id", "source", "content_hash", "static_score", F.length("text").cast("long").alias("n_chars"))


@query("i3_merge_stats", f"WITH {_STORED}, {_NEW} SELECT CASE WHEN nw.doc_id IS NULL THEN 'kept' WHEN st.doc_id IS NULL THEN 'inserted' WHEN st.content_hash = nw.content_hash THEN 'skipped' ELSE 'updated' END AS status, count(*) AS n FROM st FULL JOIN nw USING (doc_id) GROUP BY ALL")
def i3(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.merge_stats(ingest.merge(*_merge_input(spark, sf)))


@query("i2_live_chunks", "SELECT vec_id AS chunk_id, vec_id % 100 AS doc_id FROM embeddings WHERE vec_id % 100 IN (SELECT doc_id FROM documents WHERE doc_id % 2 = 0)")
def i2(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.live_only(corpus.chunk_vectors(spark, sf), corpus.documents(spark, sf).filter("doc_id % 2 = 0")).select("chunk_id", "doc_id")


@query("i4_pruned", "SELECT doc_id FROM documents WHERE doc_id % 10 <> 3")
def i4(spark: SparkSession, sf: str) -> DataFrame:
    docs = corpus.documents(spark, sf).select("doc_id")
    return ingest.prune(docs, docs.filter("doc_id % 10 <> 3"))


@query("j5_to_prune", "SELECT doc_id FROM documents WHERE doc_id % 10 = 3")
def j5(spark: SparkSession, sf: str) -> DataFrame:
    docs = corpus.documents(spark, sf)
    return ingest.to_prune(docs, docs.filter("doc_id % 10 <> 3"))


@query("i5_sync_state", f"WITH {DOC_SQL} SELECT source, count(*) AS doc_count, strftime(max(updated_at), '%Y-%m-%d') AS watermark FROM doc GROUP BY source")
def i5(spark: SparkSession, sf: str) -> DataFrame:
    state = ingest.sync_state(corpus.documents(spark, sf), as_of())
    return state.select("source", "doc_count", F.date_format("watermark", "yyyy-MM-dd").alias("watermark"))


RULES = [{"match": {"space": "src1"}, "set": ["first", "en"]}, {"match": {"tag": "de", "hierarchy_prefix": "src2 > de"}, "set": ["german"]}, {"match": {}, "set": ["all"]}]


@query("i9_category_rules", "SELECT doc_id, list_filter(CASE WHEN source = 'src1' THEN CASE WHEN lang = 'en' THEN [lang, 'first', 'all'] ELSE [lang, 'first', 'en', 'all'] END WHEN source = 'src2' AND lang = 'de' THEN ['de', 'german', 'all'] ELSE [lang, 'all'] END, lambda x: true) AS category FROM documents")
def i9(spark: SparkSession, sf: str) -> DataFrame:
    docs = corpus.documents(spark, sf).withColumn("category", F.col("categories"))
    return ingest.category_rules(docs, RULES).select("doc_id", "category")


@query("i10_document_tree", """WITH d AS (SELECT doc_id, doc_id || '#document#0' AS root FROM documents)
SELECT root AS node_id, NULL AS parent_id, 'document' AS level FROM d UNION ALL SELECT doc_id || '#section#0', root, 'section' FROM d UNION ALL SELECT doc_id || '#section#1', root, 'section' FROM d UNION ALL SELECT doc_id || '#0', root, 'chunk' FROM d""")
def i10(spark: SparkSession, sf: str) -> DataFrame:
    docs = corpus.documents(spark, sf).withColumn("body", F.concat(F.lit("x\n# h\n"), "body"))
    # A text without a blank line, as all of the table are, is one chunk, however long.
    return ingest.document_tree(docs, chunking.sections(docs), chunking.chunks(docs)).select("node_id", "parent_id", "level")


@query("i11_replaced_chunks", "SELECT vec_id AS chunk_id, vec_id % 100 AS doc_id FROM embeddings WHERE vec_id % 100 >= 10 UNION ALL SELECT vec_id + 1000000, vec_id % 100 FROM embeddings WHERE vec_id % 100 < 10 AND vec_id < 200")
def i11(spark: SparkSession, sf: str) -> DataFrame:
    chunks = corpus.chunk_vectors(spark, sf).select("chunk_id", "doc_id")
    fresh = chunks.filter("doc_id < 10 AND chunk_id < 200").select((F.col("chunk_id") + 1000000).alias("chunk_id"), "doc_id")
    return ingest.replace_rows(chunks, fresh)


@query("i13_backfills", """SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '2024-03-01' ELSE '2023-01-01' END AS updated_at, CASE WHEN lang = 'en' THEN 'guide' ELSE 'own' END AS doc_type, CASE WHEN lang = 'fr' THEN ['kept'] ELSE [source] END AS category, '(익명)' AS author FROM documents""")
def i13(spark: SparkSession, sf: str) -> DataFrame:
    d = read_table(spark, sf, "documents")
    none = F.lit(None)
    rows = d.select(
        "doc_id", none.cast("timestamp").alias("created_at"), F.when(F.col("doc_id") % 2 == 0, F.to_timestamp(F.lit("2024-03-01"))).alias("updated_at"), F.lit('{"updated":"2023-01-01"}').alias("raw_meta"),
        F.when(F.col("lang") != "en", "own").alias("doc_type"), F.lit("User manual").alias("title"), F.array("source").alias("hierarchy"), F.array().cast("array<string>").alias("tags"),
        F.when(F.col("lang") == "fr", F.array(F.lit("kept"))).otherwise(F.array().cast("array<string>")).alias("category"), F.lit("unknown").alias("author"),
    )
    done = ingest.backfill_authors(ingest.backfill_categories(ingest.backfill_doc_types(ingest.backfill_dates(rows))))
    return done.select("doc_id", F.date_format("updated_at", "yyyy-MM-dd").alias("updated_at"), "doc_type", "category", "author")


@query("e3_distinct_tags", "SELECT DISTINCT source, lang FROM documents")
def e3(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "documents").select("source", "lang").dropDuplicates()


@query("e4_ordered_distinct", "SELECT vec_id, list_filter([vec_id % 3, vec_id % 2, vec_id % 5], lambda x, i: list_position([vec_id % 3, vec_id % 2, vec_id % 5], x) = i) AS xs FROM embeddings")
def e4(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("vec_id")
    return read_table(spark, sf, "embeddings").select("vec_id", F.array_distinct(F.array(v % 3, v % 2, v % 5)).alias("xs"))


@query("e2_stored_minus_seen", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 45 AND NOT l_linestatus = 'O'")
def e2(spark: SparkSession, sf: str) -> DataFrame:
    rows = read_table(spark, sf, "lineitem").filter("l_quantity > 45")
    return rows.select("l_orderkey", "l_linenumber").exceptAll(rows.filter("l_linestatus = 'O'").select("l_orderkey", "l_linenumber"))


# ---- clusters


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    e = read_table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))


_SIMS = """e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings),
x AS (SELECT id, unnest(v) AS x, unnest(range(len(v))) AS i FROM e), m AS (SELECT i, avg(x) AS m FROM x GROUP BY i),
c AS (SELECT id, list(x - m ORDER BY i) AS v FROM x JOIN m USING (i) GROUP BY id), u AS (SELECT id, list_transform(v, lambda y: y / greatest(sqrt(list_dot_product(v, v)), 1e-12)) AS v FROM c),
sims AS (SELECT a.id AS a, b.id AS b, list_dot_product(a.v, b.v) AS sim FROM u a, u b WHERE a.id <> b.id), cut AS (SELECT avg(sim) + stddev_pop(sim) AS cut FROM sims WHERE a < b),
near AS (SELECT a, b, sim FROM sims QUALIFY row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) <= 3),
edges AS (SELECT n.a, n.b FROM near n JOIN near r ON r.a = n.b AND r.b = n.a, cut WHERE n.a < n.b AND n.sim >= cut)"""


@query("j14_all_pairs", f"WITH {_SIMS} SELECT a, count(*) AS n, round(avg(sim), 6) AS mean, round(max(sim), 6) AS best FROM sims GROUP BY a")
def j14(spark: SparkSession, sf: str) -> DataFrame:
    found = cluster.neighbours(cluster.centred(_vectors(spark, sf)), 1, block=128)
    return found.select("a", "n", F.round(F.col("s") / F.col("n"), 6).alias("mean"), F.round(-F.col("near")[0]["d"], 6).alias("best"))


@query("m1_mutual_edges", f"WITH {_SIMS} SELECT a, b FROM edges")
def m1(spark: SparkSession, sf: str) -> DataFrame:
    return cluster.mutual_edges(materialize(cluster.neighbours(cluster.centred(_vectors(spark, sf))), "neighbours"))


@query("m1_clusters", f"""WITH RECURSIVE {_SIMS}, reach(id, label) AS (SELECT id, id FROM e UNION SELECT b, label FROM reach JOIN (SELECT a, b FROM edges UNION ALL SELECT b, a FROM edges) ON a = id),
l AS (SELECT id, min(label) AS label FROM reach GROUP BY id) SELECT id, CASE WHEN count(*) OVER (PARTITION BY label) >= 2 THEN label ELSE -1 END AS cluster FROM l""")
def m1_clusters(spark: SparkSession, sf: str) -> DataFrame:
    rows = _vectors(spark, sf)
    edges = cluster.mutual_edges(materialize(cluster.neighbours(cluster.centred(rows)), "neighbours"))
    return cluster.clusters(rows.select("id"), edges).select("id", F.coalesce("cluster", F.lit(-1)).alias("cluster"))


_UNIT = "u0 AS (SELECT id, label, list_transform(v, lambda y: y / sqrt(list_dot_product(v, v))) AS v FROM (SELECT vec_id AS id, label, embedding::DOUBLE[] AS v FROM embeddings))"
_CENTRE = f"""{_UNIT}, x0 AS (SELECT id, label, unnest(v) AS x, unnest(range(len(v))) AS i FROM u0), g0 AS (SELECT list(m ORDER BY i) AS g FROM (SELECT i, avg(x) AS m FROM x0 GROUP BY i)),
s0 AS (SELECT id, list_dot_product(v, g) / sqrt(list_dot_product(g, g)) AS s FROM u0, g0), q0 AS (SELECT quantile_cont(s, 0.2) AS q FROM s0), k0 AS (SELECT id FROM s0, q0 WHERE s >= q),
g1 AS (SELECT list(m ORDER BY i) AS g FROM (SELECT i, avg(x) AS m FROM x0 WHERE id IN (SELECT id FROM k0) GROUP BY i)), g2 AS (SELECT list_transform(g, lambda y: y / sqrt(list_dot_product(g, g))) AS g FROM g1)"""


def _units(spark: SparkSession, sf: str) -> DataFrame:
    e = read_table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("id"), "label", cluster.unit(F.col("embedding")).alias("v"))


@query("m2_robust_centroid", f"WITH {_CENTRE} SELECT i::INTEGER AS i, round(x, 6) AS x FROM (SELECT unnest(g) AS x, unnest(range(len(g))) AS i FROM g2)")
def m2(spark: SparkSession, sf: str) -> DataFrame:
    return cluster.robust_centroid(_units(spark, sf).select("id", "v")).select(F.posexplode("g").alias("i", "x")).select("i", F.round("x", 6).alias("x"))


@query("m3_off_topic", f"""WITH {_CENTRE}, cc AS (SELECT label, list(m ORDER BY i) AS c FROM (SELECT label, i, avg(x) AS m FROM x0 GROUP BY ALL) GROUP BY label), af AS (SELECT label, list_dot_product(c, g) / sqrt(list_dot_product(c, c)) AS affinity FROM cc, g2),
ct AS (SELECT avg(affinity) - stddev_pop(affinity) AS cut, count(*) AS n FROM af) SELECT label AS cluster, round(affinity, 6) AS affinity, n >= 3 AND affinity < cut AS off_topic FROM af, ct""")
def m3(spark: SparkSession, sf: str) -> DataFrame:
    rows = _units(spark, sf)
    out = cluster.off_topic(rows.select("id", "v"), rows.select("id", F.col("label").alias("cluster")))
    return out.select("cluster", F.round("affinity", 6).alias("affinity"), "off_topic")


@query("a17_doc_support", "SELECT turn AS cluster, count(DISTINCT conv_id) AS support FROM conversations GROUP BY turn")
def a17(spark: SparkSession, sf: str) -> DataFrame:
    p = corpus.passages(spark, sf)
    return cluster.doc_support(p.select("id", (F.col("id") % 1000).alias("cluster")), p.select("id", "doc_id"))


_CLUSTER_WORDS = "regexp_replace(regexp_replace(text, '[^\\p{L}\\p{N}_\\s]', ' ', 'g'), '\\s+', ' ', 'g')"


@query("a18_key_words", f"""WITH w AS (SELECT role AS cluster, unnest(string_split({_CLUSTER_WORDS}, ' ')) AS term FROM conversations), tf AS (SELECT cluster, term, count(*) AS tf FROM w WHERE length(term) >= 2 GROUP BY ALL),
f AS (SELECT term, sum(tf) AS f FROM tf GROUP BY term), a AS (SELECT sum(tf) / count(DISTINCT cluster) AS a FROM tf)
SELECT cluster, rank::INTEGER AS rank, term, round(weight, 6) AS weight FROM (SELECT cluster, term, tf * ln(1 + a / f) AS weight, row_number() OVER (PARTITION BY cluster ORDER BY round(tf * ln(1 + a / f), 9) DESC, term) AS rank FROM tf JOIN f USING (term), a) WHERE rank <= 6""")
def a18(spark: SparkSession, sf: str) -> DataFrame:
    rows = read_table(spark, sf, "conversations").select(F.col("role").alias("cluster"), "text")
    return cluster.key_words(rows).select("cluster", F.col("rank").cast("int").alias("rank"), "term", F.round("weight", 6).alias("weight"))


@query("m4_topics", None)
def m4(spark: SparkSession, sf: str) -> DataFrame:
    p = corpus.passages(spark, sf)
    rows = p.select("id", "doc_id", "text", vector.embed_column(F.col("text"), vector.hashing_embedder(64)).alias("v"))
    return cluster.analyze(materialize(rows, "topics"))["topics"]


@query("m5_extraction", None)
def m5(spark: SparkSession, sf: str) -> DataFrame:
    from loamdex.operators import extract

    c = read_table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda t: F.concat(t["role"], F.lit(": "), t["text"])), "\n").alias("body"))
    return extract.extract(c.withColumnRenamed("conv_id", "doc_id"))


# ---- streams, against their batch twins


def _events(spark: SparkSession, sf: str) -> DataFrame:
    path = f"{sf}/events.parquet"
    return logs.read_events(spark, path, spark.read.parquet(path).schema)


def _checkpoint(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


@query("w6_tumbling_windows", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, event_type, count(*) AS n FROM events GROUP BY ALL")
def w6(spark: SparkSession, sf: str) -> DataFrame:
    counted = logs.window_counts(read_table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return counted.select(F.date_format("start", "yyyy-MM-dd HH").alias("hour"), "event_type", "n")


@query("w6_sliding_windows", "SELECT strftime(date_trunc('hour', ts) - o * INTERVAL 1 HOUR, '%Y-%m-%d %H') AS hour, event_type, count(*) AS n FROM events, (SELECT unnest([0, 1]) AS o) GROUP BY ALL")
def w6_sliding(spark: SparkSession, sf: str) -> DataFrame:
    counted = logs.window_counts(read_table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")), "2 hours", "1 hour")
    return counted.select(F.date_format("start", "yyyy-MM-dd HH").alias("hour"), "event_type", "n")


@query("w6_session_windows", f"WITH {LOG_SQL.replace('> INTERVAL 12 HOUR', '>= INTERVAL 12 HOUR')} SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, session")
def w6_sessions(spark: SparkSession, sf: str) -> DataFrame:
    counted = logs.session_counts(read_table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return counted.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


def _stream_path(spark: SparkSession, sf: str) -> str:
    """A folder of event files for the file stream, which reads folders only."""
    path = f"{shared_dir(spark)}/events-{uuid.uuid4().hex}"
    read_table(spark, sf, "events").write.parquet(path)
    return path


def _stream(spark: SparkSession, sf: str, make, mode: str) -> DataFrame:
    path = _stream_path(spark, sf)
    out = f"{shared_dir(spark)}/out-{uuid.uuid4().hex}"
    stream = make(logs.read_events(spark, path))

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(out)

    stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", _checkpoint(spark)).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


@query("w1_stream_windows", "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def w1(spark: SparkSession, sf: str) -> DataFrame:
    rows = _stream(spark, sf, lambda e: logs.window_counts(e, "1 day"), "complete")
    return rows.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")


@query("w5_stream_distinct", "SELECT DISTINCT user_id, event_type FROM events")
def w5(spark: SparkSession, sf: str) -> DataFrame:
    return _stream(spark, sf, lambda e: logs.deduplicated(e, ["user_id", "event_type"], "60 days"), "append").select("user_id", "event_type")


@query("w7_stream_last_search", f"WITH {LOG_SQL} SELECT event_id, coalesce(search_id, -1) AS search_id FROM selections")
def w7_stream(spark: SparkSession, sf: str) -> DataFrame:
    return _stream(spark, sf, logs.link_selections, "append").select("event_id", F.coalesce("search_id", F.lit(-1)).alias("search_id"))


@query("w4_stream_merge", "SELECT doc_id, md5(text || CASE WHEN doc_id % 7 = 0 AND doc_id % 3 <> 0 THEN 'x' ELSE '' END) AS content_hash FROM documents WHERE doc_id % 5 <> 0 OR doc_id % 3 <> 0")
def w4(spark: SparkSession, sf: str) -> DataFrame:
    stored, new = _merge_input(spark, sf)
    table, changes = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}", f"{shared_dir(spark)}/changes-{uuid.uuid4().hex}"
    stored.write.parquet(table)
    new.withColumn("updated_at", as_of()).write.parquet(changes)
    stream = spark.readStream.schema(spark.read.parquet(changes).schema).parquet(changes)
    run = stream.writeStream.foreachBatch(logs.merge_into(table)).option("checkpointLocation", _checkpoint(spark)).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(table).select("doc_id", "content_hash")
