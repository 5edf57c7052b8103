"""Further single operators: joins, scores, snippets, sinks and schema versions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loamdex import corpus
from loamdex.corpus import DOC_SQL, LINK_SQL, LOG_SQL
from loamdex.functions import text as T
from loamdex.operators import bm25, evaluate, fusion, graph, ingest, vector
from loamdex.plans.registry import query
from loamdex.plans.search_queries import BODY_QUERY, QUERY, TOKENS, _distance_sql, bm25_sql
from loamdex.session import read_table, shared_dir
from loamdex.sources import sinks


@query("r2_keyword_score", f"""WITH {DOC_SQL}, {bm25_sql(T.query_terms("thand heon"))} SELECT doc_id, round(1 / (1 + exp(bm25)) * CASE WHEN contains(lower(title), 'thand') AND contains(lower(title), 'heon') THEN 1.5 ELSE 1 END, 6) AS score FROM scored JOIN doc USING (doc_id)""")
def r2(spark: SparkSession, sf: str) -> DataFrame:
    docs = corpus.documents(spark, sf)
    both = F.lower("title").contains("thand") & F.lower("title").contains("heon")
    scored = bm25.scan_scores(docs, ["thand", "heon"]).join(docs.select("doc_id", "title"), "doc_id")
    return scored.select("doc_id", F.round(T.sigmoid(F.col("bm25")) * F.when(both, bm25.TITLE_BOOST).otherwise(1.0), 6).alias("score"))


@query("r3_body_frequencies", f"WITH {DOC_SQL}, {bm25_sql(T.query_terms(BODY_QUERY), 'body')} SELECT doc_id, round(bm25, 6) AS bm25 FROM scored")
def r3_body(spark: SparkSession, sf: str) -> DataFrame:
    scores = bm25.scan_scores(corpus.documents(spark, sf), T.query_terms(BODY_QUERY), "body")
    return scores.select("doc_id", F.round("bm25", 6).alias("bm25"))


@query("r9_rerank_or_fallback", f"""WITH {DOC_SQL}, {bm25_sql(T.query_terms(QUERY))} SELECT row_number() OVER (ORDER BY bm25, doc_id)::INTEGER AS rank, doc_id FROM scored QUALIFY rank <= 10""")
def r9(spark: SparkSession, sf: str) -> DataFrame:
    """A scorer that can't be loaded leaves the keyword order."""

    def load():
        raise ImportError("no model here")

    hits = bm25.ranked(bm25.scan_scores(corpus.documents(spark, sf), T.query_terms(QUERY)), 10)
    try:
        scorer = load()
    except ImportError:
        return hits.select(F.col("rank").cast("int").alias("rank"), "doc_id")
    return fusion.rerank(hits, QUERY, scorer=scorer)


@query("r15_overfetched_slice", f"""WITH {DOC_SQL}, {bm25_sql(T.query_terms(QUERY))}, h AS (SELECT doc_id, row_number() OVER (ORDER BY bm25, doc_id) AS rank FROM scored QUALIFY rank <= 2 * (5 + 3)) SELECT rank::INTEGER AS rank, doc_id FROM h WHERE rank > 3 AND rank <= 8""")
def r15(spark: SparkSession, sf: str) -> DataFrame:
    hits = bm25.ranked(bm25.scan_scores(corpus.documents(spark, sf), T.query_terms(QUERY)), 2 * (5 + 3)).withColumn("score", -F.col("bm25"))
    return fusion.personalize(hits, None, [], 5, 3).select(F.col("rank").cast("int").alias("rank"), "doc_id")


@query("j1_scores_with_documents", f"WITH {DOC_SQL}, {bm25_sql(T.query_terms(QUERY))} SELECT doc_id, title, author FROM scored JOIN doc USING (doc_id)")
def j1(spark: SparkSession, sf: str) -> DataFrame:
    docs = corpus.documents(spark, sf)
    return bm25.scan_scores(docs, T.query_terms(QUERY)).join(docs, "doc_id").select("doc_id", "title", "author")


@query("j2_vectors_with_chunks", "SELECT vec_id AS chunk_id, conv_id, text FROM embeddings JOIN conversations ON conv_id = vec_id AND turn = 0")
def j2(spark: SparkSession, sf: str) -> DataFrame:
    chunks = read_table(spark, sf, "conversations").filter("turn = 0").select(F.col("conv_id").alias("chunk_id"), "conv_id", "text")
    return corpus.chunk_vectors(spark, sf).join(chunks, "chunk_id").select("chunk_id", "conv_id", "text")


@query("j6_orphans", "SELECT vec_id AS chunk_id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 3 = 0)")
def j6(spark: SparkSession, sf: str) -> DataFrame:
    live = corpus.documents(spark, sf).filter("doc_id % 3 = 0").select(F.col("doc_id").alias("chunk_id"))
    return corpus.chunk_vectors(spark, sf).join(live, "chunk_id", "left_anti").select("chunk_id")


@query("j9_hierarchy_pairs", "SELECT a.doc_id AS doc_id, count(*) AS siblings FROM documents a JOIN documents b ON a.source = b.source AND a.lang = b.lang AND a.doc_id <> b.doc_id GROUP BY a.doc_id")
def j9(spark: SparkSession, sf: str) -> DataFrame:
    """Siblings of every document, from the size of its path's group: no pair of documents is made."""
    d = corpus.documents(spark, sf).select("doc_id", F.slice("hierarchy", 1, 2).alias("above"))
    groups = d.groupBy("above").agg(F.count("*").alias("size"))
    return d.join(groups, "above").filter("size > 1").select("doc_id", (F.col("size") - 1).alias("siblings"))


@query("j10_fused_ranks", f"""WITH {DOC_SQL}, {bm25_sql(T.query_terms(QUERY))}, {_distance_sql()}, a AS (SELECT doc_id, row_number() OVER (ORDER BY bm25, doc_id) AS rank FROM scored), v AS (SELECT doc_id, max(score) AS score FROM top WHERE rank <= 100 GROUP BY doc_id),
b AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM v) SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, round(coalesce(1 / (60 + a.rank), 0) + coalesce(1 / (60 + b.rank), 0), 6) AS rrf FROM a FULL JOIN b USING (doc_id)""")
def j10(spark: SparkSession, sf: str) -> DataFrame:
    a = fusion.rank_by(bm25.scan_scores(corpus.documents(spark, sf), T.query_terms(QUERY)), F.col("bm25"))
    near = vector.search(corpus.chunk_vectors(spark, sf), vector.literal(corpus.query_vector(spark, sf)), 100)
    b = fusion.rank_by(vector.best_chunks(near), F.desc("score"))
    return fusion.reciprocal_rank_fusion(a, b).select("doc_id", F.round("rrf", 6).alias("rrf"))


@query("j11_static_or_zero", f"WITH {DOC_SQL}, {bm25_sql(T.query_terms(QUERY))} SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN doc_id / 1000 ELSE 0.0 END::DOUBLE AS static_score FROM scored")
def j11(spark: SparkSession, sf: str) -> DataFrame:
    docs = corpus.documents(spark, sf)
    known = docs.filter("doc_id % 2 = 0").select("doc_id", (F.col("doc_id") / 1000).alias("s"))
    scored = bm25.scan_scores(docs, T.query_terms(QUERY)).join(known, "doc_id", "left")
    return scored.select("doc_id", F.coalesce("s", F.lit(0.0)).alias("static_score"))


@query("j13_user_dictionary", "SELECT * FROM (VALUES ('a', 'general'), ('B', 'own'), ('c', 'own')) t(term, domain)")
def j13(spark: SparkSession, sf: str) -> DataFrame:
    general = spark.createDataFrame([("a", "general"), ("b", "general")], "term string, domain string")
    own = spark.createDataFrame([("B", "own"), ("c", "own")], "term string, domain string")
    return general.join(own.select(F.lower("term").alias("t")), F.lower(general.term) == F.col("t"), "left_anti").unionByName(own)


@query("j15_selections_with_searches", f"WITH {LOG_SQL} SELECT selections.event_id, query, n_results FROM selections JOIN searches USING (search_id)")
def j15(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.selection_log(spark, sf).join(corpus.search_log(spark, sf), "search_id").select("event_id", "query", "n_results")


@query("j17_paired_results", "SELECT a.item_id AS case_id, a.item_id % 2 = 0 AS x, a.item_id % 3 = 0 AS y FROM benchmark a")
def j17(spark: SparkSession, sf: str) -> DataFrame:
    b = read_table(spark, sf, "benchmark").select(F.col("item_id").alias("case_id"))
    return b.withColumn("x", F.col("case_id") % 2 == 0).join(b.withColumn("y", F.col("case_id") % 3 == 0), "case_id")


@query("n17_passages", f"""WITH {DOC_SQL}, t AS (SELECT doc_id, {TOKENS.format("body")} AS ws FROM doc), hit AS (SELECT doc_id, ws, list_position(ws, 'heon') AS p FROM t)
SELECT doc_id, list_aggregate(ws[greatest(1, p - 5):greatest(1, p - 5) + 11], 'string_agg', ' ') AS passage FROM hit WHERE p > 0""")
def n17(spark: SparkSession, sf: str) -> DataFrame:
    """Twelve words around the first match."""
    rows = corpus.documents(spark, sf).select("doc_id", T.tokens(F.col("body")).alias("ws"))
    rows = rows.withColumn("p", F.array_position("ws", "heon").cast("int")).filter("p > 0")
    return rows.select("doc_id", F.array_join(F.slice("ws", F.greatest(F.lit(1), F.col("p") - 5), F.lit(12)), " ").alias("passage"))


@query("e1_candidate_union", f"""WITH {DOC_SQL}, {bm25_sql(T.query_terms(QUERY))}, {_distance_sql()} SELECT * FROM (SELECT doc_id FROM scored ORDER BY bm25, doc_id LIMIT 10) UNION SELECT * FROM (SELECT doc_id FROM top WHERE rank <= 10)""")
def e1(spark: SparkSession, sf: str) -> DataFrame:
    keyword = bm25.ranked(bm25.scan_scores(corpus.documents(spark, sf), T.query_terms(QUERY)), 10).select("doc_id")
    near = vector.search(corpus.chunk_vectors(spark, sf), vector.literal(corpus.query_vector(spark, sf)), 10).select("doc_id")
    return keyword.unionByName(near).distinct()


@query("i6_link_merge_counts", f"WITH {LINK_SQL} SELECT src % 5 AS space, count(*) AS n FROM links GROUP BY ALL")
def i6_counts(spark: SparkSession, sf: str) -> DataFrame:
    return graph.build_links(corpus.link_pages(spark, sf)).groupBy((F.col("src") % 5).alias("space")).agg(F.count("*").alias("n"))


@query("i12_migrated_columns", "SELECT * FROM (VALUES (2, 'doc_id,source,source_id,title,body,content_hash,space,url,author,created_at,updated_at'), (5, 'doc_id,source,source_id,title,body,content_hash,space,url,author,created_at,updated_at,tags,hierarchy,static_score,category,doc_type')) t(version, columns)")
def i12(spark: SparkSession, sf: str) -> DataFrame:
    first = read_table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "source")
    rows = [(sinks.schema_version(t), ",".join(t.columns)) for t in (sinks.migrate(first, 2), sinks.migrate(first))]
    return spark.createDataFrame(rows, "version int, columns string")


@query("z1_documents_by_source", "SELECT doc_id, source FROM documents WHERE source IN ('src1', 'src2')")
def z1(spark: SparkSession, sf: str) -> DataFrame:
    path = f"{shared_dir(spark)}/by-source-{uuid.uuid4().hex}"
    sinks.write_documents(corpus.documents(spark, sf).select("doc_id", "source"), path)
    return spark.read.parquet(path).filter(F.col("source").isin("src1", "src2")).select("doc_id", F.col("source").cast("string").alias("source"))


@query("z2_manifest_lists", "SELECT CASE WHEN page_id % 3 = 0 THEN 'added' WHEN page_id % 3 = 1 THEN 'modified' ELSE 'deleted' END AS op, count(*) AS n FROM pages GROUP BY ALL")
def z2(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.col("page_id") % 3 == 0, "added").when(F.col("page_id") % 3 == 1, "modified").otherwise("deleted")
    rows = read_table(spark, sf, "pages").select(F.col("page_id").cast("string").alias("source_id"), kind.alias("op"))
    return rows.groupBy("op").agg(F.count("*").alias("n"))


@query("z5_json_facets", f"WITH {DOC_SQL} SELECT '{{\"facet\":\"source\",\"value\":\"' || source || '\",\"n\":' || count(*) || '}}' AS hit FROM doc GROUP BY source")
def z5(spark: SparkSession, sf: str) -> DataFrame:
    return fusion.serialize(fusion.facets(corpus.documents(spark, sf), ("source",), ()).select("facet", "value", "n"))


@query("w3_new_since_watermark", f"WITH {DOC_SQL}, w AS (SELECT source, max(updated_at) AS since FROM doc WHERE doc_id % 365 < 200 GROUP BY source) SELECT doc_id FROM doc JOIN w USING (source) WHERE updated_at > since")
def w3(spark: SparkSession, sf: str) -> DataFrame:
    docs = corpus.documents(spark, sf)
    since = ingest.sync_state(docs.filter("doc_id % 365 < 200"), F.lit(None).cast("timestamp")).select("source", "watermark")
    return docs.join(since, "source").filter("updated_at > watermark").select("doc_id")


@query("a16_least_discordant", "SELECT * FROM (VALUES (0.05::DOUBLE, 6), (0.01, 8), (0.001, 11)) t(alpha, pairs)")
def a16_least(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([(a, evaluate.least_discordant(a)) for a in (0.05, 0.01, 0.001)], "alpha double, pairs int")


@query("k3_ordered_page", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R' ORDER BY l_orderkey, l_linenumber LIMIT 20 OFFSET 40")
def k3(spark: SparkSession, sf: str) -> DataFrame:
    rows = read_table(spark, sf, "lineitem").filter("l_returnflag = 'R'")
    return rows.select("l_orderkey", "l_linenumber").orderBy("l_orderkey", "l_linenumber").offset(40).limit(20)


@query("k2_window_ranks", "SELECT o_custkey, o_orderkey, n::INTEGER AS n FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n <= 2")
def k2_orders(spark: SparkSession, sf: str) -> DataFrame:
    n = F.row_number().over(W.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return read_table(spark, sf, "orders").select("o_custkey", "o_orderkey", n.alias("n")).filter("n <= 2")
