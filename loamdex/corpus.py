"""The test tables as documents, chunks, links and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamdex.operators import evaluate
from loamdex.session import read_table, spread

#: The date from which ages are counted.
AS_OF = "2024-12-31 00:00:00"


def as_of():
    return F.to_timestamp(F.lit(AS_OF))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, space, title (the first line, 120 characters), body, tags, hierarchy, author, updated_at."""
    d = spread(read_table(spark, sf_dir, "documents"))
    at = F.timestamp_add("DAY", (F.col("doc_id") % 365).cast("int"), F.to_timestamp(F.lit("2024-01-01 00:00:00")))
    return d.select(
        "doc_id", "source", F.col("source").alias("space"), F.substring(F.substring_index("text", "\n", 1), 1, 120).alias("title"), F.col("text").alias("body"), F.array("lang").alias("tags"),
        F.array("source", "lang", F.col("doc_id").cast("string")).alias("hierarchy"), F.array("lang").alias("categories"), F.concat(F.lit("author "), (F.col("doc_id") % 7).cast("string")).alias("author"),
        F.lit(None).cast("timestamp").alias("created_at"), at.alias("updated_at"),
    )


#: `documents` as SQL, for the oracles.
DOC_SQL = """doc AS (SELECT doc_id, source, source AS space, substr(split_part(text, chr(10), 1), 1, 120) AS title, text AS body, lang AS tag, 'author ' || (doc_id % 7) AS author,
 TIMESTAMP '2024-01-01' + (doc_id % 365)::INTEGER * INTERVAL 1 DAY AS updated_at FROM documents)"""


def chunk_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chunk_id, doc_id (chunk_id % 100), vector."""
    e = read_table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("chunk_id"), (F.col("vec_id") % 100).alias("doc_id"), F.col("embedding").alias("vector"))


def query_vector(spark: SparkSession, sf_dir: str, vec_id: int = 0) -> list[float]:
    row = read_table(spark, sf_dir, "embeddings").filter(F.col("vec_id") == vec_id).select("embedding").first()
    return list(row.embedding)


def link_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_id, space (page_id % 5), title (first word of <title>, lower case), outgoing (anchor targets)."""
    from loamdex.operators.graph import anchor_targets

    p = read_table(spark, sf_dir, "pages")
    title = F.lower(F.get(F.split(F.regexp_extract("html", "<title>([^<]*)</title>", 1), " "), F.lit(0)))
    targets = F.transform(anchor_targets(F.col("html")), lambda x: F.lower(F.regexp_replace(x, "^/+", "")))
    return p.select(F.col("page_id").alias("source_id"), (F.col("page_id") % 5).alias("space"), title.alias("title"), targets.alias("outgoing"))


LINK_SQL = """pg AS (SELECT page_id AS source_id, page_id % 5 AS space, lower(split_part(regexp_extract(html, '<title>([^<]*)</title>', 1), ' ', 1)) AS title, html FROM pages),
named AS (SELECT * FROM pg WHERE title <> '' AND title <> source_id::VARCHAR),
here AS (SELECT space, title, min(source_id) AS near FROM named GROUP BY ALL), anywhere AS (SELECT title, min(source_id) AS far FROM named GROUP BY ALL),
outgoing AS (SELECT DISTINCT source_id, space, lower(regexp_replace(x, '^/+', '')) AS t FROM (SELECT source_id, space, unnest(regexp_extract_all(html, '(?i)<a\\s[^>]*href="([^"]*)"', 1)) AS x FROM pg)),
links AS (SELECT DISTINCT source_id AS src, coalesce(near, far) AS dst FROM outgoing LEFT JOIN here ON here.space = outgoing.space AND here.title = t LEFT JOIN anywhere ON anywhere.title = t WHERE coalesce(near, far) <> source_id)"""


def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with sessions: views are searches, clicks and purchases selections."""
    return evaluate.sessions(read_table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", "props"))


def search_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """search_id, ts, session, query (the view's k), n_results, latency_ms."""
    e = event_sessions(spark, sf_dir).filter("event_type = 'view'")
    k = F.get_json_object("props", "$.k").cast("long")
    return e.select(F.col("event_id").alias("search_id"), "ts", "user_id", "session", F.concat(F.lit("q"), (k % 20).cast("string")).alias("query"), (k % 5).alias("n_results"), F.round(F.col("value") * 10).cast("long").alias("latency_ms"))


def selection_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, search_id (the session's last search), doc_id, rank."""
    e = event_sessions(spark, sf_dir)
    picked = evaluate.last_search(e, F.col("event_type") == "view", F.col("event_type").isin("click", "purchase"))
    return picked.select("event_id", "search_id", (F.col("event_id") % 100).alias("doc_id"), (F.col("event_id") % 10 + 1).cast("int").alias("rank"))


LOG_SQL = """e AS (SELECT event_id, ts, user_id, event_type, value, props, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL 12 HOUR THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM e),
searches AS (SELECT event_id AS search_id, ts, user_id, session, 'q' || (json_extract_string(props, '$.k')::BIGINT % 20) AS query, json_extract_string(props, '$.k')::BIGINT % 5 AS n_results, round(value * 10)::BIGINT AS latency_ms FROM s WHERE event_type = 'view'),
marked AS (SELECT *, last_value(CASE WHEN event_type = 'view' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id, session ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS search_id FROM s),
selections AS (SELECT event_id, search_id, event_id % 100 AS doc_id, (event_id % 10 + 1)::INTEGER AS rank FROM marked WHERE event_type IN ('click', 'purchase'))"""


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, doc_id (conversation), text of the conversations' turns."""
    c = read_table(spark, sf_dir, "conversations")
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").alias("doc_id"), "text")
