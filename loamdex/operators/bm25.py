"""BM25 keyword search and its fielded form."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loamdex.functions.analysis import query_units
from loamdex.functions.text import WORD_CHARS, query_terms, recency_decay, sigmoid, tokens
from loamdex.operators import block_index
from loamdex.operators.block_index import BlockIndex
from loamdex.operators.index import ID_TOKENS, TermIndex

K1, B = 1.2, 0.75
TITLE_WEIGHT, BODY_WEIGHT = 5.0, 1.0
LEAST_IDF = 1e-6
RECENCY_BOOST, TITLE_BOOST = 0.15, 1.5


def _idf(n_docs: Column, df: Column) -> Column:
    return F.greatest(F.log((n_docs - df + 0.5) / (df + 0.5)), F.lit(LEAST_IDF))


def _part(tf: Column, idf: Column, length: Column, average: Column) -> Column:
    return -idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average))


def scan_scores(docs: DataFrame, terms: list[str], field: str | None = None, title_weight: float = TITLE_WEIGHT, body_weight: float = BODY_WEIGHT) -> DataFrame:
    """(doc_id, bm25) of rows that hold a term, without an index: one pass counts the terms of each row, a one-row
    aggregate of that gives document frequencies. A term that the query repeats counts each time. `field` limits
    frequencies to title or body."""
    distinct = list(dict.fromkeys(terms))
    weight = {"title": title_weight * (field != "body"), "body": body_weight * (field != "title")}

    def words(column: str) -> Column:
        """The column's tokens, where it has a term as a substring at all; else nothing is split."""
        low, near = F.lower(F.coalesce(column, F.lit(""))), F.lit(False)
        for t in distinct:
            near = near | low.contains(t)
        return F.when(near, tokens(F.col(column))).otherwise(F.array().cast("array<string>"))

    count = lambda c, t: (F.size(c) - F.size(F.array_remove(c, t))).cast("double")
    length = lambda c: F.regexp_count(F.coalesce(c, F.lit("")), F.lit(f"[{WORD_CHARS}]+"))
    split = docs.select("doc_id", (length("title") + length("body") + ID_TOKENS).alias("length"), words("title").alias("title_tokens"), words("body").alias("body_tokens"))
    tf = [weight["title"] * count("title_tokens", t) + weight["body"] * count("body_tokens", t) for t in distinct]
    # The row number keeps the filter below from being pushed down, which would split the texts again for each condition.
    rows = split.select("doc_id", "length", F.monotonically_increasing_id().alias("row"), *[c.alias(f"tf{i}") for i, c in enumerate(tf)])
    stats = rows.agg(F.count("*").alias("n_docs"), F.avg("length").alias("avg_length"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(distinct))])
    times = Counter(terms)
    score = F.lit(0.0)
    for i, t in enumerate(distinct):
        part = _part(F.col(f"tf{i}"), _idf(F.col("n_docs"), F.col(f"df{i}")), F.col("length"), F.col("avg_length"))
        score = score + times[t] * part
    hit = (F.greatest(*[F.col(f"tf{i}") for i in range(len(distinct))], F.lit(0.0)) > 0) & (F.col("row") >= 0)
    return rows.filter(hit).crossJoin(F.broadcast(stats)).select("doc_id", score.alias("bm25"))  # stats is one row


def index_scores(index: TermIndex, terms: list[str], field: str | None = None, title_weight: float = TITLE_WEIGHT, body_weight: float = BODY_WEIGHT) -> DataFrame:
    """(doc_id, bm25) from a built index. Only the postings of the query's terms are read."""
    times = Counter(terms)
    n_docs, average = index.stats()
    tf = title_weight * (field != "body") * F.col("tf_title") + body_weight * (field != "title") * F.col("tf_body")
    df = F.col({"title": "df_title", "body": "df_body"}.get(field or "", "df"))
    repeat = F.lit(0)
    for t, n in times.items():
        repeat = F.when(F.col("term") == t, n).otherwise(repeat)
    part = repeat * _part(tf, _idf(F.lit(n_docs), df), F.col("length"), F.lit(average))
    return index.postings.filter(F.col("term").isin(*times)).filter(tf > 0).groupBy("doc_id").agg(F.sum(part).alias("bm25"))


def ranked(scores: DataFrame, k: int, offset: int = 0, by: str | Column = "bm25") -> DataFrame:
    """The best rows after `offset`, with `rank` from offset + 1. Ties go to the smaller doc_id."""
    best = scores.orderBy(by, "doc_id").offset(offset).limit(k) if offset else scores.orderBy(by, "doc_id").limit(k)
    return best.withColumn("rank", F.row_number().over(W.orderBy(by, "doc_id")) + offset)  # k rows


def keyword_search(docs: DataFrame, query: str, k: int = 10, offset: int = 0, where: Column | None = None, as_of: Column | None = None, index: TermIndex | BlockIndex | None = None) -> DataFrame:
    """(rank, doc_id, title, bm25, score): rows in the order of BM25. A block index is searched by analysed words (stems,
    folded, phrases) and read only where the best rows may be; a term index and a scan match words as they are. The score adds recency and, where all terms are in
    the title, a boost; it doesn't change the order. Filters apply after the statistics, which cover all documents.
    Without a term of two characters, all words of the query must occur somewhere (`like_search`)."""
    terms = query_terms(query)
    if not terms:
        return like_search(docs, query, k, offset, where, as_of)
    kept = docs if where is None else docs.filter(where)
    if isinstance(index, BlockIndex):
        units = query_units(query)
        if not units:
            return like_search(docs, query, k, offset, where, as_of)
        scores = block_index.best(index, units, k + offset, None if where is None else kept).rows
    else:
        scores = index_scores(index, terms) if index is not None else scan_scores(docs, terms)
    by = block_index.by_score() if index is not None else "bm25"
    hits = ranked(scores.join(kept.select("doc_id", "title", "updated_at"), "doc_id"), k, offset, by)
    in_title = F.lit(True)
    for t in terms:
        in_title = in_title & F.lower("title").contains(t)
    decay = recency_decay(F.col("updated_at"), as_of if as_of is not None else F.current_timestamp())
    score = sigmoid(F.col("bm25")) * (1 + RECENCY_BOOST * decay) * F.when(in_title, TITLE_BOOST).otherwise(1.0)
    return hits.select("rank", "doc_id", "title", "bm25", score.alias("score"))


def like_search(docs: DataFrame, query: str, k: int = 10, offset: int = 0, where: Column | None = None, as_of: Column | None = None) -> DataFrame:
    """Rows whose title or body has every word of the query, by doc_id; the base score is 0.5."""
    import re

    words = re.sub(r"[^\w\s]", " ", query).split()
    kept = docs if where is None else docs.filter(where)
    hit = F.lit(bool(words))
    for w in words:
        hit = hit & (F.lower("title").contains(w.lower()) | F.lower("body").contains(w.lower()))
    hits = kept.filter(hit).orderBy("doc_id").offset(offset).limit(k)
    decay = recency_decay(F.col("updated_at"), as_of if as_of is not None else F.current_timestamp())
    rank = F.row_number().over(W.orderBy("doc_id")) + offset
    return hits.select(rank.alias("rank"), "doc_id", "title", F.lit(None).cast("double").alias("bm25"), (0.5 * (1 + RECENCY_BOOST * decay)).alias("score"))


def advanced_search(docs: DataFrame, title: str | None = None, body: str | None = None, where: Column | None = None, k: int = 10, offset: int = 0, index: BlockIndex | None = None) -> DataFrame:
    """(rank, doc_id, title, score): fields ANDed. Frequencies are those of each field alone, and the parts of both are
    summed. Without title and body terms the newest rows come first; without any condition nothing does. With an index no
    text is read, only the blocks of the terms, and words are analysed."""
    terms_of = query_units if index is not None else query_terms
    fields = {f: terms_of(q) for f, q in (("title", title), ("body", body)) if q}
    fields = {f: terms for f, terms in fields.items() if terms}
    kept = docs if where is None else docs.filter(where)
    if not fields:
        kept = kept if where is not None else kept.limit(0)
        hits = kept.select("doc_id", "title", (-F.unix_micros(F.col("updated_at").cast("timestamp"))).alias("key")).orderBy(F.col("key").asc_nulls_last(), "doc_id").offset(offset).limit(k)
        rank = F.row_number().over(W.orderBy(F.col("key").asc_nulls_last(), "doc_id")) + offset
        return hits.select(rank.alias("rank"), "doc_id", "title", F.lit(1.0).alias("score"))
    scores = None
    for f, terms in fields.items():
        own = scan_scores(docs, terms, f) if index is None else block_index.all_scores(index, terms, f)
        own = own.withColumnRenamed("bm25", f"bm25_{f}")
        scores = own if scores is None else scores.join(own, "doc_id")
    total = sum((F.col(f"bm25_{f}") for f in fields), F.lit(0.0))
    hits = ranked(scores.select("doc_id", total.alias("bm25")).join(kept.select("doc_id", "title"), "doc_id"), k, offset, "bm25" if index is None else block_index.by_score())
    return hits.select("rank", "doc_id", "title", F.lit(1.0).alias("score"))
