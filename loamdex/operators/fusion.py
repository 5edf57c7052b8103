"""Rank fusion, reranking, federation, facets, query expansion and personalisation."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import DoubleType

from loamdex.functions.text import recency_decay
from loamdex.operators.filters import RELEVANCE_DISTANCE, relevance_gate

RRF_K, POOL = 60, 200
STATIC_ALPHA, RECENCY_BOOST = 0.1, 0.15
RERANK_POOL = 20
MOST_TERMS = 10
SPACE_BOOST, TAG_BOOST = 1.2, 1.3


def pools(k: int, offset: int = 0) -> tuple[int, int]:
    """Candidates of keyword and of vector search for a page of k."""
    return max(2 * (k + offset), POOL), max(4 * (k + offset), POOL)


def rank_by(hits: DataFrame, *order: Column) -> DataFrame:
    """Adds `rank` from 1; `hits` is a bounded candidate list."""
    return hits.withColumn("rank", F.row_number().over(W.orderBy(*order, F.col("doc_id"))))


def reciprocal_rank_fusion(*lists: DataFrame, k: int = RRF_K) -> DataFrame:
    """(doc_id, rrf) of lists with doc_id and rank: the sum of 1 / (k + rank)."""
    both = None
    for hits in lists:
        part = hits.select("doc_id", (1 / (k + F.col("rank"))).alias("part"))
        both = part if both is None else both.unionByName(part)
    return both.groupBy("doc_id").agg(F.sum("part").alias("rrf"))


def hybrid_search(keyword: DataFrame, vector: DataFrame, docs: DataFrame, k: int = 10, offset: int = 0, as_of: Column | None = None, alpha: float = STATIC_ALPHA, distance: float = RELEVANCE_DISTANCE) -> DataFrame:
    """(rank, doc_id, rrf, score) of a keyword list (doc_id, rank) and a vector list (doc_id, score). Vector hits pass the
    relevance gate first. Rows stand by the boosted fusion score; the displayed score is scaled and adds recency.
    `docs` has doc_id, updated_at, static_score."""
    kept = rank_by(relevance_gate(vector, keyword, distance), F.desc("score"))
    fused = reciprocal_rank_fusion(keyword, kept).join(docs.select("doc_id", "updated_at", F.coalesce("static_score", F.lit(0.0)).alias("static_score")), "doc_id")
    boosted = fused.withColumn("order", -F.col("rrf") * (1 + alpha * F.col("static_score")))
    page = boosted.orderBy("order", "doc_id").offset(offset).limit(k)
    decay = recency_decay(F.col("updated_at"), as_of if as_of is not None else F.current_timestamp())
    score = F.least(F.lit(1.0), F.col("rrf") / (2 / (RRF_K + 1))) * (1 + RECENCY_BOOST * decay) * (1 + alpha * F.col("static_score"))
    return page.select((F.row_number().over(W.orderBy("order", "doc_id")) + offset).alias("rank"), "doc_id", "rrf", score.alias("score"))


#: (query, texts) -> logits
Scorer = Callable[[str, list[str]], Sequence[float]]


def lexical_logit(query: str, text: Column) -> Column:
    """The default scorer as a column: 6 x the part of the query's distinct words that the text has, less 3."""
    import re

    words = list(dict.fromkeys(re.sub(r"[^\w\s]", " ", query.lower()).split()))
    have = F.lit(0)
    held = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}_]+)"))
    for w in words:
        have = have + F.array_contains(held, w).cast("int")
    return have * (6.0 / max(1, len(words))) - 3.0


def model_logit(query: str, text: Column, scorer: Scorer) -> Column:
    """A model's logits, by batches."""

    @F.pandas_udf(DoubleType())
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([float(x) for x in scorer(query, texts.fillna("").tolist())])

    return run(text)


def rerank(hits: DataFrame, query: str, k: int = 10, offset: int = 0, alpha: float = STATIC_ALPHA, scorer: Scorer | None = None) -> DataFrame:
    """(rank, doc_id, score) of candidates (doc_id, title, passage, static_score): the better logit of title and of title
    with passage, to [0, 1] before the static boost, 1 at most."""
    logit = (lambda t: model_logit(query, t, scorer)) if scorer else (lambda t: lexical_logit(query, t))
    best = F.greatest(logit(F.col("title")), logit(F.concat_ws(" ", "title", "passage")))
    scored = hits.withColumn("raw", 1 / (1 + F.exp(-best)) * (1 + alpha * F.coalesce("static_score", F.lit(0.0))))
    page = scored.orderBy(F.desc("raw"), "doc_id").offset(offset).limit(k)
    return page.select((F.row_number().over(W.orderBy(F.desc("raw"), "doc_id")) + offset).alias("rank"), "doc_id", F.least(F.lit(1.0), "raw").alias("score"))


def add_vector_pool(keyword: DataFrame, vector: DataFrame, n: int) -> DataFrame:
    """Up to n vector documents (doc_id, score) that the keyword list hasn't, without score of their own."""
    new = vector.join(keyword.select("doc_id"), "doc_id", "left_anti").orderBy(F.desc("score"), "doc_id").limit(n)
    return keyword.select("doc_id").unionByName(new.select("doc_id"))


def federate(parts: dict[str, DataFrame], per_pool: int) -> DataFrame:
    """(db, doc_id, rank, bm25): the first `per_pool` of each database's list (doc_id, bm25; statistics are its own). An
    id that several have is the first one's."""
    out = None
    for order, (name, hits) in enumerate(parts.items()):
        own = hits.select(F.lit(name).alias("db"), F.lit(order).alias("db_order"), "doc_id", "bm25")
        out = own if out is None else out.unionByName(own)
    ranked = out.withColumn("rank", F.row_number().over(W.partitionBy("db").orderBy("bm25", "doc_id"))).filter(F.col("rank") <= per_pool)
    first = ranked.withColumn("n", F.row_number().over(W.partitionBy("doc_id").orderBy("db_order")))
    return first.filter("n = 1").select("db", "doc_id", "rank", "bm25")


def per_pool(databases: int, k: int, offset: int = 0, pool: int = RERANK_POOL) -> int:
    return max(pool // databases, k + offset)


def facets(hits: DataFrame, columns: Sequence[str] = ("source", "space", "author"), lists: Sequence[str] = ("tags",)) -> DataFrame:
    """(facet, value, n) over the hits' columns and lists."""
    single = [F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns]

    def each(c: str) -> Column:
        return F.transform(F.col(c), lambda x: F.struct(F.lit(c).alias("facet"), x.cast("string").alias("value")))

    many = [each(c) for c in lists]
    rows = F.array(*single) if single else None
    for m in many:
        rows = F.concat(rows, F.coalesce(m, F.array().cast("array<struct<facet:string,value:string>>"))) if rows is not None else m
    return hits.select(F.explode(rows).alias("f")).select("f.*").filter("value IS NOT NULL AND value <> ''").groupBy("facet", "value").agg(F.count("*").alias("n"))


@dataclass(frozen=True)
class Entry:
    """A dictionary entry."""

    term: str
    synonyms: tuple[str, ...] = ()
    domain: str = ""
    scope: str = "global"
    boost: float = 1.0

    def forms(self) -> tuple[str, ...]:
        return (self.term, *self.synonyms)


@dataclass
class Profile:
    user_id: str
    preferred_spaces: list[str] = field(default_factory=list)
    preferred_tags: list[str] = field(default_factory=list)


def merge_dictionaries(general: Sequence[Entry], own: Sequence[Entry]) -> list[Entry]:
    """A user's own entries in place of general ones of the same term."""
    terms = {e.term.lower() for e in own}
    return [e for e in general if e.term.lower() not in terms] + list(own)


def expand(query: str, entries: Sequence[Entry], most: int = MOST_TERMS) -> tuple[str, list[Entry]]:
    """The query followed by terms and synonyms of the entries that a word of it names, and those entries. At most `most`
    different forms, the query's own included."""
    matched: list[Entry] = []
    forms = [query]
    for word in query.split():
        for e in entries:
            if word.lower() in map(str.lower, e.forms()):
                if e not in matched:
                    matched.append(e)
                for f in e.forms():
                    if len(forms) < most and f.lower() not in map(str.lower, forms):
                        forms.append(f)
    return " ".join(forms), matched


def expand_batch(queries: DataFrame, entries: DataFrame, most: int = MOST_TERMS) -> DataFrame:
    """(query_id, expanded) of many queries (query_id, query) by a dictionary table (priority, term, synonyms): an
    equi-join of words and forms. Entries of one word stand by priority."""
    words = queries.select("query_id", F.posexplode(F.split(F.trim("query"), r"\s+")).alias("at", "word")).withColumn("word", F.lower("word"))
    forms = entries.withColumn("forms", F.concat(F.array("term"), F.coalesce("synonyms", F.array().cast("array<string>"))))
    keyed = forms.select("priority", "forms", F.explode(F.array_distinct(F.transform("forms", F.lower))).alias("word"))
    hits = words.join(keyed, "word").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("at", "priority", "forms"))).alias("hits"))
    added = F.flatten(F.transform("hits", lambda h: h["forms"]))
    joined = queries.join(hits, "query_id", "left")
    listed = F.concat(F.array("query"), F.coalesce(added, F.array().cast("array<string>")))
    keep = F.filter(listed, lambda x, i: F.array_position(F.transform(listed, F.lower), F.lower(x)) == i + 1)
    return joined.select("query_id", F.array_join(F.slice(keep, 1, most), " ").alias("expanded"))


def personalize(hits: DataFrame, profile: Profile | None, matched: Sequence[Entry], k: int = 10, offset: int = 0) -> DataFrame:
    """(rank, doc_id, score) of hits (doc_id, score, space, tags, title, body): preferred spaces and tags and the entries
    that a text holds multiply the score. Without profile the order of `rank` stays."""
    if profile is None:
        page = hits.orderBy("rank").offset(offset).limit(k)
        return page.select((F.row_number().over(W.orderBy("rank")) + offset).alias("rank"), "doc_id", "score")
    boost = F.lit(1.0)
    if profile.preferred_spaces:
        boost = boost * F.when(F.col("space").isin(*profile.preferred_spaces), SPACE_BOOST).otherwise(1.0)
    if profile.preferred_tags:
        boost = boost * F.when(F.arrays_overlap("tags", F.array(*map(F.lit, profile.preferred_tags))), TAG_BOOST).otherwise(1.0)
    text = F.lower(F.concat_ws(" ", "title", "body"))
    for e in matched:
        has = F.lit(False)
        for f in e.forms():
            has = has | text.contains(f.lower())
        boost = boost * F.when(has, e.boost).otherwise(1.0)
    scored = hits.withColumn("score", F.col("score") * boost)
    page = scored.orderBy(F.desc("score"), "doc_id").offset(offset).limit(k)
    return page.select((F.row_number().over(W.orderBy(F.desc("score"), "doc_id")) + offset).alias("rank"), "doc_id", "score")


def serialize(hits: DataFrame) -> DataFrame:
    """One JSON text for each hit."""
    return hits.select(F.to_json(F.struct(*hits.columns)).alias("hit"))
