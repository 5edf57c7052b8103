"""Search filters and other predicates."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The kinds of sources.
SOURCE_TYPES = ("confluence", "web", "jira", "gitlab", "github", "bitbucket")

#: Largest cosine distance at which a document found by vectors alone is relevant.
RELEVANCE_DISTANCE = 0.12


@dataclass
class SearchFilter:
    """Conditions that are ANDed; an empty one doesn't filter."""

    sources: list[str] = field(default_factory=list)
    spaces: list[str] = field(default_factory=list)
    tags: list[str] = field(default_factory=list)
    categories: list[str] = field(default_factory=list)
    authors: list[str] = field(default_factory=list)
    date_from: datetime | None = None
    date_to: datetime | None = None

    def condition(self) -> Column | None:
        parts = [F.col(c).isin(*xs) for c, xs in (("source", self.sources), ("space", self.spaces), ("author", self.authors)) if xs]
        parts += [F.coalesce(F.arrays_overlap(F.col(c), F.array(*map(F.lit, xs))), F.lit(False)) for c, xs in (("tags", self.tags), ("categories", self.categories)) if xs]
        at = F.coalesce("updated_at", "created_at")
        if self.date_from is not None:
            parts.append(at >= F.lit(self.date_from))
        if self.date_to is not None:
            parts.append(at <= F.lit(self.date_to))
        out = None
        for p in parts:
            out = p if out is None else out & p
        return out


def build_filter(sources=None, spaces=None, tags=None, categories=None, authors=None, date_from=None, date_to=None) -> SearchFilter:
    """From text arguments: unknown sources are dropped (all unknown: no filter), and dates that can't be read ignored."""

    def date(value):
        try:
            return datetime.fromisoformat(value) if value else None
        except ValueError:
            return None

    known = [s.lower() for s in sources or () if s.lower() in SOURCE_TYPES]
    return SearchFilter(known, list(spaces or ()), list(tags or ()), list(categories or ()), list(authors or ()), date(date_from), date(date_to))


def field_condition(author=None, space=None, doc_type=None, tags=None, categories=None, date_from=None, date_to=None) -> Column | None:
    """The conditions of fielded search: author contains, space and type equal, tags and categories overlap, dates within."""
    parts = []
    if author:
        parts.append(F.lower("author").contains(author.lower()))
    if space:
        parts.append(F.col("space") == space)
    if doc_type:
        parts.append(F.col("doc_type") == doc_type)
    rest = SearchFilter(tags=list(tags or ()), categories=list(categories or ()), date_from=date_from, date_to=date_to).condition()
    if rest is not None:
        parts.append(rest)
    out = None
    for p in parts:
        out = p if out is None else out & p
    return out


def browse(docs: DataFrame, source: str | None = None, space: str | None = None, prefix: str | None = None, k: int = 20, offset: int = 0) -> DataFrame:
    """A page of the documents of a source, a space or with a title prefix, by doc_id."""
    if source:
        docs = docs.filter(F.lower("source") == source.lower())
    if space:
        docs = docs.filter(F.col("space") == space)
    if prefix:
        docs = docs.filter(F.lower("title").startswith(prefix.lower()))
    return docs.orderBy("doc_id").offset(offset).limit(k)


def only_changed(rows: DataFrame, changes: DataFrame, key: str = "source_id") -> DataFrame:
    """Rows whose key is in the change set."""
    return rows.join(changes.select(key).distinct(), key, "left_semi")


def long_documents(docs: DataFrame, least: int = 300) -> DataFrame:
    return docs.filter((F.length("body") >= least) & (F.coalesce("title", F.lit("")) != ""))


def dirty_category(category: Column) -> Column:
    return category.rlike("^[#\"']")


def lost_spaces(expected: DataFrame, accessible: DataFrame) -> DataFrame:
    """Spaces that were expected but can't be accessed."""
    return expected.select("space").distinct().join(accessible.select("space"), "space", "left_anti")


def relevance_gate(vector_hits: DataFrame, keyword_hits: DataFrame, distance: float = RELEVANCE_DISTANCE) -> DataFrame:
    """Vector hits (doc_id, score) without keyword match stay only within the distance."""
    marked = vector_hits.join(keyword_hits.select("doc_id", F.lit(True).alias("matched")), "doc_id", "left")
    return marked.filter(F.col("matched").isNotNull() | (1 - F.col("score") <= distance)).drop("matched")
