"""The search service: one object with the tools of the API, over tables in a folder."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamdex.functions import chunking, markdown
from loamdex.functions.analysis import query_units
from loamdex.functions.text import highlight
from loamdex.operators import block_index, bm25, cell_vectors, filters, fusion, graph, hierarchy, ingest, snapshots, vector
from loamdex.session import materialize
from loamdex.sources import bronze

VERSION = "0.1.0"


@dataclass
class Settings:
    """Settings, from the environment (`LOAMDEX_...`) over a settings file of NAME=value lines."""

    static_alpha: float = fusion.STATIC_ALPHA
    rerank: bool = True
    rerank_pool: int = fusion.RERANK_POOL
    relevance_distance: float = filters.RELEVANCE_DISTANCE
    vector_share: float = cell_vectors.SHARE
    doc_type_rules: str = ""
    auto_dictionary: bool = False
    allow_reindex: bool = False
    search_log: str = ""
    http_token: str = ""

    @classmethod
    def load(cls, file: str | None = None) -> Settings:
        found: dict[str, str] = {}
        if file and os.path.exists(file):
            with open(file, encoding="utf-8") as f:
                for line in f:
                    name, equals, value = line.strip().partition("=")
                    if equals and not name.startswith("#"):
                        found[name.strip()] = value.strip().strip("\"'")
        found |= os.environ
        out = cls()
        for name, kind in cls.__annotations__.items():
            raw = found.get(f"LOAMDEX_{name.upper()}")
            if raw is not None:
                setattr(out, name, raw not in ("0", "false", "") if "bool" in str(kind) else float(raw) if "float" in str(kind) else int(raw) if "int" in str(kind) else raw)
        return out


@dataclass
class Service:
    """`docs` has the columns of `loamdex.operators.ingest.normalize`, or at least doc_id, source, space, title, body, tags,
    categories, hierarchy, author, created_at, updated_at, static_score; `chunks` are vectors by cell, or a table of
    chunk_id, doc_id, vector."""

    docs: DataFrame
    terms: block_index.BlockIndex
    chunks: cell_vectors.CellVectors | DataFrame | None = None
    links: DataFrame | None = None
    tree: DataFrame | None = None
    dictionary: list[fusion.Entry] = field(default_factory=list)
    profiles: dict[str, fusion.Profile] = field(default_factory=dict)
    user_dictionaries: dict[str, list[fusion.Entry]] = field(default_factory=dict)
    settings: Settings = field(default_factory=Settings)
    scorer: fusion.Scorer | None = None
    embed: vector.Embed | None = None
    as_of: Column | None = None
    log: list[dict] = field(default_factory=list)

    @classmethod
    def open(cls, spark: SparkSession, path: str, **more) -> Service:
        """From a folder with documents, index and, where they are, chunks and links."""

        place = places(spark, path)
        table = lambda name: _table(spark, place(name))
        chunks = cell_vectors.load(spark, path) if table("cells") is not None else table("chunks")
        return cls(table("documents"), block_index.load(spark, place("index")), chunks, table("links"), table("tree"), **more)

    def _expanded(self, query: str, user: str | None) -> tuple[str, list[fusion.Entry]]:
        own = self.user_dictionaries.get(user or "", [])
        return fusion.expand(query, fusion.merge_dictionaries(self.dictionary, own))

    def candidates(self, query: str, k: int, offset: int, where: Column | None) -> DataFrame:
        """(doc_id, score, rank): keyword candidates reranked, or keyword and vector lists fused."""
        units = query_units(query)
        kept = self.docs if where is None else self.docs.filter(where)
        allowed = None if where is None else kept
        if self.settings.rerank:
            size = fusion.per_pool(1, k, offset, self.settings.rerank_pool)
            pool = bm25.ranked(block_index.best(self.terms, units, size, allowed).rows, size)
            hits = pool.join(kept, "doc_id").select("doc_id", "title", F.substring("body", 1, 300).alias("passage"), "static_score")
            return fusion.rerank(hits, query, k, offset, self.settings.static_alpha, self.scorer)
        kw, vec = fusion.pools(k, offset)
        keyword = bm25.ranked(block_index.best(self.terms, units, kw, allowed).rows, kw)
        near = keyword.select("doc_id", F.lit(0.0).alias("score")).limit(0)
        if self.chunks is not None:
            own = (self.embed or vector.hashing_embedder())([f"query: {query}"])[0].tolist()
            if isinstance(self.chunks, cell_vectors.CellVectors):
                found = cell_vectors.search(self.chunks, own, vec, share=self.settings.vector_share, among=kept)
            else:
                found = vector.search(self.chunks.join(kept.select("doc_id"), "doc_id", "left_semi"), vector.literal(own), vec)
            near = vector.best_chunks(found)
        return fusion.hybrid_search(keyword, near, self.docs, k, offset, self.as_of, self.settings.static_alpha, self.settings.relevance_distance)

    def search(self, query: str, k: int = 10, offset: int = 0, user: str | None = None, **where) -> tuple[DataFrame, DataFrame]:
        """(hits, facets). Twice the page is fetched, personalised and cut."""
        words = query.strip()
        if not words:
            empty = self.docs.limit(0)
            return empty.select("doc_id", "title"), fusion.facets(empty)
        expanded, matched = self._expanded(words, user)
        condition = filters.build_filter(**where).condition()
        if not query_units(expanded):
            hits = bm25.like_search(self.docs, words, k, offset, condition, self.as_of)
            return hits, fusion.facets(hits.select("doc_id").join(self.docs, "doc_id"))
        found = self.candidates(expanded, 2 * (k + offset), 0, condition).join(self.docs.drop("score"), "doc_id")
        profile = self.profiles.get(user or "")
        page = fusion.personalize(found, profile, matched, k, offset)
        snippet = highlight(F.col("body"), words).alias("snippet")
        shown = page.join(self.docs, "doc_id").select("rank", "doc_id", "title", "source", "space", "author", snippet, "score")
        self.log.append({"query": query, "k": k, "user": user})
        return shown.orderBy("rank"), fusion.facets(found)

    def advanced_search(self, title=None, body=None, k: int = 10, offset: int = 0, **fields) -> DataFrame:
        return bm25.advanced_search(self.docs, title, body, filters.field_condition(**fields), k, offset, self.terms)

    def get_related(self, doc_id, k: int = 10) -> DataFrame:
        links = self.links if self.links is not None else self.docs.select(F.col("doc_id").alias("src"), F.col("doc_id").alias("dst")).limit(0)
        return graph.related(self.docs, links, doc_id, k, self.tree)

    def get_document(self, doc_id, compressed: bool = False, max_tokens: int | None = None) -> DataFrame:
        row = self.docs.filter(F.col("doc_id") == doc_id)
        return row.withColumn("body", markdown.compress(F.col("body"), max_tokens)) if compressed else row

    def browse(self, **args) -> DataFrame:
        return filters.browse(self.docs, **args)

    def list_sources(self) -> DataFrame:
        return self.docs.groupBy("source", "space").agg(F.count("*").alias("n"))

    def status(self) -> DataFrame:
        totals = self.docs.agg(F.count("*").alias("documents"), F.count_distinct("source").alias("sources"))
        return totals.withColumn("version", F.lit(VERSION))

    def reindex(self, path: str) -> None:
        if not self.settings.allow_reindex:
            raise PermissionError("reindexing isn't allowed")
        spark = self.docs.sparkSession
        with ingest.writer_lock(spark, path) as lease:
            change = snapshots.Change(spark, path, lease)
            block_index.save(block_index.build(self.docs), change.folder("index"))
            change.commit()


def build(docs: DataFrame, path: str, as_of: Column | None = None, links: DataFrame | None = None, chunks: DataFrame | None = None) -> None:
    """Writes the tables that `Service.open` reads."""
    counts = graph.backlinks(links) if links is not None else docs.select(F.col("doc_id").alias("dst"), F.lit(0).alias("n")).limit(0)
    scores = graph.static_scores(docs, counts, as_of if as_of is not None else F.current_timestamp())
    docs.drop("static_score").join(scores, "doc_id").write.mode("overwrite").parquet(f"{path}/documents")
    block_index.save(block_index.build(docs), f"{path}/index")
    hierarchy.build(docs, f"{path}/tree")
    if links is not None:
        links.write.mode("overwrite").parquet(f"{path}/links")
    if chunks is not None:
        cell_vectors.build(chunks, path)
    spark = docs.sparkSession
    if snapshots.latest(spark, path).folders:  # what was synced before gives way to these tables
        with ingest.writer_lock(spark, path) as lease:
            change = snapshots.Change(spark, path, lease)
            change.next.folders.clear()
            change.commit()


def places(spark: SparkSession, path: str) -> Callable[[str], str]:
    """Where each table of the folder is now: what its last version names, else what `build` has written."""
    now = snapshots.latest(spark, path)
    return lambda name: now.folder(name) or f"{path}/{name}"


def _table(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None


def sync(spark: SparkSession, kind: str, source: str, path: str, full: bool = False, rules: tuple = (), embed: vector.Embed | None = None) -> dict[str, int]:
    """Reads a source, merges it into the documents at `path`, prunes (in a full run) behind the gate, and brings page
    links, static scores, chunk vectors and the term index up to date; texts that didn't change aren't read again for
    these. Documents, links, index and tree take effect together; vectors are brought up to date just before, so a run that
    dies between leaves vectors of documents that the next run reads again. One writer at a time: raises RuntimeError if another
    one is at work."""
    with ingest.writer_lock(spark, path) as lease:
        return _synced(spark, kind, source, path, full, rules, embed, lease)


def _synced(spark: SparkSession, kind: str, source: str, path: str, full: bool, rules: tuple, embed: vector.Embed | None, lease: ingest.WriterLease) -> dict[str, int]:
    raw = bronze.CONNECTORS[kind](spark, source) if kind != "git" else bronze.repo_files(spark, source, source.rstrip("/").split("/")[-1])
    convert = markdown.html_to_markdown if kind == "confluence" else None
    fresh = ingest.normalize(raw, rules, convert)
    good = fresh.filter("error IS NULL").drop("error").withColumn("categories", F.col("category"))
    place, change = places(spark, path), snapshots.Change(spark, path, lease)
    stored = _table(spark, place("documents"))
    if stored is None:
        stored = good.withColumn("static_score", F.lit(0.0)).limit(0)
    if not good.take(1):
        return {"empty_source": 1}
    merged = materialize(ingest.merge(stored, good.withColumn("static_score", F.lit(0.0))), "merged")
    stats = {r.status: r.n for r in ingest.merge_stats(merged).collect()}
    if full:
        own = F.col("source").isin([r.source for r in good.select("source").distinct().collect()])
        ingest.gate(stored.filter(own).count(), good.count(), full)
        seen = good.select("doc_id").withColumn("seen", F.lit(True))
        merged = merged.join(seen, "doc_id", "left")
        stats["deleted"] = merged.filter(own & F.col("seen").isNull()).count()
        merged = merged.filter(~own | F.col("seen").isNotNull()).drop("seen")
    docs = merged.drop("status")
    changed = merged.filter("status IN ('inserted', 'updated')").drop("status")
    # Links of the pages that were read take the place of their earlier ones; titles are looked for among all documents.
    ids = good.select("doc_id", "source", "source_id")
    out = raw.select("source", "source_id", graph.outgoing_titles(F.col("raw_body")).alias("outgoing")).join(ids, ["source", "source_id"]).select("doc_id", "outgoing")
    pages = docs.select("doc_id", "space", "title").join(out, "doc_id", "left").withColumnRenamed("doc_id", "source_id")
    new, earlier = graph.build_links(pages), _table(spark, place("links"))
    links = new if earlier is None else graph.replace_links(earlier, new, out.select(F.col("doc_id").alias("src")))
    for end in ("src", "dst"):
        links = links.join(docs.select(F.col("doc_id").alias(end)), end, "left_semi")
    links = materialize(links.select("src", "dst"), "links")
    scores = graph.static_scores(docs, graph.backlinks(links), F.current_timestamp())
    pieces = chunking.chunks(changed)
    vectors = materialize(pieces.select("chunk_id", "doc_id", vector.embed_column(F.col("text"), embed).alias("vector")), "chunks")
    # Of documents that changed or left, the chunks go.
    gone = materialize(changed.select("doc_id").unionByName(stored.join(docs.select("doc_id"), "doc_id", "left_anti").select("doc_id")), "gone")
    had = _table(spark, f"{place('index')}/blocks") is not None
    terms = block_index.refresh(block_index.load(spark, place("index")), changed, docs) if had else block_index.build(docs)
    block_index.save(terms, change.folder("index"))
    hierarchy.build(docs, change.folder("tree"))
    graph.update_static(docs, scores).write.parquet(change.folder("documents"))
    links.write.parquet(change.folder("links"))
    lease.check()
    if _table(spark, f"{path}/cells") is None:
        cell_vectors.build(ingest.live_only(vectors, docs), path)
    else:
        cell_vectors.update(spark, path, vectors, gone)
    change.commit()
    return stats


TOOLS = ("search", "advanced_search", "get_related", "get_document", "browse", "list_sources", "status", "reindex")

__all__ = ["TOOLS", "Service", "Settings", "build", "places", "sync"]
