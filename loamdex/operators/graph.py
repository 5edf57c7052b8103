"""Links between documents, their counts, static quality scores and related documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loamdex.operators import hierarchy

MOST_CHARS, MOST_HEADINGS, HALF_LIFE = 50_000, 50, 180.0
SIBLING, PARENT, LINKED = 0.9, 0.7, 0.5


def outgoing_titles(html: Column) -> Column:
    """Titles that a storage-format body links to, repeats included."""
    links = F.regexp_extract_all(html, F.lit(r"(?is)(<ac:link[^>]*>.*?</ac:link>)"))
    titles = F.transform(links, lambda x: F.trim(F.regexp_extract(x, r'(?is)<ri:page[^>]*ri:content-title="([^"]*)"', 1)))
    return F.filter(titles, lambda x: x != "")


def anchor_targets(html: Column) -> Column:
    """Targets of ordinary links."""
    return F.regexp_extract_all(html, F.lit(r'(?i)<a\s[^>]*href="([^"]*)"'))


def build_links(pages: DataFrame) -> DataFrame:
    """(src, dst), distinct. `pages` has source_id, space, title, outgoing (titles). A title is looked for in the same
    space and else everywhere; of pages with one title the first (by source_id) counts. Titles that are ids name no
    page, and a page doesn't link to itself."""
    named = pages.filter("title IS NOT NULL AND title <> '' AND title <> CAST(source_id AS STRING)")
    here = named.groupBy(F.col("space"), F.col("title").alias("to")).agg(F.min("source_id").alias("near"))
    anywhere = named.groupBy(F.col("title").alias("to")).agg(F.min("source_id").alias("far"))
    out = pages.select("source_id", "space", F.explode("outgoing").alias("to")).distinct()
    found = out.join(here, ["space", "to"], "left").join(anywhere, "to", "left").select(F.col("source_id").alias("src"), F.coalesce("near", "far").alias("dst"))
    return found.filter("dst IS NOT NULL AND dst <> src").distinct()


def replace_links(stored: DataFrame, new: DataFrame, owners: DataFrame) -> DataFrame:
    """The stored links with those of the owners (src) replaced."""
    return stored.join(owners.select("src").distinct(), "src", "left_anti").unionByName(new.join(owners.select("src").distinct(), "src", "left_semi"))


def backlinks(links: DataFrame) -> DataFrame:
    return links.groupBy("dst").agg(F.count("*").alias("n"))


def static_scores(docs: DataFrame, counts: DataFrame, as_of: Column) -> DataFrame:
    """(doc_id, static_score) from recency, richness of the body and backlinks (dst, n), within [0, 1]."""
    days = F.greatest(F.lit(0.0), (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col("updated_at").cast("timestamp"))) / 86_400_000_000)
    recency = F.coalesce(F.pow(F.lit(0.5), days / HALF_LIFE), F.lit(0.3))
    headings = F.size(F.filter(F.split("body", "\n"), lambda x: x.startswith("#")))
    saturated = lambda c, most: F.log1p(F.least(c, F.lit(most)).cast("double")) / F.log1p(F.lit(float(most)))
    richness = 0.7 * saturated(F.length("body"), MOST_CHARS) + 0.3 * saturated(headings, MOST_HEADINGS)
    most = counts.agg(F.greatest(F.coalesce(F.max("n"), F.lit(1)), F.lit(1)).alias("most"))
    rows = docs.join(counts.select(F.col("dst").alias("doc_id"), "n"), "doc_id", "left").crossJoin(F.broadcast(most))  # most is one row
    central = F.log1p(F.coalesce("n", F.lit(0)).cast("double")) / F.log1p(F.col("most").cast("double"))
    return rows.select("doc_id", F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.3 * recency + 0.3 * richness + 0.4 * central)).alias("static_score"))


def update_static(docs: DataFrame, scores: DataFrame) -> DataFrame:
    """Documents with new scores where there are any."""
    fresh = scores.select("doc_id", F.col("static_score").alias("fresh"))
    return docs.join(fresh, "doc_id", "left").withColumn("static_score", F.coalesce("fresh", "static_score")).drop("fresh")


def linked(links: DataFrame, doc: Column, k: int) -> DataFrame:
    """(doc_id): documents that `doc` links to, then those that link to it, k of each at most, each once."""
    out = links.filter(F.col("src") == doc).select(F.col("dst").alias("doc_id"), F.lit(0).alias("way")).orderBy("doc_id").limit(k)
    back = links.filter(F.col("dst") == doc).select(F.col("src").alias("doc_id"), F.lit(1).alias("way")).orderBy("doc_id").limit(k)
    return out.unionByName(back).groupBy("doc_id").agg(F.min("way").alias("way"))


def related(docs: DataFrame, links: DataFrame, doc_id, k: int = 10, tree: DataFrame | None = None) -> DataFrame:
    """(rank, doc_id, score): siblings in the hierarchy, the parents, then linked documents. `docs` has doc_id, source,
    hierarchy. With a `tree` (`hierarchy.place`) one range of it is read instead of all paths. Raises ValueError if the
    document isn't there."""
    own = docs.filter(F.col("doc_id") == doc_id).select("source", "hierarchy").first()
    if own is None:
        raise ValueError(f"not_found: document {doc_id}")
    found = linked(links, F.lit(doc_id), k).select("doc_id", F.lit(LINKED).alias("score")).join(docs.select("doc_id"), "doc_id", "left_semi")
    path = [str(x) for x in own.hierarchy or []]
    if tree is not None:
        near = hierarchy.relatives(tree, doc_id, SIBLING, PARENT)
        if near is not None:
            found = found.unionByName(near.orderBy(F.desc("score"), "doc_id").limit(k))
    elif len(path) >= 2:
        above = F.array(*map(F.lit, path[:-1]))
        h = F.transform("hierarchy", lambda x: x.cast("string"))
        sibling = (F.size(h) == len(path)) & (F.slice(h, 1, len(path) - 1) == above)
        near = docs.filter((F.col("source") == own.source) & (F.col("doc_id") != doc_id))
        near = near.select("doc_id", F.when(sibling, F.lit(SIBLING)).when(h == above, F.lit(PARENT)).alias("score")).filter("score IS NOT NULL")
        found = found.unionByName(near.orderBy(F.desc("score"), "doc_id").limit(k))
    best = found.filter(F.col("doc_id") != doc_id).groupBy("doc_id").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "doc_id").limit(k)
    return best.select(F.row_number().over(W.orderBy(F.desc("score"), "doc_id")).alias("rank"), "doc_id", "score")
