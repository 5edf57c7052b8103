"""Chunks, summaries and sections of a body."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

SIZE, OVERLAP = 512, 64


def pack(text: str, size: int = SIZE, overlap: int = OVERLAP) -> list[str]:
    """Paragraphs packed into chunks of `size` characters. A chunk begins with the last paragraphs of the one before,
    as many as fit in `overlap` characters but one at least; a longer paragraph stays whole."""
    chunks: list[str] = []
    now: list[str] = []
    for p in filter(None, map(str.strip, text.split("\n\n"))):
        if now and len("\n\n".join(now)) + 2 + len(p) > size:
            chunks.append("\n\n".join(now))
            keep = now[-1:]
            while len(keep) < len(now) and len("\n\n".join(keep)) + 2 + len(now[-len(keep) - 1]) <= overlap:
                keep = now[-len(keep) - 1 :]
            now = keep
        now = [*now, p]
    return [*chunks, "\n\n".join(now)] if now else chunks


# Plain UDFs, which get 100 rows at a time: a worker holds a few texts and their chunks, however many a task has.
@F.udf(ArrayType(StringType()))
def chunk_texts(text: str | None) -> list[str]:
    return pack(text or "")


def chunks(docs: DataFrame, body: str = "body") -> DataFrame:
    """(chunk_id, doc_id, ordinal, text)."""
    rows = docs.select("doc_id", F.posexplode(chunk_texts(F.col(body))).alias("ordinal", "text"))
    return rows.select(F.concat_ws("#", F.col("doc_id").cast("string"), F.col("ordinal").cast("string")).alias("chunk_id"), "doc_id", "ordinal", "text")


def lead(text: str, limit: int = 280) -> str:
    paragraphs = [p for p in map(str.strip, text.split("\n\n")) if p]
    if not paragraphs:
        return ""
    first = paragraphs[0]
    if len(first) <= limit:
        return first
    out = ""
    for sentence in re.split(r"(?<=[.!?。])\s+", first):
        if len(out) + len(sentence) + 1 > limit:
            break
        out = f"{out} {sentence}".strip()
    return (out or first)[:limit]


@F.udf(StringType())
def _leads(text: str | None) -> str | None:
    return None if text is None else lead(text)


def summary(text: Column, limit: int = 280) -> Column:
    """The first paragraph, or as many of its sentences as fit in 280 characters."""
    first = F.get(F.filter(F.transform(F.split(text, "\n\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != ""), F.lit(0))
    return F.when(first.isNull(), F.lit("")).when(F.length(first) <= limit, first).otherwise(_leads(text))


def sections(docs: DataFrame, body: str = "body", levels: int = 3) -> DataFrame:
    """(doc_id, section, title, text): parts between headings of up to `levels` marks; a text without any is one part
    without title. Parts without title and text are left out, and sections count from 0."""
    from pyspark.sql import Window as W

    lines = docs.select("doc_id", F.posexplode(F.split(F.coalesce(F.col(body), F.lit("")), r"\r?\n")).alias("pos", "line"))
    heading = F.regexp_extract("line", rf"^#{{1,{levels}}}\s+(.*)$", 1)
    marked = lines.withColumn("is_heading", F.col("line").rlike(rf"^#{{1,{levels}}}\s+")).withColumn("heading", heading)
    numbered = marked.withColumn("part", F.sum(F.col("is_heading").cast("int")).over(W.partitionBy("doc_id").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)))
    grouped = numbered.groupBy("doc_id", "part").agg(
        F.max(F.when(F.col("is_heading"), F.trim("heading"))).alias("title"),
        F.array_sort(F.collect_list(F.when(~F.col("is_heading"), F.struct("pos", "line")))).alias("lines"),
    )
    text = F.regexp_replace(F.array_join(F.transform("lines", lambda x: x["line"]), "\n"), r"^\s+|\s+$", "")
    kept = grouped.select("doc_id", "part", "title", text.alias("text")).filter("title IS NOT NULL OR text <> ''")
    return kept.select("doc_id", (F.row_number().over(W.partitionBy("doc_id").orderBy("part")) - 1).alias("section"), "title", "text")
