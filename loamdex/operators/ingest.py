"""Ingest: document rows from raw records, merge, prune with a safety gate, state, trees and backfills."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loamdex.functions import text as T
from loamdex.functions.chunking import summary

GATE_LEAST, GATE_PART = 5, 0.5


class SafetyGateError(RuntimeError):
    """A prune that would delete too much."""


def normalize(raw: DataFrame, rules: tuple = (), convert=None) -> DataFrame:
    """Document rows from raw records (source, source_id, raw_body, title, url, space, author, created_at, updated_at,
    tags, hierarchy, category, doc_type). `convert` makes Markdown of the body. Rows without body get an `error`."""
    body = convert(F.col("raw_body")) if convert else F.col("raw_body")
    none = F.array().cast("array<string>")
    tags, hierarchy = F.array_distinct(F.coalesce("tags", none)), F.coalesce("hierarchy", none)
    category = F.array_distinct(F.filter(F.transform(F.coalesce("category", none), T.normalize_category), lambda c: c != ""))
    out = raw.select(
        T.doc_id(F.col("source"), F.col("source_id")).alias("doc_id"), "source", "source_id", F.col("space"), F.coalesce("title", "source_id").alias("title"),
        body.alias("body"), "url", tags.alias("tags"), hierarchy.alias("hierarchy"),
        F.when(F.size(category) > 0, category).otherwise(hierarchy).alias("category"),
        T.normalize_author(F.col("author")).alias("author"),
        F.coalesce("doc_type", T.doc_type(F.col("title"), hierarchy, tags, rules)).alias("doc_type"),
        T.parse_iso8601(F.col("created_at")).alias("created_at"), T.parse_iso8601(F.col("updated_at")).alias("updated_at"),
        F.when(F.col("raw_body").isNull(), F.lit("no body")).alias("error"),
    )
    return out.withColumn("content_hash", T.content_hash(F.col("title"), F.coalesce("body", F.lit("")), F.col("tags"), F.col("hierarchy")))


def date_parse_rate(raw: DataFrame) -> DataFrame:
    """seen, parsed, rate of update dates that are there."""
    given = F.col("updated_at").isNotNull()
    parsed = T.parse_iso8601(F.col("updated_at")).isNotNull()
    out = raw.agg(F.count_if(given).alias("seen"), F.count_if(parsed).alias("parsed"))
    return out.select("seen", "parsed", F.when(F.col("seen") > 0, F.round(F.col("parsed") / F.col("seen"), 4)).alias("rate"))


def merge(stored: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("doc_id",), force: bool = False, keep: tuple[str, ...] = ("static_score",)) -> DataFrame:
    """All rows after the merge with their status: inserted, updated, skipped (equal content_hash) or kept (not in `new`).
    Updated rows keep the stored `keep` columns."""
    left = stored.select(*[F.col(c).alias(f"old_{c}") for c in stored.columns])
    on = None
    for c in keys:
        part = F.col(f"old_{c}") == F.col(c)
        on = part if on is None else on & part
    joined = left.join(new, on, "full_outer")
    is_new, is_old = F.col(keys[0]).isNotNull(), F.col(f"old_{keys[0]}").isNotNull()
    same = F.col("content_hash") == F.col("old_content_hash")
    status = F.when(~is_new, "kept").when(~is_old, "inserted").when(same & F.lit(not force), "skipped").otherwise("updated")
    use_new = status.isin("inserted", "updated")
    columns = []
    for c in stored.columns:
        if c in keep or c not in new.columns:
            columns.append((F.coalesce(f"old_{c}", c) if c in new.columns else F.col(f"old_{c}")).alias(c))
        else:
            columns.append(F.when(use_new, F.col(c)).otherwise(F.col(f"old_{c}")).alias(c))
    return joined.select(*columns, status.alias("status"))


def merge_stats(merged: DataFrame) -> DataFrame:
    return merged.groupBy("status").agg(F.count("*").alias("n"))


def to_prune(stored: DataFrame, seen: DataFrame, key: str = "doc_id") -> DataFrame:
    return stored.select(key).join(seen.select(key).distinct(), key, "left_anti")


def gate(previous: int, seen: int, full: bool = False) -> None:
    """Raises if nothing was seen, or less than half of more than five, unless the run is a full one and saw something."""
    if seen == 0 and previous > 0:
        raise SafetyGateError("nothing was seen")
    if not full and previous > GATE_LEAST and seen < GATE_PART * previous:
        raise SafetyGateError(f"{seen} of {previous} documents were seen")


def prune(stored: DataFrame, seen: DataFrame, key: str = "doc_id", full: bool = False) -> DataFrame:
    """The stored rows that were seen, once the gate is passed."""
    gate(stored.select(key).distinct().count(), seen.select(key).distinct().count(), full)
    return stored.join(seen.select(key).distinct(), key, "left_semi")


def live_only(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """Dependent rows (chunks, tree nodes, links) of documents that are still there."""
    return rows.join(docs.select("doc_id"), "doc_id", "left_semi")


def replace_rows(stored: DataFrame, new: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of the keys in `new` are replaced by them."""
    return stored.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def sync_state(docs: DataFrame, at: Column) -> DataFrame:
    """(source, last_synced_at, doc_count, watermark)."""
    return docs.groupBy("source").agg(F.max(at).alias("last_synced_at"), F.count("*").alias("doc_count"), F.max("updated_at").alias("watermark"))


def category_rules(docs: DataFrame, rules: list[dict]) -> DataFrame:
    """Adds the categories of each rule {match: {space, tag, hierarchy_prefix}, set: [...]} whose conditions all hold."""
    out = F.coalesce("category", F.array().cast("array<string>"))
    path = F.array_join("hierarchy", " > ")
    for rule in rules:
        match, ok = rule.get("match", {}), F.lit(True)
        if "space" in match:
            ok = ok & F.coalesce(F.col("space") == match["space"], F.lit(False))
        if "tag" in match:
            ok = ok & F.coalesce(F.array_contains("tags", match["tag"]), F.lit(False))
        if "hierarchy_prefix" in match:
            ok = ok & F.coalesce(path.startswith(match["hierarchy_prefix"]), F.lit(False))
        out = F.concat(out, F.when(ok, F.array(*map(F.lit, rule.get("set", [])))).otherwise(F.array().cast("array<string>")))
    return docs.withColumn("category", F.array_distinct(out))


def document_tree(docs: DataFrame, sections: DataFrame, chunks: DataFrame) -> DataFrame:
    """(node_id, parent_id, doc_id, level, title, summary, path): a document node, and its sections and chunks below."""
    name = F.col("doc_id").cast("string")
    root = F.concat(name, F.lit("#document#0"))
    d = docs.select(root.alias("node_id"), F.lit(None).cast("string").alias("parent_id"), "doc_id", F.lit("document").alias("level"), "title", summary(F.col("body")).alias("summary"), name.alias("path"))
    number = F.col("section").cast("string")
    s = sections.select(
        F.concat(name, F.lit("#section#"), number).alias("node_id"), root.alias("parent_id"), "doc_id", F.lit("section").alias("level"),
        F.coalesce("title", F.concat(F.lit("(section "), number, F.lit(")"))).alias("title"), summary(F.col("text")).alias("summary"), F.concat(name, F.lit("#sec"), number).alias("path"),
    )
    c = chunks.select(
        F.col("chunk_id").alias("node_id"), root.alias("parent_id"), "doc_id", F.lit("chunk").alias("level"),
        F.concat(F.lit("chunk "), F.col("ordinal").cast("string")).alias("title"), F.lit(None).cast("string").alias("summary"), F.col("chunk_id").alias("path"),
    )
    return d.unionByName(s).unionByName(c)


def backfill_dates(docs: DataFrame) -> DataFrame:
    """Dates that are missing, from the raw metadata (JSON); running it again changes nothing."""
    of = lambda *names: F.coalesce(*[T.parse_iso8601(F.get_json_object("raw_meta", f"$.{n}")) for n in names])
    return docs.withColumns({"created_at": F.coalesce("created_at", of("created_at", "created", "createdAt")), "updated_at": F.coalesce("updated_at", of("updated_at", "updated", "updatedAt", "lastModified"))})


def backfill_doc_types(docs: DataFrame, rules: tuple = ()) -> DataFrame:
    return docs.withColumn("doc_type", F.coalesce("doc_type", T.doc_type(F.col("title"), F.col("hierarchy"), F.col("tags"), rules)))


def backfill_categories(docs: DataFrame) -> DataFrame:
    empty = F.coalesce(F.size("category"), F.lit(0)) <= 0
    return docs.withColumn("category", F.when(empty, F.array_distinct(F.col("hierarchy"))).otherwise(F.col("category")))


def backfill_authors(docs: DataFrame) -> DataFrame:
    return docs.withColumn("author", T.normalize_author(F.col("author")))


def write_swapped(df: DataFrame, path: str, lease: WriterLease | None = None) -> None:
    """Writes beside the table and then takes its place."""
    fresh = f"{path}.new-{uuid.uuid4().hex}"
    df.write.parquet(fresh)
    swap(df.sparkSession, fresh, path, lease)


def swap(spark: SparkSession, fresh: str, path: str, lease: WriterLease | None = None) -> None:
    """Puts the folder `fresh` in the place of `path`. The old one is moved aside, moved back if the new one can't take its
    place, and deleted at last, so that a whole version is there at any time but between two renames. A writer whose lease
    another one has taken over is refused."""
    jvm = spark.sparkContext._jvm
    old = jvm.org.apache.hadoop.fs.Path(f"{path}.old-{uuid.uuid4().hex}")
    source, target = jvm.org.apache.hadoop.fs.Path(fresh), jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if lease is not None:
        lease.check()
    had = fs.exists(target)
    if had:
        fs.rename(target, old)
    if not fs.rename(source, target):
        if had:
            fs.rename(old, target)
        raise OSError(f"{fresh} couldn't be moved to {path}")
    if had:
        fs.delete(old, True)


class StaleWriter(RuntimeError):
    """Another writer has taken the lease over."""


class WriterLease:
    """The right to write a folder: a number that rises with each writer, as a file that only one can create. Its holder
    renews it by writing the file again; a lease that wasn't renewed for `ttl` seconds may be taken over by the next number.
    Before a write takes effect, `check` looks for a higher number, so a writer that slept through its lease is refused.
    Times are those of the file system, not of the writers' clocks. Only the last number's file is kept."""

    def __init__(self, spark: SparkSession, path: str, ttl: float) -> None:
        self._jvm, self.ttl = spark.sparkContext._jvm, ttl
        self.folder = self._path(f"{path}/_writer")
        self._fs = self.folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self.folder)
        self._stop = threading.Event()
        last = self._last()
        if last is not None and not last[1] and self._now() - last[2] <= ttl:
            raise RuntimeError(f"another writer holds {path}")
        self.number = 1 + (last[0] if last is not None else 0)
        try:
            mine = self._fs.createNewFile(self._file(self.number))
        except Py4JJavaError:  # some file systems raise where the file is there
            mine = False
        if not mine:
            raise RuntimeError(f"another writer holds {path}")
        for number, _, _ in self._all():
            if number < self.number:
                self._fs.delete(self._file(number), False)
        self._thread = threading.Thread(target=self._renewing, daemon=True)
        if ttl > 0:
            self._thread.start()

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(name)

    def _file(self, number: int):
        return self._path(f"{self.folder}/{number:020}")

    def _all(self) -> list[tuple[int, bool, float]]:
        """(number, released, time of the last renewal); a released lease has bytes in its file."""
        found = [x for x in self._fs.listStatus(self.folder) if x.getPath().getName().isdigit()]
        return sorted((int(x.getPath().getName()), x.getLen() > 0, x.getModificationTime() / 1000) for x in found)

    def _last(self) -> tuple[int, bool, float] | None:
        return max(self._all(), default=None)

    def _now(self) -> float:
        probe = self._path(f"{self.folder}/now-{uuid.uuid4().hex}")
        self._fs.createNewFile(probe)
        try:
            return self._fs.getFileStatus(probe).getModificationTime() / 1000
        finally:
            self._fs.delete(probe, False)

    def _renewing(self) -> None:
        while not self._stop.wait(self.ttl / 3):
            try:
                self.renew()
            except Exception:  # noqa: BLE001
                return  # check() will say so

    def renew(self) -> None:
        self.check()
        self._fs.create(self._file(self.number), True).close()

    def check(self) -> None:
        """Raises StaleWriter if a later writer is there."""
        last = self._last()
        if last is None or last[0] != self.number:
            raise StaleWriter(f"writer {self.number} was followed by {last[0] if last else 'none'}")

    def release(self) -> None:
        self._stop.set()
        if self._thread.is_alive():
            self._thread.join()
        last = self._last()
        if last is not None and last[0] == self.number:
            out = self._fs.create(self._file(self.number), True)
            out.write(1)
            out.close()


@contextmanager
def writer_lock(spark: SparkSession, path: str, stale: float = 60.0) -> Iterator[WriterLease]:
    """Only one writer at a time: a lease that is renewed while it is held. One that wasn't renewed for `stale` seconds was
    left by a writer that died or sleeps, and is taken over. Raises RuntimeError if another writer holds it."""
    lease = WriterLease(spark, path, stale)
    try:
        yield lease
    finally:
        lease.release()


def first_wins(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """Of the rows of a key the first in the order."""
    return rows.withColumn("n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("n = 1").drop("n")
