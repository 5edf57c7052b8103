"""Streams: windowed log counts, sessions, the search before a selection, and incremental merges."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loamdex.operators import ingest, snapshots
from loamdex.session import materialize


def read_events(spark: SparkSession, path: str, schema=None, max_files: int | None = None) -> DataFrame:
    """A stream of Parquet event files; `ts` becomes a timestamp with time zone UTC, as watermarks need it."""
    reader = spark.readStream.schema(schema if schema is not None else spark.read.parquet(path).schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def window_counts(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """(start, event_type, n): tumbling windows, or sliding ones with `slide`. Works on a stream and on a table alike."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    counted = events.groupBy(F.window("ts", width, slide) if slide else F.window("ts", width), "event_type").agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("start"), "event_type", "n")


def session_counts(events: DataFrame, gap: str = "12 hours", late: str = "1 hour") -> DataFrame:
    """(user_id, start, n): sessions by gap."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    counted = events.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return counted.select("user_id", F.col("session_window.start").alias("start"), "n")


def deduplicated(events: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Each key once; on a stream within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def link_selections(events: DataFrame, gap_hours: float = 12.0) -> DataFrame:
    """(event_id, user_id, search_id): selections with the last search of their session, by a state for each user. Events of
    a user are taken in the order of time within each batch."""
    gap = gap_hours * 3600

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, search = state.get if state.exists else (None, None)
        out = []
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        for r in rows.itertuples():
            now = r.ts.timestamp()
            if last is not None and now - last > gap:
                search = None
            last = now
            if r.event_type == "view":
                search = int(r.event_id)
            elif r.event_type in ("click", "purchase"):
                out.append((int(r.event_id), int(key[0]), search))
        state.update((last, search))
        yield pd.DataFrame({"event_id": [o[0] for o in out], "user_id": [o[1] for o in out], "search_id": pd.array([o[2] for o in out], "Int64")})

    picked = events.select("user_id", "event_id", "ts", "event_type")
    return picked.groupBy("user_id").applyInPandasWithState(step, "event_id long, user_id long, search_id long", "last double, search long", "append", "NoTimeout")


def run_once(stream: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """All that is there now, into a memory table."""
    writer = stream.writeStream.queryName(name).format("memory").outputMode(mode).option("checkpointLocation", checkpoint)
    writer.trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.table(name)


def watch(changes: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, every_seconds: int = 60) -> StreamingQuery:
    """Applies each batch of changes; the checkpoint lets one run at a time go on where the last one ended."""
    writer = changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return writer.trigger(processingTime=f"{max(5, every_seconds)} seconds").start()


def merge_into(path: str, keys: tuple[str, ...] = ("doc_id",)) -> Callable[[DataFrame, int], None]:
    """For `watch`: merges a batch of document rows into the Parquet table at `path`."""

    def apply(batch: DataFrame, number: int) -> None:
        stored = batch.sparkSession.read.parquet(path)
        fresh = ingest.first_wins(batch, list(keys), F.desc("updated_at"), F.col("content_hash"))
        ingest.write_swapped(ingest.merge(stored, fresh, keys).drop("status"), path)

    return apply


def merge_into_buckets(path: str, table: str = "documents", order: tuple[str, ...] = ("updated_at",)) -> Callable[[DataFrame, int], None]:
    """For `watch`: merges a batch into a table of `loamdex.operators.snapshots`, of which only the buckets it touches are
    written; of a key's rows the last in the order (then by content_hash) counts. A batch that is applied again after a failure
    finds its hashes stored and writes nothing."""

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        with ingest.writer_lock(spark, path) as lease:
            change = snapshots.Change(spark, path, lease)
            keys = change.base.tables[table].keys
            fresh = materialize(ingest.first_wins(batch, keys, *[F.desc(c) for c in order], F.col("content_hash")), "batch")
            if change.merge(table, fresh)["buckets"]:
                change.commit()

    return apply


def high_watermark(docs: DataFrame, default_days: int = 30, as_of=None) -> DataFrame:
    """(source, since): the newest update of each source; without any, so many days back."""
    now = as_of if as_of is not None else F.current_timestamp()
    return docs.groupBy("source").agg(F.coalesce(F.max("updated_at"), F.timestamp_add("DAY", F.lit(-default_days), now)).alias("since"))


def progress(query: StreamingQuery) -> str:
    return json.dumps(query.lastProgress.json if query.lastProgress else None)
