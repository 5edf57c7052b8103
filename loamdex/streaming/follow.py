"""Acquisition as a stream: sources whose offsets are their own watermarks, so that a batch asks for what changed since the
last one, and a restart goes on from the checkpoint.

    rest_changes    pages or issues of a server; the offset is the newest change of each space or project
    git_changes     commits of clones; the offset is the commit that each clone is at

A change whose time is after a batch's end is left to the next batch, in which it is after its start: each one is read once. The
server's list is read newest first and only as far as the watermark; an entry that moves while pages are read can come twice
within a batch, never in none, and the writers below keep the latest. An item without a readable time has no place in this order
and isn't read here; `acquire.acquire_pages` and `acquire_issues` read it. Deletions aren't changes: a full `sync` finds them.
"""

from __future__ import annotations

import json
import os
import subprocess
import time
from collections.abc import Callable, Iterator
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from loamdex.session import materialize
from loamdex.sources import acquire, bronze, sinks

BEGIN = "1970-01-01T00:00:00+00:00"


def moment(text: str | None) -> datetime | None:
    """A time with a zone (UTC where none is given), or None."""
    try:
        at = datetime.fromisoformat((text or "").strip())
    except ValueError:
        return None
    return (at if at.tzinfo else at.replace(tzinfo=UTC)).astimezone(UTC)


class _Span(InputPartition):
    def __init__(self, name: str, start: str, end: str) -> None:
        self.name, self.start, self.end = name, start, end


def _spans(start: dict, end: dict, begin: str) -> list[_Span]:
    return [_Span(name, start.get(name, begin), to) for name, to in sorted(end.items()) if start.get(name, begin) != to]


class _RestChanges(DataSourceStreamReader):
    def __init__(self, options) -> None:
        self.options = dict(options)
        self.issues = self.options.get("kind", "confluence") == "jira"
        self.names = self.options.get("names", "").split()
        if not self.names:
            raise ValueError("name the spaces or projects")
        self.begin = (moment(self.options.get("start")) or moment(BEGIN)).isoformat()
        self.settle = timedelta(seconds=float(self.options.get("settle", 60)))

    def initialOffset(self) -> dict:  # noqa: N802
        return dict.fromkeys(self.names, self.begin)

    def _pages(self, name: str, since: datetime, size: int) -> Iterator[list[dict]]:
        """Pages of the items changed since about then, newest first. The search takes days in the zone of the server's user, so
        it is asked for a day and a half more than is wanted."""
        day = f"{since - timedelta(hours=36):%Y-%m-%d}" if since > moment(BEGIN) + timedelta(days=2) else None
        base = self.options["base"]
        start = url = (acquire.issue_urls(base, [name], None, size, day) if self.issues else acquire.page_urls(base, [name], day, size=size))[0]
        headers = {"Accept": "application/json"} | bronze.authorization(self.options.get("user"), self.options.get("token"))
        while url:
            data = bronze.fetch_json(url, headers, float(self.options.get("timeout", 60)))
            items = data.get("issues" if self.issues else "results", [])
            yield items
            url = bronze.following_page(start, url, data) if items else None

    def _at(self, item: dict) -> datetime | None:
        return moment((item.get("fields") or {}).get("updated") if self.issues else (item.get("version") or {}).get("when"))

    def latestOffset(self) -> dict:  # noqa: N802
        """The newest change of each name, but none of the last `settle` seconds, in which others of the same time may come."""
        out, upto = {}, datetime.now(UTC) - self.settle
        for name in self.names:
            times = (t for items in self._pages(name, moment(self.begin), 1) for t in map(self._at, items) if t is not None)
            newest = next(times, moment(self.begin))
            out[name] = max(moment(self.begin), min(newest, upto)).isoformat()
        return out

    def partitions(self, start: dict, end: dict) -> list[_Span]:
        return [s for s in _spans(start, end, self.begin) if moment(s.start) < moment(s.end)]

    def read(self, partition: _Span) -> Iterator[tuple]:
        after, upto = moment(partition.start), moment(partition.end)
        for items in self._pages(partition.name, after, int(self.options.get("size", 50))):
            known = [(t, item) for item in items if (t := self._at(item)) is not None]
            for t, item in known:
                if after < t <= upto:
                    yield partition.name, t, json.dumps(item, ensure_ascii=False)
            if known and all(t <= after for t, _ in known):
                return


class RestChanges(DataSource):
    """`spark.readStream.format("rest_changes")` with the options kind (confluence or jira), base, names, and, where wanted,
    user, token, start, settle, size and timeout: a partition for each space or project that changed."""

    @classmethod
    def name(cls) -> str:
        return "rest_changes"

    def schema(self) -> str:
        return "name string, at timestamp, json string"

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _RestChanges(self.options)


def _git(path: str, *args: str) -> str | None:
    found = subprocess.run(["git", "-C", path, *args], capture_output=True, text=True, errors="replace", timeout=3600)
    return found.stdout if found.returncode == 0 else None


class _GitChanges(DataSourceStreamReader):
    def __init__(self, options) -> None:
        self.paths = [p for p in options.get("paths", options.get("path", "")).split(",") if p]

    def initialOffset(self) -> dict:  # noqa: N802
        return dict.fromkeys(self.paths, "")

    def latestOffset(self) -> dict:  # noqa: N802
        return {p: (_git(p, "rev-parse", "--verify", "-q", "HEAD") or "").strip() for p in self.paths}

    def partitions(self, start: dict, end: dict) -> list[_Span]:
        return [s for s in _spans(start, end, "") if s.end]

    def read(self, partition: _Span) -> Iterator[tuple]:
        """Commits that the end has and the start hasn't; all, where the start isn't in the clone any more."""
        known = partition.start and _git(partition.name, "cat-file", "-e", f"{partition.start}^{{commit}}") is not None
        span = f"{partition.start}..{partition.end}" if known else partition.end
        form = bronze.FIELD.join(("%H", "%an", "%aI", "%s", "%b")) + bronze.RECORD
        out = _git(partition.name, "log", f"--format={form}", span, "--")
        if out is None:
            raise RuntimeError(f"{partition.name} has no commits {span}")
        repo = os.path.basename(partition.name.rstrip("/"))
        for record in out.split(bronze.RECORD):
            parts = record.strip("\n").split(bronze.FIELD)
            if len(parts) == 5:
                yield (f"{repo}@{parts[0][:12]}", *parts)


class GitChanges(DataSource):
    """`spark.readStream.format("git_changes").option("paths", "/a,/b")`: new commits of clones that the driver and executors
    see. Columns are those of `git_commits`."""

    @classmethod
    def name(cls) -> str:
        return "git_changes"

    def schema(self) -> str:
        return "source_id string, commit string, author string, at string, subject string, body string"

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _GitChanges(self.options)


def rest_changes(spark: SparkSession, kind: str, base: str, names: list[str], user: str | None = None, token: str | None = None, **options) -> DataFrame:
    spark.dataSource.register(RestChanges)
    given = {"kind": kind, "base": base, "names": " ".join(names), "user": user, "token": token} | options
    return spark.readStream.format("rest_changes").options(**{k: v for k, v in given.items() if v is not None}).load()


def git_changes(spark: SparkSession, paths: list[str]) -> DataFrame:
    spark.dataSource.register(GitChanges)
    return spark.readStream.format("git_changes").option("paths", ",".join(paths)).load()


def raw_files(kind: str, base: str, path: str) -> Callable[[DataFrame, int], None]:
    """For each batch: the latest state of its pages or issues as raw files, which `loamdex.sources.bronze` reads. No stored
    file is listed or read, and a batch that is applied again writes the same files."""

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        answers = materialize(batch.select("json"), "changes")  # fetched once
        if kind == "jira":
            spark.dataSource.register(sinks.TextFiles)
            acquire.issue_files(answers).select("folder", "name", "text").write.format("text_files").mode("append").option("path", path).save()
        else:
            spark.dataSource.register(sinks.PageFolders)
            acquire.page_rows(answers, base).select("space", "source_id", "raw_body", "meta").write.format("page_folders").mode("append").option("path", path).save()

    return apply


def commit_rows(batch: DataFrame) -> DataFrame:
    """Commits as rows for a table by buckets with the key source_id (`logs.merge_into_buckets`)."""
    return batch.dropDuplicates(["source_id"]).withColumn("content_hash", F.col("commit"))


def follow(changes: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, every: float | None = None) -> list[int]:
    """Applies what changed since the last run, and returns the numbers of rows of its batches; with `every` goes on, asking
    after so many seconds, until it is stopped or fails. A run that finds a failed batch applies that one alone, so where
    something was read, what came since is asked for once more."""

    def run() -> list[int]:
        query = changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        return [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]]

    while True:
        found = run()
        if found:
            found += run()
        if every is None:
            return found
        time.sleep(max(5.0, every))
