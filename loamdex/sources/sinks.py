"""Writers: tables by source, raw page folders with manifests, drafts, and published copies; schema versions."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from loamdex.operators.ingest import swap

#: Columns that each version of the document table added, with their types.
MIGRATIONS = {
    1: {"doc_id": "string", "source": "string", "source_id": "string", "title": "string", "body": "string", "content_hash": "string"},
    2: {"space": "string", "url": "string", "author": "string", "created_at": "timestamp", "updated_at": "timestamp"},
    3: {"tags": "array<string>", "hierarchy": "array<string>"},
    4: {"static_score": "double"},
    5: {"category": "array<string>", "doc_type": "string"},
}


def migrate(table: DataFrame, version: int | None = None) -> DataFrame:
    """The table with the columns of all versions up to `version` (the last by default); what is new is null."""
    for v in sorted(MIGRATIONS):
        if version is None or v <= version:
            table = table.withColumns({c: F.lit(None).cast(kind) for c, kind in MIGRATIONS[v].items() if c not in table.columns})
    return table


def schema_version(table: DataFrame) -> int:
    """The last version all of whose columns are there."""
    done = 0
    for v in sorted(MIGRATIONS):
        if not set(MIGRATIONS[v]) <= set(table.columns):
            break
        done = v
    return done


def write_documents(docs: DataFrame, path: str) -> None:
    docs.write.mode("overwrite").partitionBy("source").parquet(path)


def manifest(source: str, as_of: str | None, added=(), modified=(), deleted=(), since: str | None = None, stats: dict | None = None) -> str:
    """The JSON of an acquisition's manifest."""
    change = {"since": since, "added": list(added), "modified": list(modified), "deleted": list(deleted)}
    return json.dumps({"schema_version": 1, "source": source, "as_of": as_of, "stats": stats or {}, "last_change": change}, ensure_ascii=False)


def change_lists(rows: DataFrame) -> dict[str, list[str]]:
    """{op: ids} of a change set (source_id, op), for a manifest."""
    out: dict[str, list[str]] = {"added": [], "modified": [], "deleted": []}
    for r in rows.groupBy("op").agg(F.array_sort(F.collect_set("source_id")).alias("ids")).collect():
        out[r.op] = r.ids
    return out


class _FolderWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator) -> WriterCommitMessage:
        import pathlib

        for row in iterator:
            folder = pathlib.Path(self.path, row.space, row.source_id)
            folder.mkdir(parents=True, exist_ok=True)
            (folder / "content.html").write_text(row.raw_body or "", encoding="utf-8")
            (folder / "meta.json").write_text(row.meta or "{}", encoding="utf-8")
        return WriterCommitMessage()


class PageFolders(DataSource):
    """`df.write.format("page_folders").save(path)` of (space, source_id, raw_body, meta): a folder for each page, in a file
    system that all executors mount."""

    @classmethod
    def name(cls) -> str:
        return "page_folders"

    def schema(self) -> str:
        return "space string, source_id string, raw_body string, meta string"

    def writer(self, schema, overwrite) -> DataSourceWriter:
        return _FolderWriter(self.options["path"])


class _FileWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator) -> WriterCommitMessage:
        import pathlib

        for row in iterator:
            file = pathlib.Path(self.path, row.folder, row.name)
            file.parent.mkdir(parents=True, exist_ok=True)
            file.write_text(row.text or "", encoding="utf-8")
        return WriterCommitMessage()


class TextFiles(DataSource):
    """`df.write.format("text_files").option("path", path).save()` of (folder, name, text): a file for each row, in a file
    system that all executors mount."""

    @classmethod
    def name(cls) -> str:
        return "text_files"

    def schema(self) -> str:
        return "folder string, name string, text string"

    def writer(self, schema, overwrite) -> DataSourceWriter:
        return _FileWriter(self.options["path"])


def draft(rows: DataFrame, most: int = 10_000) -> str:
    """YAML of a reviewed list (dictionary, golden cases, terms). It is meant for people: raises ValueError beyond `most` rows."""
    import yaml

    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} rows are no list for a review")
    return yaml.safe_dump([r.asDict(recursive=True) for r in found], allow_unicode=True, sort_keys=False)


def publish(spark: SparkSession, source: str, target: str) -> None:
    """Copies a folder of tables through the cluster's file systems and then swaps it in."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    Path, util = jvm.org.apache.hadoop.fs.Path, jvm.org.apache.hadoop.fs.FileUtil
    a, b, fresh = Path(source), Path(target), Path(f"{target}.new")
    fs = b.getFileSystem(conf)
    fs.delete(fresh, True)
    util.copy(a.getFileSystem(conf), a, fs, fresh, False, conf)
    swap(spark, f"{target}.new", target)
