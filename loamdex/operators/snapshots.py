"""Tables of a folder behind one pointer: bucketed by key, so that a batch writes the buckets it touches and no others.

A folder holds `_data/<id>/...`, written once and never changed, and `_versions/<number>.json`, each of which names the parts of
all tables. The highest number is the pointer: readers see the whole state that it names, before and after a commit alike, so a
writer that dies at any point leaves the last state as it was. A commit claims its number by a file that only one can create
and then renames its version into place; a writer whose base isn't the last version any more is refused.

Renames have to be atomic (HDFS, local and mounted file systems). The last look at the pointer and the rename are two steps, so
writers hold a lease (`ingest.writer_lock`) as well. A version lists a folder for each bucket, so its size follows the number of
buckets, not of rows.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from loamdex.operators import ingest
from loamdex.session import materialize

#: Rows that a bucket is meant to hold where a table's number of buckets isn't given.
BUCKET_ROWS = 200_000
BUCKET = "bucket_"


class _Files:
    """The few calls to the cluster's file system that versions need."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self._jvm, self.path = spark.sparkContext._jvm, path.rstrip("/")
        self.fs = self.at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, folder: str) -> list[str]:
        at = self.at(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.at(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        stream = self.fs.create(self.at(name), True)
        try:
            stream.write(bytearray(text, "utf-8"))
        finally:
            stream.close()


@dataclass
class Table:
    """schema as JSON, keys, number of buckets, and the folder of each bucket that has rows."""

    schema: str
    keys: list[str]
    buckets: int
    parts: dict[str, str]


@dataclass
class Snapshot:
    """One version. `tables` are bucketed, `folders` are written by others in their own way (an index, a tree)."""

    spark: SparkSession
    path: str
    number: int = 0
    tables: dict[str, Table] = field(default_factory=dict)
    folders: dict[str, str] = field(default_factory=dict)

    def table(self, name: str, among: DataFrame | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The rows of a table, of some buckets, or of those that the keys `among` fall into; only these folders are read."""
        t = self.tables[name]
        if among is not None:
            buckets = buckets_of(among, t)
        schema = T.StructType.fromJson(json.loads(t.schema))
        wanted = t.parts if buckets is None else {str(b): t.parts[str(b)] for b in buckets if str(b) in t.parts}
        paths = [f"{self.path}/_data/{folder}/{BUCKET}={b}" for b, folder in sorted(wanted.items())]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def folder(self, name: str) -> str | None:
        found = self.folders.get(name)
        return f"{self.path}/_data/{found}" if found else None


def _bucket(schema: T.StructType, keys: list[str], buckets: int) -> Column:
    """The bucket of a row; keys are cast to the table's types, since the hash depends on them."""
    return F.pmod(F.xxhash64(*[F.col(k).cast(schema[k].dataType) for k in keys]), F.lit(buckets)).cast("int")


def buckets_of(rows: DataFrame, table: Table) -> list[int]:
    """The buckets that rows fall into, at most all of the table's."""
    schema = T.StructType.fromJson(json.loads(table.schema))
    return sorted(r[0] for r in rows.select(_bucket(schema, table.keys, table.buckets)).distinct().collect())


def _numbers(files: _Files, ending: str) -> list[int]:
    return [int(n[: -len(ending)]) for n in files.names("_versions") if n.endswith(ending) and n[: -len(ending)].isdigit()]


def latest(spark: SparkSession, path: str, number: int | None = None) -> Snapshot:
    """The last version, or a given one that is still kept; without any, an empty one with number 0."""
    files = _Files(spark, path)
    found = _numbers(files, ".json")
    if number is None:
        number = max(found, default=0)
    if not number:
        return Snapshot(spark, files.path)
    state = json.loads(files.read(f"_versions/{number:020}.json"))
    return Snapshot(spark, files.path, number, {n: Table(**t) for n, t in state["tables"].items()}, state["folders"])


class Change:
    """What the next version will be: tables put or merged, and folders, that take effect together by `commit`."""

    def __init__(self, spark: SparkSession, path: str, lease: ingest.WriterLease | None = None) -> None:
        self.spark, self.lease = spark, lease
        self.base = latest(spark, path)
        self.next = Snapshot(spark, self.base.path, 0, dict(self.base.tables), dict(self.base.folders))
        self._files = _Files(spark, path)

    def _write(self, rows: DataFrame) -> tuple[str, list[int]]:
        """The new folder of rows that are dealt by bucket, and the buckets that it has."""
        folder = uuid.uuid4().hex
        rows.write.partitionBy(BUCKET).parquet(f"{self.base.path}/_data/{folder}")
        return folder, [int(n.partition("=")[2]) for n in self._files.names(f"_data/{folder}") if n.startswith(f"{BUCKET}=")]

    def put(self, name: str, rows: DataFrame, keys: list[str], buckets: int | None = None) -> None:
        """A whole table, in place of the one of this name."""
        if BUCKET in rows.columns:
            raise ValueError(f"{BUCKET} is the name of a bucket's folder")
        schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in rows.schema])
        if buckets is None:
            rows = materialize(rows, "put")
            buckets = max(1, -(-rows.count() // BUCKET_ROWS))
        # A bucket's rows together; adaptive execution splits large ones.
        dealt = rows.withColumn(BUCKET, _bucket(schema, keys, buckets)).hint("rebalance", BUCKET).sortWithinPartitions(BUCKET, *keys)
        folder, found = self._write(dealt)
        self.next.tables[name] = Table(schema.json(), list(keys), buckets, {str(b): folder for b in found})

    def merge(self, name: str, rows: DataFrame, gone: DataFrame | None = None, force: bool = False, keep: tuple[str, ...] = ("static_score",)) -> dict[str, int]:
        """Merges rows by key, as `ingest.merge`, and takes out the keys `gone`, rows of which don't count as given. Rows
        whose content_hash is the stored one leave their bucket alone; without such a column all rows are written. Updated rows
        keep the stored values of `keep` and of columns that `rows` lack. Which buckets change is found by keys and hashes alone;
        whole rows are read, and shuffled once, for these. `rows` are read more than once, so they should be stored ones
        (`materialize`). Returns the numbers of inserted, updated, skipped and deleted rows, and of written buckets. A key that
        is null or repeated is refused by ValueError."""
        t = self.next.tables[name]
        schema = T.StructType.fromJson(json.loads(t.schema))
        new = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema if f.name in rows.columns])
        hashed = "content_hash" in schema.names and "content_hash" in new.columns
        seen = [*t.keys, *(["content_hash"] if hashed else [])]
        slim = new.select(*seen)
        if gone is not None:
            gone = materialize(gone.select(*[F.col(k).cast(schema[k].dataType).alias(k) for k in t.keys]).distinct(), "gone")
            slim = slim.join(gone, t.keys, "left_anti")
        slim = materialize(slim, "merge")
        null = F.lit(False)
        for k in t.keys:
            null = null | F.col(k).isNull()
        if slim.filter(null).take(1) or slim.groupBy(*t.keys).count().filter("count > 1").take(1):
            raise ValueError(f"a key of {name} is null or repeated")
        before = self.next.table(name, among=slim).select(*seen).withColumnRenamed("content_hash", "had_").withColumn("was_", F.lit(True))
        same = F.col("content_hash").eqNullSafe(F.col("had_")) if hashed and not force else F.lit(False)
        status = F.when(F.col("was_").isNull(), "inserted").when(same, "skipped").otherwise("updated")
        told = materialize(slim.join(before, t.keys, "left").select(*t.keys, status.alias("status_")), "told")
        stats = {r.status_: r.n for r in told.groupBy("status_").agg(F.count("*").alias("n")).collect()}
        touched = set(buckets_of(told.filter("status_ <> 'skipped'"), t))
        if gone is not None:
            leaving = materialize(self.next.table(name, among=gone).select(*t.keys).join(gone, t.keys, "left_semi"), "leaving")
            n = leaving.count()
            if n:
                stats["deleted"] = n
                touched |= set(buckets_of(leaving, t))
        stats["buckets"] = len(touched)
        if touched:
            folder, found = self._write(self._merged(t, schema, self.next.table(name, buckets=sorted(touched)), new, gone, sorted(touched), hashed and not force, keep))
            parts = {b: f for b, f in t.parts.items() if int(b) not in touched} | {str(b): folder for b in found}
            self.next.tables[name] = Table(t.schema, t.keys, t.buckets, parts)
        return stats

    def _merged(self, t: Table, schema: T.StructType, old: DataFrame, new: DataFrame, gone: DataFrame | None, touched: list[int], hashed: bool, keep: tuple[str, ...]) -> DataFrame:
        """The rows of the touched buckets after the merge, dealt by bucket. Stored rows (0), new ones (1) and keys that go (2)
        of a key meet in one shuffle by bucket, which is also that of the folders."""
        side = lambda df, n: df.withColumn("side_", F.lit(n))
        both = side(old, 0).unionByName(side(new, 1), allowMissingColumns=True)
        if gone is not None:
            both = both.unionByName(side(gone, 2), allowMissingColumns=True)
        both = both.withColumn(BUCKET, _bucket(schema, t.keys, t.buckets)).filter(F.col(BUCKET).isin(touched)).repartition(BUCKET)
        own = W.partitionBy(BUCKET, *t.keys)
        of = lambda n, c: F.first(F.when(F.col("side_") == n, c), ignorenulls=True).over(own)
        there = lambda n: F.max(F.col("side_") == n).over(own)
        same = there(0) & there(1) & of(0, F.col("content_hash")).eqNullSafe(of(1, F.col("content_hash"))) if hashed else F.lit(False)
        stored = [f.name for f in schema if f.name not in new.columns or f.name in keep]
        facts = {"had_": there(0), "has_": there(1), "goes_": there(2), "same_": same} | {f"old_{c}": of(0, F.col(c)) for c in stored}
        known = both.withColumns(facts).filter(~F.col("goes_") & F.when(F.col("side_") == 0, ~F.col("has_") | F.col("same_")).otherwise(~F.col("same_")))
        return known.select(*[F.coalesce(f"old_{f.name}", f.name).alias(f.name) if f.name in stored else F.col(f.name) for f in schema], BUCKET).sortWithinPartitions(BUCKET, *t.keys)

    def folder(self, name: str) -> str:
        """A new place for a folder of this name, to be written before the commit."""
        self.next.folders[name] = uuid.uuid4().hex
        return self.next.folder(name)

    def commit(self, keep: int = 2) -> int:
        """Makes the change the last version, and returns its number. Of earlier versions, `keep` - 1 stay readable; data
        that no kept version names is deleted."""
        files = self._files
        if self.lease is not None:
            self.lease.check()
        number = 1 + max([self.base.number, *_numbers(files, ".claim"), *_numbers(files, ".json")])
        files.fs.mkdirs(files.at("_versions"))
        try:
            mine = files.fs.createNewFile(files.at(f"_versions/{number:020}.claim"))
        except Exception:  # noqa: BLE001  some file systems raise where the file is there
            mine = False
        if not mine or max(_numbers(files, ".json"), default=0) != self.base.number:
            raise ingest.StaleWriter(f"version {self.base.number} isn't the last one any more")
        state = {"tables": {n: vars(t) for n, t in self.next.tables.items()}, "folders": self.next.folders}
        draft = f"_versions/draft-{uuid.uuid4().hex}"
        files.write(draft, json.dumps(state))
        if self.lease is not None:
            self.lease.check()
        if not files.fs.rename(files.at(draft), files.at(f"_versions/{number:020}.json")):
            raise OSError(f"version {number} couldn't be put in place")
        if self.lease is not None:  # whoever holds the lease is the only one that writes, so what isn't named is left over
            self._sweep(keep)
        return number

    def _sweep(self, keep: int) -> None:
        files = self._files
        numbers = sorted(_numbers(files, ".json"))
        named: set[str] = set()
        for n in numbers[-max(1, keep) :]:
            state = latest(self.spark, self.base.path, n)
            named |= set(state.folders.values()) | {f for t in state.tables.values() for f in t.parts.values()}
        for n in numbers[: -max(1, keep)]:
            files.fs.delete(files.at(f"_versions/{n:020}.json"), False)
        for n in sorted(_numbers(files, ".claim"))[:-1]:
            files.fs.delete(files.at(f"_versions/{n:020}.claim"), False)
        for folder in files.names("_data"):
            if folder not in named:
                files.fs.delete(files.at(f"_data/{folder}"), True)
