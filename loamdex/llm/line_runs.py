"""Line dedup by levelled sorted runs of line hashes, in DataFrame functions alone.

A line's key is the line without white space at both ends and with A-Z in lower case. Keys of at least `MIN_CHARS` code
points that at least `MIN_DOCS` documents hold lose all their lines except those of the largest doc_id that has the key.

Documents come in batches of descending doc_id. `LineRuns` keeps what it has seen as runs: tables of (h1, h2, n_docs,
top), bucketed and sorted by the key's hash, so that a merge join with a run moves none of its rows. Each new batch counts
its own keys, combined before the shuffle so that a frequent line is a row for each task, and is merge-anti-joined with
the runs: a key that a run has settled (enough documents, so that its largest document is known, as batches descend) is
not written again; all others are added as the batch's own run. When `FANOUT` runs stand on a level they are compacted
into one of the next. At last all runs are summed, which leaves the repeated keys and their largest documents.

The texts are split twice, once for hashes (24 bytes a line, written to the shared folder by batch) and once for the
result. What a document loses is gathered for each (doc_id, text), which no more lines share than a text has.

Keys are told apart by two 64-bit hashes of different seeds; nothing else is approximate.

Defined results: a null or empty text is one empty line; rows that share a doc_id are one document; a null doc_id is a
document before all others; repeated rows are each returned; nothing is dropped from a document that holds a key last,
however often it does; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamdex.llm.common import ascii_lower, only
from loamdex.session import materialize, shared_dir

MIN_CHARS = 40
MIN_DOCS = 5
#: Batches that a table is read in, and runs on a level before they are compacted.
BATCHES = 6
FANOUT = 3

BLANKS = " \t\n\x0b\x0c\r"
_KEY = ("h1", "h2")


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _documents(docs: DataFrame) -> DataFrame:
    """doc orders documents, null first; row tells the texts of one doc_id apart."""
    rows = only(docs, doc_id="long", text="string")
    return rows.withColumn("doc", F.coalesce("doc_id", F.lit(-(1 << 63)))).withColumn("row", F.xxhash64("text"))


def hashed_lines(docs: DataFrame, least: int = MIN_CHARS) -> DataFrame:
    """(doc, row, p, h1, h2) of the lines whose keys have `least` code points."""
    lines = _documents(docs).select("doc", "row", F.posexplode(_lines(F.col("text"))).alias("p", "line"))
    long = lines.filter(F.length(F.btrim("line", F.lit(BLANKS))) >= least).withColumn("key", line_key(F.col("line")))
    return long.select("doc", "row", "p", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), F.col("key")).alias("h2"))


@dataclass
class LineRuns:
    """Runs of (h1, h2, n_docs, top) by level. Batches must come in descending order of `doc`, all lines of a document in
    one batch. A run is a table in the shared folder, registered under a name of its own until `drop`."""

    spark: SparkSession
    min_docs: int = MIN_DOCS
    fanout: int = FANOUT
    levels: list[list[str]] = field(default_factory=list)
    compacted: int = 0

    def __post_init__(self) -> None:
        self._buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self._folder = f"{shared_dir(self.spark)}/line-runs-{uuid.uuid4().hex}"
        self._made: list[str] = []

    def runs(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def add(self, lines: DataFrame) -> None:
        """Adds a batch of (doc, h1, h2): the keys that no run has settled, as a run of level 0."""
        self._put(self.unsettled(lines), 0)

    def unsettled(self, lines: DataFrame) -> DataFrame:
        """(h1, h2, n_docs, top) of a batch's keys that no run has settled."""
        own = lines.select(*_KEY, "doc").distinct().groupBy(*_KEY).agg(F.count("*").alias("n_docs"), F.max("doc").alias("top"))
        for name in self.runs():
            run = self.spark.table(name).filter(F.col("n_docs") >= self.min_docs).select(*[F.col(k).alias(f"run_{k}") for k in _KEY])
            # The last condition is true; it keeps the join above the sums, so that a frequent key is summed first.
            on = (F.col("h1") == F.col("run_h1")) & (F.col("h2") == F.col("run_h2")) & (F.col("n_docs") > 0)
            own = own.join(run, on, "left_anti")
        return own

    def repeated(self) -> DataFrame:
        """(h1, h2, top) of the keys that enough documents hold."""
        return self._summed(self.runs()).filter(F.col("n_docs") >= self.min_docs).select(*_KEY, "top")

    def drop(self) -> None:
        for name in self._made:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self._folder)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def _summed(self, names: list[str]) -> DataFrame:
        rows = self.spark.createDataFrame([], "h1 long, h2 long, n_docs long, top long")
        for name in names:
            rows = rows.unionByName(self.spark.table(name))
        return rows.groupBy(*_KEY).agg(F.sum("n_docs").alias("n_docs"), F.max("top").alias("top"))

    def _put(self, rows: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        name = f"line_run_{uuid.uuid4().hex}"
        self._made.append(name)
        (
            rows.write.format("parquet").option("path", f"{self._folder}/{name}")
            .bucketBy(self._buckets, *_KEY).sortBy(*_KEY).saveAsTable(name)
        )
        self.levels[level].append(name)
        if len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            self.compacted += 1
            self._put(self._summed(full), level + 1)


def _cuts(docs: DataFrame, batches: int) -> list[int]:
    """Ids at which a new batch begins, about as many documents in each; they only decide how the work is divided."""
    at = [i / batches for i in range(1, batches)]
    found = docs.agg(F.percentile_approx("doc", at, 1000).alias("cuts")).first().cuts if at else None
    return sorted(set(found or []))


def dropped_lines(docs: DataFrame, least: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """(doc, row, dropped): the sorted places of the lines that each text loses, written to the shared folder."""
    spark = docs.sparkSession
    cuts = _cuts(_documents(docs), batches)
    # Batch 0 has the largest ids.
    batch = F.lit(0)
    for c in cuts:
        batch = batch + (F.col("doc") < c).cast("int")
    path = f"{shared_dir(spark)}/line-hashes-{uuid.uuid4().hex}"
    hashed_lines(docs, least).withColumn("batch", batch).write.partitionBy("batch").parquet(path)
    schema = "doc long, row long, p int, h1 long, h2 long, batch int"
    lines = spark.read.schema(schema).parquet(path)
    runs = LineRuns(spark, min_docs, fanout)
    for i in range(len(cuts) + 1):
        runs.add(lines.filter(F.col("batch") == i))
    repeated = materialize(runs.repeated(), "repeated-lines")
    lost = lines.join(repeated, list(_KEY)).filter("doc <> top").groupBy("doc", "row").agg(F.array_sort(F.collect_set("p")).alias("dropped"))
    out = materialize(lost, "dropped-lines")
    runs.drop()
    return out


def clean(docs: DataFrame, **settings: int) -> DataFrame:
    """doc_id, n_lines, n_dropped and the kept text of every row."""
    lost = dropped_lines(docs, **settings)
    rows = _documents(docs).join(lost, ["doc", "row"], "left").withColumn("lines", _lines(F.col("text")))
    n, none = F.size("lines"), F.array().cast("array<int>")
    places = F.array_except(F.sequence(F.lit(0), n - 1), F.coalesce("dropped", none))
    kept = F.array_join(F.transform(places, lambda p: F.get("lines", p)), "\n")
    return rows.select(
        "doc_id",
        n.cast("long").alias("n_lines"),
        F.size(F.coalesce("dropped", none)).cast("long").alias("n_dropped"),
        F.when(F.col("dropped").isNull(), F.coalesce("text", F.lit(""))).otherwise(kept).alias("kept"),
    )


def digests(docs: DataFrame, **settings: int) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every row."""
    return clean(docs, **settings).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def oracle() -> str:
    """The same rows as DuckDB SQL."""
    blanks = " || ".join(f"chr({ord(c)})" for c in BLANKS)
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(doc_id, -9223372036854775808) AS doc, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT rid, doc_id, doc, unnest(ls) AS line, unnest(range(len(ls))) AS p FROM d),
k AS (SELECT *, translate(trim(line, {blanks}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
dup AS (SELECT key, max(doc) AS top FROM k WHERE length(key) >= {MIN_CHARS} GROUP BY key HAVING count(DISTINCT doc) >= {MIN_DOCS}),
f AS (SELECT k.*, dup.key IS NOT NULL AND doc <> top AS gone FROM k LEFT JOIN dup USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (NOT gone), '')) AS kept_sha256 FROM f GROUP BY rid, doc_id
"""
