"""Interval numbers of the tree of document paths, so that siblings, parents and whole subtrees are ranges of a number.

All prefixes of all paths are the nodes. In the order of their paths a node stands right before its subtree, so numbers
that rise in that order make each subtree a range [lo, hi]. The numbers come from a range sort, each task numbering its own
rows above those of the task before; no task sees all nodes. The table of documents is sorted by the number of their node,
and a request reads the row groups of one range.

Documents without a path (null or empty) have no node and no relatives; a null part of a path is a part of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamdex.session import materialize

COLUMNS = ("lo", "hi", "parent_lo", "parent_hi", "depth", "source", "doc_id")


def _path(column: str) -> Column:
    return F.transform(F.col(column), lambda x: F.coalesce(x.cast("string"), F.lit("\0")))


def nodes(docs: DataFrame) -> DataFrame:
    """(source, path, lo, hi) of every prefix of every path. Written."""
    paths = docs.select("source", _path("hierarchy").alias("path")).filter(F.size("path") > 0).distinct()
    prefixes = lambda: F.transform(F.sequence(F.lit(1), F.size("path")), lambda n: F.slice("path", F.lit(1), n))
    every = paths.select("source", F.explode(prefixes()).alias("path")).distinct()
    # The number holds the task above the row's place in it, so it rises over all tasks of the range sort.
    placed = materialize(every.repartitionByRange("source", "path").sortWithinPartitions("source", "path").withColumn("lo", F.monotonically_increasing_id()), "tree-nodes")
    last = placed.select("source", "lo", F.explode(prefixes()).alias("path")).groupBy("source", "path").agg(F.max("lo").alias("hi"))
    return materialize(placed.join(last, ["source", "path"]).select("source", "path", "lo", "hi"), "tree-ranges")


def place(docs: DataFrame) -> DataFrame:
    """`COLUMNS` of (doc_id, source, hierarchy): the range of each document's node and of the one above it."""
    tree = nodes(docs)
    above = tree.select("source", F.col("path").alias("up"), F.col("lo").alias("parent_lo"), F.col("hi").alias("parent_hi"))
    own = tree.withColumn("up", F.slice("path", F.lit(1), F.size("path") - 1)).join(above, ["source", "up"], "left")
    rows = docs.select("doc_id", "source", _path("hierarchy").alias("path"))
    return rows.join(own, ["source", "path"]).withColumn("depth", F.size("path")).select(*COLUMNS)


def save(placed: DataFrame, path: str) -> None:
    placed.repartitionByRange("lo", "doc_id").sortWithinPartitions("lo", "doc_id").write.mode("overwrite").parquet(path)


def build(docs: DataFrame, path: str) -> None:
    save(place(docs), path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def subtree(placed: DataFrame, lo: int, hi: int) -> DataFrame:
    return placed.filter((F.col("lo") >= lo) & (F.col("lo") <= hi))


def relatives(placed: DataFrame, doc_id, sibling: float, parent: float) -> DataFrame | None:
    """(doc_id, score) of a document's siblings and parents, by one range of the tree; None if it has no place or stands
    at the top."""
    own = placed.filter(F.col("doc_id") == doc_id).select("parent_lo", "parent_hi", "depth").first()
    if own is None or own.parent_lo is None:
        return None
    rows = subtree(placed, own.parent_lo, own.parent_hi).filter(F.col("doc_id") != doc_id)
    score = F.when(F.col("lo") == own.parent_lo, F.lit(parent)).when(F.col("depth") == own.depth, F.lit(sibling))
    return rows.select("doc_id", score.alias("score")).filter(F.col("score").isNotNull())


def family_sizes(placed: DataFrame) -> DataFrame:
    """(doc_id, siblings, parents): how many documents stand beside and right above each one. Joins on node numbers, after
    documents are counted by node."""
    rows = placed.select("doc_id", "lo", "parent_lo", "depth")
    at = rows.groupBy("lo").agg(F.count("*").alias("parents")).withColumnRenamed("lo", "parent_lo")
    beside = rows.filter("parent_lo IS NOT NULL").groupBy("parent_lo").agg(F.count("*").alias("siblings"))
    both = rows.join(beside, "parent_lo", "left").join(at, "parent_lo", "left")
    return both.select("doc_id", F.coalesce(F.col("siblings") - 1, F.lit(0)).alias("siblings"), F.coalesce("parents", F.lit(0)).alias("parents"))


def subtree_sizes(placed: DataFrame) -> DataFrame:
    """(doc_id, below): how many documents stand in the subtree of each document's node, but at the node itself. A
    document is below a node if its number is in the node's range, so a running count by number, read at both ends, gives
    it; counts by node are few against documents."""
    from pyspark.sql import Window as W

    at = placed.groupBy("source", "lo", "hi").agg(F.count("*").alias("n"))
    # Ranges end at nodes of the same source.
    ends = at.select("source", F.col("lo").alias("at"), "n", F.lit(None).cast("long").alias("node")).unionByName(at.select("source", F.col("hi").alias("at"), F.lit(0).cast("long").alias("n"), F.col("lo").alias("node")))
    upto = ends.withColumn("upto", F.sum("n").over(W.partitionBy("source").orderBy("at").rangeBetween(W.unboundedPreceding, W.currentRow)))
    to_end = upto.filter("node IS NOT NULL").select(F.col("node").alias("lo"), F.col("upto").alias("to_end"))
    to_own = upto.filter("node IS NULL").select(F.col("at").alias("lo"), F.col("upto").alias("to_own"))
    return placed.select("doc_id", "lo").join(to_end.join(to_own, "lo"), "lo").select("doc_id", (F.col("to_end") - F.col("to_own")).alias("below"))
