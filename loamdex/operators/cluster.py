"""Topic clusters of passages: a mutual nearest-neighbour graph, its components, off-topic clusters and key words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loamdex.functions.text import normalize_words
from loamdex.operators import descent, pairs
from loamdex.operators.vector import dot
from loamdex.session import materialize

# Words that name no topic.
STOP_WORDS = ("그리고", "그래서", "근데", "그게", "저기", "그거", "이거", "거기", "여기", "정도", "조금", "그런", "이런", "저런", "하는", "되는", "해서", "있는", "그럼", "그러", "네네", "음음", "아니", "그냥")


def unit(v: Column) -> Column:
    norm = F.greatest(F.sqrt(dot(v, v)), F.lit(1e-12))
    return F.transform(v, lambda x: x.cast("double") / norm)


def mean_vector(rows: DataFrame, column: str = "v", by: list[str] | None = None) -> DataFrame:
    """(by, m): the mean by component, from map-side sums."""
    by = by or []
    parts = rows.select(*by, F.posexplode(column).alias("i", "x")).groupBy(*by, "i").agg(F.avg("x").alias("x"))
    return parts.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("m"))


def centred(rows: DataFrame) -> DataFrame:
    """(id, v): unit vectors after the common mean is taken off."""
    mean = mean_vector(rows)
    moved = rows.crossJoin(F.broadcast(mean)).select("id", F.zip_with("v", "m", lambda x, m: x.cast("double") - m).alias("v"))  # mean is one row
    return moved.select("id", unit(F.col("v")).alias("v"))


def neighbours(rows: DataFrame, k: int = 3, block: int = 1024) -> DataFrame:
    """(a, near, n, s, ss) for each row: its k most similar others as structs (d, b) with d = -similarity (equal ones by
    id), and the number, sum and sum of squares of its similarities, over all pairs (`pairs.neighbours`)."""
    return pairs.neighbours(rows, k, block)


def threshold(found: DataFrame, alpha: float = 1.0) -> DataFrame:
    """(cut): mean + alpha x population deviation over all pairs. Each pair counts from both of its sides."""
    mean = F.sum("s") / F.sum("n")
    return found.agg((mean + alpha * F.sqrt(F.greatest(F.sum("ss") / F.sum("n") - mean * mean, F.lit(0.0)))).alias("cut"))


def mutual_edges(found: DataFrame, alpha: float = 1.0) -> DataFrame:
    """(a, b), a < b, of `neighbours`: each among the nearest of the other, and at least as similar as the threshold."""
    near = found.select("a", F.explode("near").alias("x")).select("a", "x.b", (-F.col("x.d")).alias("sim"))
    back = near.select(F.col("b").alias("a"), F.col("a").alias("b"))
    both = near.filter("a < b").join(back, ["a", "b"], "left_semi")
    return both.crossJoin(F.broadcast(threshold(found, alpha))).filter("sim >= cut").select("a", "b")  # threshold is one row


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, label): the least id of each node's component. Labels spread along edges and jump to their labels' labels
    until none changes; each round is written to the shared folder."""
    both = materialize(edges.select(F.col("a").alias("id"), F.col("b").alias("to")).union(edges.select(F.col("b"), F.col("a"))).distinct(), "edges")
    labels = materialize(nodes.select("id", F.col("id").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("to"), "label"), "to").groupBy("id").agg(F.min("label").alias("near"))
        spread = labels.join(near, "id", "left").select("id", F.least("label", "near").alias("label"), F.col("label").alias("was"))
        jump = spread.select(F.col("id").alias("label"), F.col("label").alias("far"))
        fresh = materialize(spread.join(jump, "label", "left").select("id", F.least("label", "far").alias("label"), "was"), "labels")
        labels = fresh.select("id", "label")
        if fresh.filter("label <> was").isEmpty():
            return labels


def clusters(nodes: DataFrame, edges: DataFrame, least: int = 2) -> DataFrame:
    """(id, cluster): the component's least id, or null for components that are too small."""
    labels = components(nodes, edges)
    sizes = labels.groupBy("label").agg(F.count("*").alias("size"))
    return labels.join(sizes, "label").select("id", F.when(F.col("size") >= least, F.col("label")).alias("cluster"))


def robust_centroid(rows: DataFrame, trim: float = 0.2) -> DataFrame:
    """(g): the unit mean of the vectors nearest the mean, without the farthest part."""
    g = mean_vector(rows).select(unit(F.col("m")).alias("g"))
    near = rows.crossJoin(F.broadcast(g)).select("v", dot(F.col("v"), F.col("g")).alias("s"))  # g is one row
    cut = near.agg(F.percentile("s", F.lit(trim)).alias("cut"))
    return mean_vector(near.crossJoin(F.broadcast(cut)).filter("s >= cut").select("v")).select(unit(F.col("m")).alias("g"))


def off_topic(rows: DataFrame, members: DataFrame, alpha: float = 1.0) -> DataFrame:
    """(cluster, affinity, off_topic): clusters whose centroid is far from the robust centre, if there are three or more."""
    centres = mean_vector(rows.join(members.filter("cluster IS NOT NULL"), "id"), by=["cluster"]).select("cluster", unit(F.col("m")).alias("c"))
    near = centres.crossJoin(F.broadcast(robust_centroid(rows))).select("cluster", dot(F.col("c"), F.col("g")).alias("affinity"))
    cut = near.agg(F.count("*").alias("n"), (F.avg("affinity") - alpha * F.stddev_pop("affinity")).alias("cut"))
    return near.crossJoin(F.broadcast(cut)).select("cluster", "affinity", ((F.col("n") >= 3) & (F.col("affinity") < F.col("cut"))).alias("off_topic"))


def doc_support(members: DataFrame, passages: DataFrame) -> DataFrame:
    return members.filter("cluster IS NOT NULL").join(passages, "id").groupBy("cluster").agg(F.count_distinct("doc_id").alias("support"))


def key_words(texts: DataFrame, top: int = 6) -> DataFrame:
    """(cluster, rank, term, weight) by class-based TF-IDF of (cluster, text)."""
    words = F.filter(F.split(normalize_words(F.col("text")), " "), lambda w: (F.length(w) >= 2) & ~w.isin(*STOP_WORDS))
    tf = texts.select("cluster", F.explode(words).alias("term")).groupBy("cluster", "term").agg(F.count("*").alias("tf"))
    total = tf.groupBy("term").agg(F.sum("tf").alias("f"))
    average = tf.agg((F.sum("tf") / F.count_distinct("cluster")).alias("average"))
    weight = F.col("tf") * F.log(1 + F.col("average") / F.col("f"))
    rows = tf.join(total, "term").crossJoin(F.broadcast(average)).select("cluster", "term", weight.alias("weight"))  # average is one row
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("cluster").orderBy(F.desc("weight"), "term"))).filter(F.col("rank") <= top).select("cluster", "rank", "term", "weight")


def analyze(passages: DataFrame, k: int = 3, alpha: float = 1.0, least: int = 2, support: int = 1, off_alpha: float = 1.0) -> dict[str, DataFrame]:
    """passages (id, doc_id, text, v) to {members: (id, cluster, off_topic), topics: (cluster, support, affinity,
    off_topic), words: (cluster, rank, term, weight)}. Clusters below the support are off topic too. Neighbours come from
    descent: exact up to `descent.BLOCK` passages, nearly all of them beyond."""
    rows = materialize(passages.select("id", unit(F.col("v")).alias("v")), "passages")
    edges = descent.mutual_edges(materialize(centred(rows), "centred"), k, alpha)
    members = materialize(clusters(rows.select("id"), edges, least), "members")
    topics = off_topic(rows, members, off_alpha).join(doc_support(members, passages.select("id", "doc_id")), "cluster")
    topics = topics.withColumn("off_topic", F.col("off_topic") | (F.col("support") < support))
    kept = members.join(topics.select("cluster", "off_topic"), "cluster", "left").select("id", "cluster", F.coalesce("off_topic", F.lit(True)).alias("off_topic"))
    words = key_words(members.filter("cluster IS NOT NULL").join(passages.select("id", "text"), "id").select("cluster", "text"))
    return {"members": kept, "topics": topics, "words": words}
