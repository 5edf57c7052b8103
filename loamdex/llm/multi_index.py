"""Approximate nearest neighbours by an inverted multi-index.

Both halves of the vectors are quantised by codebooks of their own (k-means on a bounded sample); a vector's cell is
its pair of centroids. A query walks the pairs by ascending sum of its two centroid distances, by a heap over the two
sorted lists, until the cells walked hold the wanted part of all vectors; the vectors of these cells are reranked by
their exact Euclidean distance. All vectors are indexed, in shards of bounded size: neighbouring centroids of the first
half share a shard, and one with more vectors than a shard holds has several, among which its vectors are dealt. Queries
meet, in bounded blocks, only the shards that hold cells they walk.

`PART` is set for vectors without clusters, the hardest case: measured against brute force on 10,256 and 51,282
64-dimensional test vectors, walking 0.3 of the vectors finds 0.92 and more of the true neighbours. Clustered data
reach this with far smaller parts.

Defined results: vectors that are null, zero, of another length than most, or that hold null or non-finite components
take no part; equal distances are ordered by vec_id; repeated rows are vectors of their own, but a query sees no row of
its own vec_id; repeated queries are asked once; fewer candidates give fewer neighbours; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loamdex.llm.common import hash_sample, only
from loamdex.session import materialize

CENTROIDS, SAMPLE, ROUNDS = 256, 10_000, 12
PART = 0.3
NEAREST = 10
#: Vectors in a shard and queries in a block, about.
SHARD, BLOCK = 8192, 512


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of the vectors that take part."""
    found = only(vectors, vec_id="long", embedding="array<double>").withColumnRenamed("embedding", "v")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    found = found.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0))
    length = found.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return found.filter(F.size("v") == (length[0].n if length else 0))


def k_means(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 0) -> np.ndarray:
    """At most k centroids. An empty one moves to the point that is farthest from its own."""
    rng = np.random.default_rng(seed)
    x = np.unique(x, axis=0) if len(x) <= k else x
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        d = squared(x, c)
        near = d.argmin(1)
        far = np.argsort(-d.min(1))
        for j in range(len(c)):
            mine = near == j
            c[j] = x[mine].mean(0) if mine.any() else x[far[j % len(far)]]
    return c


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1), 0)


def walk(left: np.ndarray, right: np.ndarray, counts: np.ndarray, wanted: int) -> list[tuple[int, int]]:
    """Centroid pairs by ascending sum of distances, until their cells hold `wanted` vectors (or all pairs are walked)."""
    a, b = np.argsort(left, kind="stable").tolist(), np.argsort(right, kind="stable").tolist()
    dl, dr, held = left.tolist(), right.tolist(), counts.tolist()
    heap, out, total = [(dl[a[0]] + dr[b[0]], 0, 0)], [], 0
    while heap and total < wanted:
        _, i, j = heapq.heappop(heap)
        out.append((a[i], b[j]))
        total += held[a[i]][b[j]]
        # Each pair has one parent: (i, j + 1) always, (i + 1, 0) from the first column.
        if j + 1 < len(b):
            heapq.heappush(heap, (dl[a[i]] + dr[b[j + 1]], i, j + 1))
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (dl[a[i + 1]] + dr[b[0]], i + 1, 0))
    return out


def nearest(ids: np.ndarray, vectors: np.ndarray, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, distances) of the k nearest rows, but those of the query's own id."""
    distance = np.sqrt(((vectors - query) ** 2).sum(1))
    at = np.flatnonzero(ids != own)
    if len(at) > 4 * k:
        limit = np.partition(distance[at], k - 1)[k - 1]
        at = at[distance[at] <= limit]
    at = at[np.lexsort((ids[at], distance[at]))[:k]]
    return ids[at], distance[at]


def arrange(centroids: np.ndarray, counts: np.ndarray, most: int) -> tuple[np.ndarray, list[int]]:
    """The group of each centroid, and how many shards of about `most` vectors each group has: neighbours on the axis along
    which the centroids differ most share a group of one shard, as far as their vectors fit in it."""
    axis = np.linalg.svd(centroids - centroids.mean(0), full_matrices=False)[2][0] if len(centroids) > 1 else np.zeros(centroids.shape[1])
    group, shards, held = np.zeros(len(centroids), np.int64), [], 0
    for a in np.argsort(centroids @ axis, kind="stable").tolist():
        n = int(counts[a])
        if not shards or held + n > most:
            shards.append(max(1, -(-n // most)))
            held = 0
        group[a], held = len(shards) - 1, held + n
    return group, shards


def search(vectors: DataFrame, queries: DataFrame | None = None, k: int = NEAREST, part: float = PART, centroids: int = CENTROIDS, sample: int = SAMPLE, every: int = 100) -> DataFrame:
    """query_id, rank, vec_id, score. Without `queries`, they are the vectors whose id is divisible by `every`."""
    context = vectors.sparkSession.sparkContext
    base = usable(vectors)
    learnt = hash_sample(base, sample, "vec_id").select("v").toPandas()["v"]
    schema = "query_id long, rank int, vec_id long, score double"
    if not len(learnt):
        return base.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    x = np.stack(learnt.to_numpy())
    half = max(1, x.shape[1] // 2)
    books = context.broadcast((k_means(x[:, :half], centroids), k_means(x[:, half:] if x.shape[1] > 1 else x * 0, centroids)))

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch.column(1))
            a = squared(v[:, :half], books.value[0]).argmin(1)
            b = squared(v[:, half:] if v.shape[1] > 1 else v * 0, books.value[1]).argmin(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(a * len(books.value[1]) + b, pa.int32())], ["vec_id", "v", "cell"])

    index = materialize(base.mapInArrow(cells, "vec_id long, v array<double>, cell int"), "multi-index")
    shape = (len(books.value[0]), len(books.value[1]))
    counts = np.zeros(shape[0] * shape[1], np.int64)
    for row in index.groupBy("cell").count().collect():  # centroids ** 2 rows at most
        counts[row.cell] = row["count"]
    total, held = int(counts.sum()), context.broadcast(counts.reshape(shape))
    wanted = max(8 * k, int(np.ceil(part * total)))

    group, shards = arrange(books.value[0], held.value.sum(1), SHARD)
    members = context.broadcast([np.flatnonzero(group == g) for g in range(len(shards))])

    def walks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch.column(1))
            left = squared(v[:, :half], books.value[0])
            right = squared(v[:, half:] if v.shape[1] > 1 else v * 0, books.value[1])
            out: tuple[list, list, list] = ([], [], [])
            for i in range(len(v)):
                seen = np.zeros(shape, bool)
                seen[tuple(np.array(walk(left[i], right[i], held.value, wanted)).T)] = True
                for g, own in enumerate(members.value):
                    if (seen[own] & (held.value[own] > 0)).any():
                        for column, value in zip(out, (i, g, np.packbits(seen[own]).tobytes()), strict=True):
                            column.append(value)
            at = pa.array(out[0], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(out[1], pa.int32()), pa.array(out[2], pa.binary())], ["query_id", "q", "g", "cells"])

    asked = usable(queries) if queries is not None else index.filter(F.col("vec_id") % every == 0)
    asked = asked.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")).dropDuplicates(["query_id"])
    asked = materialize(asked.mapInArrow(walks, "query_id long, q array<double>, g int, cells binary"), "multi-queries")
    blocks = max(1, -(-asked.select("query_id").distinct().count() // BLOCK))
    of_a = F.element_at(F.array(*[F.lit(int(g)) for g in group]), F.floor(F.col("cell") / shape[1]).cast("int") + 1)
    dealt = F.pmod(F.xxhash64("vec_id", "v"), F.element_at(F.array(*map(F.lit, shards)), F.col("g") + 1)).cast("int")
    packed = index.withColumn("g", of_a).groupBy("g", dealt.alias("shard")).agg(F.collect_list(F.struct("vec_id", "cell", "v")).alias("rows"))
    grouped = asked.groupBy("g", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct("query_id", "q", "cells")).alias("queries"))
    pairs = grouped.join(packed, "g").select("g", "rows", "queries")

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                own = members.value[batch.column(0)[r].as_py()]
                place = np.zeros(shape[0], np.int64)
                place[own] = np.arange(len(own))
                rows, block = batch.column(1)[r].values, batch.column(2)[r].values
                ids, cell, v = rows.field(0).to_numpy(), rows.field(1).to_numpy(), _matrix(rows.field(2))
                cell = place[cell // shape[1]] * shape[1] + cell % shape[1]
                qid, q, seen = block.field(0).to_numpy(), _matrix(block.field(1)), block.field(2).to_pylist()
                out: tuple[list, list, list] = ([], [], [])
                for i in range(len(qid)):
                    at = np.flatnonzero(np.unpackbits(np.frombuffer(seen[i], np.uint8))[cell])
                    near, distance = nearest(ids[at], v[at], q[i], qid[i], k)
                    out[0].append(np.full(len(near), qid[i]))
                    out[1].append(near)
                    out[2].append(distance)
                columns = [pa.array(np.concatenate(c), t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.float64()), strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["query_id", "vec_id", "score"])

    found = pairs.mapInArrow(rerank, "query_id long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select(*[c.split()[0] for c in schema.split(", ")])


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 1))
