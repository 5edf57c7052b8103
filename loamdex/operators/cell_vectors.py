"""Vectors written by cell, so that a search reads the files of few cells.

Centres come from spherical k-means over a bounded sample; each vector stands in the cell of its most similar centre, and the
table is partitioned by cell, so that a filter on cells prunes files before anything is read. A small table has the centres,
the vectors of each cell and the largest angle to its centre.

A search takes the cells most similar to the query until they hold a stated share of the vectors. An exact search reads these
for a floor, and then all cells in which, by their angle, a vector above the floor can be. Vectors without a direction
(zero, null, not finite) have score 0 and the cell -1. A change rewrites the cells it touches.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamdex.operators import vector
from loamdex.session import materialize

#: Vectors that the centres are fitted on, and centres, at most (else the square root of the vectors).
SAMPLE, CELLS = 10_000, 4096
#: The share of the vectors that a search reads.
SHARE = 0.3
NOWHERE = -1


@dataclass
class CellVectors:
    """vectors: (cell, chunk_id, doc_id, vector); the rest has a row for each cell with a centre."""

    vectors: DataFrame
    cells: np.ndarray
    centres: np.ndarray
    sizes: np.ndarray
    angles: np.ndarray

    def near(self, query: Sequence[float], share: float = SHARE) -> list[int]:
        """The cells most similar to the query that hold a share of the vectors together."""
        order = np.argsort(-self._similar(query), kind="stable")
        held = np.cumsum(self.sizes[order])
        last = int(np.searchsorted(held, share * held[-1])) if len(held) else 0
        return [NOWHERE, *map(int, self.cells[order[: last + 1]])]

    def reaching(self, query: Sequence[float], floor: float) -> list[int]:
        """The cells in which a vector may be as similar as the floor."""
        apart = np.arccos(np.clip(self._similar(query), -1, 1))
        most = np.cos(np.maximum(0, apart - self.angles - 1e-6))
        return [NOWHERE, *map(int, self.cells[most >= floor - 1e-9])]

    def _similar(self, query: Sequence[float]) -> np.ndarray:
        q = np.asarray(query, float)
        norm = np.linalg.norm(q)
        return self.centres @ (q / norm) if norm else np.zeros(len(self.centres))


def _units(values: list) -> np.ndarray:
    """Unit vectors; rows without a direction are zero."""
    width = max((len(v) for v in values if v is not None), default=0)
    out = np.zeros((len(values), width))
    for i, v in enumerate(values):
        if v is not None and len(v) == width and all(x is not None for x in v):
            out[i] = v
    with np.errstate(all="ignore"):
        out /= np.linalg.norm(out, axis=1, keepdims=True)
    out[~np.isfinite(out).all(axis=1)] = 0
    return out


def fit(chunks: DataFrame, cells: int | None = None, sample: int = SAMPLE, rounds: int = 10) -> np.ndarray:
    """Unit centres by spherical k-means over at most `sample` vectors, chosen by the hash of their ids."""
    n = chunks.count()
    rows = chunks.select("vector", F.xxhash64("chunk_id").alias("h"))
    if n > 2 * sample:  # what the tasks send on stays in proportion to the sample
        rows = rows.filter(F.pmod("h", F.lit(1 << 30)) < int((1 << 30) * 1.5 * sample / n))
    units = _units([r.vector for r in rows.orderBy("h").limit(sample).collect()])
    units = units[units.any(axis=1)]
    k = min(cells or min(CELLS, math.ceil(math.sqrt(n))), len(units))
    centres = units[:k].copy()
    for _ in range(rounds):
        own = np.argmax(units @ centres.T, axis=1) if k else np.zeros(0, int)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, units)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 1e-12, sums / np.maximum(norms, 1e-12), centres)
    return centres


def assigned(chunks: DataFrame, cells: np.ndarray, centres: np.ndarray) -> DataFrame:
    """(cell, angle, chunk_id, doc_id, vector) of chunk_id, doc_id, vector."""
    from pyspark.sql import types as T

    shared = chunks.sparkSession.sparkContext.broadcast((cells, centres))
    rows = chunks.select("chunk_id", "doc_id", "vector")
    kind = T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("angle", T.DoubleType()), *rows.schema.fields])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, middle = shared.value
        for whole in batches:
            for begin in range(0, whole.num_rows, 2048):
                batch = whole.slice(begin, 2048)
                units = _units(batch.column(2).to_pylist())
                cell, angle = np.full(len(units), NOWHERE, np.int32), np.zeros(len(units))
                if len(middle) and units.shape[1] == middle.shape[1]:
                    found = units.any(axis=1)
                    similar = units[found] @ middle.T
                    best = similar.argmax(axis=1)
                    cell[found] = numbers[best]
                    angle[found] = np.arccos(np.clip(similar[np.arange(len(best)), best], -1, 1))
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(angle), *batch.columns], kind.names)

    return rows.mapInArrow(assign, kind)


def _write(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A cell's rows together; adaptive execution splits what is too large for a file."""
    dealt = rows.drop("angle").hint("rebalance", "cell").sortWithinPartitions("cell", "chunk_id")
    dealt.write.mode(mode).option("partitionOverwriteMode", "dynamic" if mode == "overwrite" else "static").partitionBy("cell").parquet(f"{path}/chunks")


def _write_cells(spark: SparkSession, path: str, rows: list[tuple]) -> None:
    """rows: (cell, centre, n, angle); `CELLS` at most."""
    spark.createDataFrame(rows, "cell int, centre array<double>, n long, angle double").coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")


def build(chunks: DataFrame, path: str, cells: int | None = None) -> None:
    """Writes the tables `chunks` and `cells` of (chunk_id, doc_id, vector) into a folder."""
    centres = fit(chunks, cells)
    rows = materialize(assigned(chunks, np.arange(len(centres), dtype=np.int32), centres), "cells")
    stats = {r.cell: (r.n, r.angle) for r in rows.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("angle")).collect()}
    rows.drop("angle").hint("rebalance", "cell").sortWithinPartitions("cell", "chunk_id").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/chunks")
    _write_cells(chunks.sparkSession, path, [(i, c.tolist(), *stats.get(i, (0, 0.0))) for i, c in enumerate(centres)])


def load(spark: SparkSession, path: str) -> CellVectors:
    rows = sorted(spark.read.parquet(f"{path}/cells").collect())
    width = len(rows[0].centre) if rows else 0
    found = spark.read.parquet(f"{path}/chunks").select("cell", "chunk_id", "doc_id", "vector")
    return CellVectors(found, np.array([r.cell for r in rows], np.int32), np.array([r.centre for r in rows]).reshape(len(rows), width), np.array([r.n for r in rows], np.int64), np.array([r.angle for r in rows]))


def update(spark: SparkSession, path: str, fresh: DataFrame, gone: DataFrame) -> int:
    """Takes the chunks of the documents `gone` (doc_id) out and puts `fresh` (chunk_id, doc_id, vector) in. Only the cells
    that either is in are written; returns their number. Centres stay."""
    index = load(spark, path)
    new = materialize(assigned(fresh, index.cells, index.centres), "cells")
    ids = materialize(gone.select("doc_id").distinct(), "gone")
    old = index.vectors.join(ids, "doc_id", "left_semi").select("cell")
    touched = [r.cell for r in old.unionByName(new.select("cell")).distinct().collect()]  # CELLS at most
    if not touched:
        return 0
    stay = index.vectors.filter(F.col("cell").isin(touched)).join(ids, "doc_id", "left_anti")
    # Angles of the vectors that stay are at most the cell's old one.
    before = dict(zip(map(int, index.cells), index.angles, strict=True))
    rows = materialize(stay.select("cell", "chunk_id", "doc_id", "vector").unionByName(new.select("cell", "chunk_id", "doc_id", "vector")), "touched-cells")
    sizes = {r.cell: r.n for r in rows.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    angles = {r.cell: r.angle for r in new.groupBy("cell").agg(F.max("angle").alias("angle")).collect()}
    _write(rows, path)
    jvm = spark.sparkContext._jvm
    for cell in set(touched) - set(sizes):  # an overwrite leaves partitions alone that it has no rows for
        folder = jvm.org.apache.hadoop.fs.Path(f"{path}/chunks/cell={cell}")
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    known = dict(zip(map(int, index.cells), index.sizes, strict=True))
    changed = {c: sizes.get(c, 0) for c in touched}
    _write_cells(spark, path, [(c, m.tolist(), int(changed.get(c, known[c])), float(max(before[c], angles.get(c, 0.0)))) for c, m in zip(map(int, index.cells), index.centres, strict=True)])
    return len(touched)


def search(index: CellVectors, query: Sequence[float], k: int = 10, offset: int = 0, where: Column | None = None, share: float = SHARE, exact: bool = False, among: DataFrame | None = None) -> DataFrame:
    """As `vector.search`, over the cells near the query; with `exact` the same rows. `among` limits the chunks to those of
    its doc_ids."""
    chosen = index.near(query, share)
    hits = lambda cells: vector.search(_kept(index, cells, among), vector.literal(query), k, offset, where)
    if exact:
        first = vector.search(_kept(index, chosen, among), vector.literal(query), k + offset, 0, where).agg(F.count("*").alias("n"), F.min("score").alias("floor")).first()
        floor = first.floor if first.n >= k + offset and any(query) else -2.0
        chosen = sorted({*chosen, *index.reaching(query, floor)})
    return hits(chosen)


def _kept(index: CellVectors, cells: list[int], among: DataFrame | None) -> DataFrame:
    rows = index.vectors.filter(F.col("cell").isin(cells))
    return rows if among is None else rows.join(among.select("doc_id"), "doc_id", "left_semi")
