"""Nearest neighbours of all rows by neighbour descent, and the moments of all similarities by vector sums.

A start list comes from blocks of rows that are compared as a whole: `PASSES` times rows are dealt to the nearest of some
of them, each time others, and once at random. Sending a row to a block brings as many comparisons as the block has rows,
so these lists are good at little shuffling. Then rounds: a row's nearest and rows that list it meet at that row, compare
each other, and keep the best. A neighbour's neighbour is likely a neighbour, so a round or two find most of the rest. Work
and shuffled rows grow with the rows. Of a row that very many list, `MEMBERS` of these by hash take part in a round; this
is an approximation, whose recall is measured in the tests. Up to `BLOCK` rows all pairs are compared, so the lists are
exact; `exact` edges compare all pairs beyond that, too, and keep only what reaches the lists (`pairs`).

The mean and deviation of all similarities need no pairs: with S the sum of the vectors and M that of their outer
products, the sums over ordered pairs of x.y and (x.y)^2 are |S|^2 and |M|^2, less those of each row with itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loamdex.operators import pairs
from loamdex.session import materialize

#: Neighbours that are kept, rows of a block of the start on average, passes of it, rounds and members from each side.
WIDTH, BLOCK, PASSES, ROUNDS, MEMBERS = 8, 512, 16, 2, 8
#: Centres of a pass at most.
CENTRES = 1024


def _lists(ids: pa.Array, v: np.ndarray, width: int) -> pa.Table:
    """(a, near) of the rows of a group: each one's `width` nearest in it, as structs (d, b) with d = -similarity."""
    order = np.argsort(ids.to_numpy(zero_copy_only=False), kind="stable")
    ids, v = ids.take(pa.array(order)), v[order]
    far = -(v @ v.T)
    np.fill_diagonal(far, np.inf)
    n, most = len(v), min(width, len(v) - 1)
    best = np.argsort(far, axis=1, kind="stable")[:, :most] if n <= 4 * width else np.argpartition(far, most - 1, axis=1)[:, :most]
    # Summed in one order, so that a pair has one similarity in all groups.
    d = np.stack([-(v * v[best[:, j]]).sum(1) for j in range(most)], axis=1) if most else np.empty((n, 0))
    near = pa.StructArray.from_arrays([pa.array(d.ravel()), ids.take(pa.array(best.ravel()))], ["d", "b"])
    return pa.table([ids, pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * most), near)], ["a", "near"])


def _near(kind: str) -> str:
    return f"array<struct<d: double, b: {kind}>>"


def _in_cells(rows: DataFrame, by: list[str], kind: str, width: int) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        return _lists(table["id"].combine_chunks(), table["v"].combine_chunks().flatten().to_numpy().reshape(len(table), -1), width)

    return rows.groupBy(*by).applyInArrow(run, f"a {kind}, near {_near(kind)}")


def _at_rows(met: DataFrame, kind: str, width: int) -> DataFrame:
    """Of rows with an array of (id, v): small groups, so many go through at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups = batch.column(0)
            ends = np.cumsum(groups.value_lengths().to_numpy(zero_copy_only=False))
            flat = groups.flatten()
            ids, v = flat.field("id"), flat.field("v").flatten().to_numpy().reshape(len(flat), -1)
            out = [_lists(ids[e - n : e], v[e - n : e], width) for e, n in zip(ends, np.diff(ends, prepend=0), strict=True) if n > 1]
            if out:
                yield from pa.concat_tables(out).combine_chunks().to_batches()

    return met.mapInArrow(run, f"a {kind}, near {_near(kind)}")


def _best(lists: DataFrame, width: int) -> DataFrame:
    """(a, near): the best of all of a row's lists."""
    return lists.groupBy("a").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("near")))), 1, width).alias("near"))


def _dealt(rows: DataFrame, n: int, block: int) -> DataFrame:
    """(id, v, pass, cell, cut): rows by the nearest of a pass's centres, which are rows; the last pass is random."""
    count = max(2, min(CENTRES, n // block))
    key = F.xxhash64(F.lit(2), "id")
    some = rows.orderBy(key, "id").limit(min(n, PASSES * count)).collect()  # bounded: PASSES x CENTRES rows
    centres = [np.array([r.v for r in some[p::PASSES]]) for p in range(PASSES)]

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                v = np.stack(pdf["v"].to_numpy())
                near = np.stack([(v @ c.T).argmax(1) for c in centres if len(c)], axis=1).astype(np.int32)
                yield pd.DataFrame({"id": pdf["id"], "v": pdf["v"], "cells": list(near)})

    kinds = dict(rows.dtypes)
    told = materialize(rows.mapInPandas(cells, f"id {kinds['id']}, v {kinds['v']}, cells array<int>"), "descent-cells")
    random = F.pmod(F.xxhash64(F.lit(1), F.col("id")), F.lit(-(-n // block))).cast("int")
    passes = told.select("id", "v", F.posexplode(F.concat("cells", F.array(random))).alias("pass", "cell"))
    # A row for each cell of a pass; cells of very many rows are cut by hash.
    only = told.select(F.posexplode("cells").alias("pass", "cell"))
    sizes = only.groupBy("pass", "cell").agg(F.ceil(F.count("*") / (4 * block)).cast("int").alias("cuts"))
    return passes.join(F.broadcast(sizes), ["pass", "cell"], "left").withColumn("cut", F.pmod(F.xxhash64("id"), F.coalesce("cuts", F.lit(1))))


def neighbours(rows: DataFrame, k: int = 3, width: int = WIDTH, block: int = BLOCK, rounds: int = ROUNDS) -> DataFrame:
    """(a, near) of (id, v): each row's k nearest others as structs (d, b), d = -similarity, ties by id. Written."""
    kind, n = dict(rows.dtypes)["id"], rows.count()
    rows = materialize(rows.select("id", "v"), "descent-rows")
    width = max(k, width)
    if n <= block:
        lists = _in_cells(rows.withColumn("cell", F.lit(0)), ["cell"], kind, width)
    else:
        lists = _in_cells(_dealt(rows, n, block), ["pass", "cell", "cut"], kind, width)
    lists = materialize(_best(lists, width), "descent-lists")
    for _ in range(rounds if n > block else 0):
        ahead = lists.select(F.col("a").alias("u"), F.explode(F.slice("near", 1, MEMBERS)).alias("x")).select("u", F.col("x.b").alias("x"))
        back = W.partitionBy("u").orderBy(F.xxhash64("u", "x"))
        listed = ahead.select(F.col("x").alias("u"), F.col("u").alias("x")).withColumn("n", F.row_number().over(back)).filter(F.col("n") <= MEMBERS).drop("n")
        members = ahead.unionByName(listed).distinct()
        met = members.join(rows.withColumnRenamed("id", "x"), "x").groupBy("u").agg(F.collect_list(F.struct(F.col("x").alias("id"), "v")).alias("rows"))
        new = materialize(_best(lists.unionByName(_at_rows(met.select("rows"), kind, width)), width), "descent-lists")
        first = lambda t: t.select("a", F.transform(F.slice("near", 1, k), lambda x: x["b"]).alias("first"))
        both = first(new).join(first(lists).withColumnRenamed("first", "was"), "a", "left")
        changed = both.agg(F.sum(F.size(F.array_except("first", F.coalesce("was", F.array().cast(f"array<{kind}>")))))).first()[0] or 0
        lists = new
        if changed <= n * k // 1000:
            break
    lists = lists.select(F.col("a").alias("id"), F.slice("near", 1, k).alias("near"))
    return materialize(rows.select("id").join(lists, "id", "left").select(F.col("id").alias("a"), F.coalesce("near", F.array().cast(_near(kind))).alias("near")), "descent-lists")


def moments(rows: DataFrame) -> DataFrame:
    """One row (n, mean, deviation) of the similarities of all ordered pairs of different rows of (id, v)."""

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = outer = None
        n, own, fourth = 0, 0.0, 0.0
        for pdf in batches:
            if len(pdf):
                v = np.stack(pdf["v"].to_numpy())
                square = np.einsum("ij,ij->i", v, v)
                n, own, fourth = n + len(v), own + square.sum(), fourth + (square**2).sum()
                total = v.sum(0) if total is None else total + v.sum(0)
                outer = v.T @ v if outer is None else outer + v.T @ v
        if n:
            flat = np.concatenate([[n, own, fourth], total, outer.ravel()])
            yield pd.DataFrame({"i": np.arange(len(flat)), "x": flat})

    flat = rows.select("v").mapInPandas(sums, "i long, x double").groupBy("i").agg(F.sum("x").alias("x"))
    one = flat.agg(*[F.max(F.when(F.col("i") == i, F.col("x"))).alias(name) for i, name in enumerate(("n", "own", "fourth"))], F.count("*").alias("size"))
    # With d components there are 3 + d + d^2 sums.
    width = F.round((F.sqrt(4.0 * (F.col("size") - 3) + 1) - 1) / 2).cast("long")
    square = flat.crossJoin(F.broadcast(one.select("*", width.alias("width"))))  # one row
    both = square.agg(
        F.max("n").alias("n"), F.max("own").alias("own"), F.max("fourth").alias("fourth"),
        F.sum(F.when((F.col("i") >= 3) & (F.col("i") < 3 + F.col("width")), F.col("x") * F.col("x"))).alias("s"),
        F.sum(F.when(F.col("i") >= 3 + F.col("width"), F.col("x") * F.col("x"))).alias("ss"),
    )
    pairs = F.col("n") * (F.col("n") - 1)
    mean = (F.col("s") - F.col("own")) / pairs
    deviation = F.sqrt(F.greatest((F.col("ss") - F.col("fourth")) / pairs - mean * mean, F.lit(0.0)))
    return both.select(pairs.cast("long").alias("n"), F.when(pairs > 0, mean).alias("mean"), F.when(pairs > 0, deviation).alias("deviation"))


def mutual_edges(rows: DataFrame, k: int = 3, alpha: float = 1.0, exact: bool = False, **settings: int) -> DataFrame:
    """(a, b), a < b: each among the k nearest of the other, and at least as similar as mean + alpha x deviation of all.
    With `exact` all pairs are compared beyond a block, too: the lists tell what a neighbour must reach."""
    lists = neighbours(rows, k, **settings)
    if exact:
        floors = lists.filter(F.size("near") == k).select(F.col("a").alias("id"), (-F.element_at("near", k)["d"]).alias("floor"))
        lists = materialize(pairs.neighbours(rows, k, floors=floors).select("a", "near"), "exact-lists")
    near = lists.select("a", F.explode("near").alias("x")).select("a", "x.b", (-F.col("x.d")).alias("sim"))
    both = near.filter("a < b").join(near.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"], "left_semi")
    cut = moments(rows).select((F.col("mean") + alpha * F.col("deviation")).alias("cut"))
    return both.crossJoin(F.broadcast(cut)).filter("sim >= cut").select("a", "b")  # cut is one row
