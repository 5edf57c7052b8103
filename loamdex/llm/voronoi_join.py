"""Hard negatives by a distributed nearest-neighbour join over a Voronoi partition.

Vectors become integers, floor(256 x), and a score is an inner product. With a coordinate sqrt(M^2 - |x|^2) added, M the
largest norm, all rows lie on a sphere, and an anchor (whose added coordinate is 0) is nearest to the rows it scores best
with: d^2 = |a|^2 + M^2 - 2 a.x. So bounds on distances are bounds on scores.

1. A bounded sample gives pivots. Each row belongs to its nearest pivot's cell; of a cell only the least and the largest
   distance to the pivot are kept.
2. Rows are packed by cell, anchors by cell into groups. For each anchor, scores with the sample say what it needs at
   least; triangle and hyperplane inequalities say what a cell can give at most (and at least). A cell's blocks are
   replicated only to the groups of which an anchor might be served.
3. Each group joins its blocks exactly and keeps the best of each anchor; the best of all parts remain.

This is done twice: for the positives (same label, best scores), then for the negatives (other labels, best scores within
the band that each positive sets). Bounds decide only where work is done; results are exact, whatever sample and pivots.
Groups hold about the square root of the number of anchors, so that replicas grow with the power 1.5 of the rows at most,
less where cells are apart.

Defined results: rows with a null id, label or vector, or a null or non-finite component (of 256 x, too) take no part; of
rows that share a vec_id the least by label, then vector, does; missing components of shorter vectors are 0; a score beyond
a long is cut to its range; an anchor without positives, or a positive without negatives, has no rows; an empty table gives
none; extra columns are ignored.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loamdex.llm.common import hash_sample
from loamdex.session import materialize, spread

#: Anchors are the ids that this divides; ids that `SHIFTED` divides have their label moved on by one of `LABELS`.
EVERY, SHIFTED, LABELS = 100, 7, 10
POSITIVES, NEGATIVES = 5, 10
#: The band of a negative's score, in hundredths of the positive's.
LOW, HIGH = 30, 90
#: Rows of the sample at most, pivots at most (the square root of the rows, halved, below that), rows of a block.
SAMPLE, PIVOTS, BLOCK = 4096, 1024, 512
#: Anchors of a group, in square roots of their number.
GROUP = 8
#: Parts into which a group's blocks are dealt, so that no group is one task.
SALTS = 8


def prepared(embeddings: DataFrame) -> DataFrame:
    """(vec_id, label, embedding) of the rows that take part, one for each vec_id."""
    usable = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(256 * x) < F.lit(math.inf)))
    rows = embeddings.select(
        F.col("`vec_id`").cast("long").alias("vec_id"), F.col("`label`").cast("long").alias("label"), F.col("`embedding`").cast("array<double>").alias("embedding")
    ).filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).filter(usable)
    shifted = F.when(F.col("vec_id") % SHIFTED == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    rows = rows.withColumn("label", shifted)
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("r")).select("vec_id", "r.label", "r.embedding")


def _integers(embedding: pa.Array, width: int) -> np.ndarray:
    """The integer vectors as doubles, filled up with zeros."""
    sizes = np.diff(embedding.offsets.to_numpy())
    flat = np.floor(256 * embedding.flatten().to_numpy(zero_copy_only=False))
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = flat
    return out


@dataclass
class Space:
    """What all tasks know: the kind of numbers, M^2, the sample and its first rows, the pivots, and the cells' bounds."""

    width: int
    kind: str
    exact: bool
    top: float
    sample_ids: np.ndarray
    sample_labels: np.ndarray
    sample: np.ndarray
    pivots: np.ndarray
    nearest: np.ndarray | None = None
    farthest: np.ndarray | None = None

    def added(self, v: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0, self.top - np.einsum("ij,ij->i", v, v)))

    def unpack(self, data: bytes) -> np.ndarray:
        return np.frombuffer(data, self.kind).reshape(-1, self.width)

    def scores(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Inner products, exact: doubles hold them below 2^53, else they are computed in Python's integers and cut to longs."""
        if self.exact:
            return a.astype(np.float64) @ b.astype(np.float64).T
        whole = np.frompyfunc(int, 1, 1)
        return np.clip(whole(a).dot(whole(b).T), -(1 << 63), (1 << 63) - 1).astype(np.int64)


def space(rows: DataFrame) -> Space | None:
    """None if there are no rows. Sends the sample (`SAMPLE` rows at most) to the driver."""
    size = F.aggregate("embedding", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(F.floor(256 * x).cast("double")), F.abs(256 * x)))
    norm = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + F.pow(F.floor(256 * x).cast("double"), 2))
    found = rows.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("width"), F.max(size).alias("most"), F.max(norm).alias("top")).first()
    if not found.n:
        return None
    most, width = found.most + 1, found.width
    kind = "<i2" if most < 2**15 else "<f4" if most < 2**24 else "<f8"
    # floor() as a long is cut beyond 2^63: then there are no bounds.
    top = found.top * (1 + 1e-9) + 1 if most < 2**60 else math.inf
    picked = hash_sample(rows, SAMPLE, "vec_id").toArrow().combine_chunks()
    vectors = _integers(pa.concat_arrays(picked.column("embedding").chunks), width) if picked.num_rows else np.zeros((0, width))
    ids, labels = (picked.column(c).to_numpy().astype(np.int64) for c in ("vec_id", "label"))
    count = min(PIVOTS, max(8, math.ceil(math.sqrt(found.n) / 2)), len(ids))
    out = Space(width, kind, width * most**2 < 2**53, top, ids, labels, vectors, np.zeros((0, width + 1)))
    if math.isfinite(top):
        first = np.sort(np.unique(vectors, axis=0, return_index=True)[1])[:count]
        pivots = np.hstack([vectors[first], out.added(vectors[first])[:, None]])
        # Pivots that are near each other stand together, so that a group of anchors has near cells.
        few = pivots[: math.ceil(math.sqrt(len(pivots)))]
        near = np.argmax(pivots @ few.T, axis=1)
        out.pivots = pivots[np.argsort(near, kind="stable")]
    return out


def _distances(sp: Space, v: np.ndarray, extra: np.ndarray) -> np.ndarray:
    """From rows (with their added coordinates) to all pivots."""
    own = np.einsum("ij,ij->i", v, v) + extra**2
    square = own[:, None] + np.einsum("ij,ij->i", sp.pivots, sp.pivots) - 2 * (v @ sp.pivots[:, :-1].T + extra[:, None] * sp.pivots[:, -1])
    return np.sqrt(np.maximum(0, square))


def assigned(rows: DataFrame, sp: Space) -> DataFrame:
    """(cell, d, vec_id, label, v): the nearest pivot, the distance to it, and the packed vector. Written."""
    shared = rows.sparkSession.sparkContext.broadcast(sp)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared.value
        for whole in batches:
            for begin in range(0, whole.num_rows, 2048):
                batch = whole.slice(begin, 2048)
                v = _integers(batch.column(2), s.width)
                cell, d = np.zeros(len(v), np.int32), np.full(len(v), np.inf)
                if len(s.pivots):
                    far = _distances(s, v, s.added(v))
                    cell = far.argmin(axis=1).astype(np.int32)
                    d = far[np.arange(len(v)), cell]
                packed = [x.tobytes() for x in v.astype(s.kind)]
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(d), batch.column(0), batch.column(1), pa.array(packed, pa.binary())], ["cell", "d", "vec_id", "label", "v"])

    return materialize(rows.mapInArrow(assign, "cell int, d double, vec_id long, label long, v binary"), "voronoi-cells")


def _with_bounds(cells: DataFrame, sp: Space) -> Space:
    """The least and largest distance of each cell, a row for each of `PIVOTS` at most."""
    sp.nearest, sp.farthest = np.full(len(sp.pivots), np.inf), np.full(len(sp.pivots), -np.inf)
    for r in cells.groupBy("cell").agg(F.min("d").alias("lo"), F.max("d").alias("hi")).collect():
        if r.cell < len(sp.pivots):
            sp.nearest[r.cell], sp.farthest[r.cell] = r.lo, r.hi
    return sp


def blocks(cells: DataFrame) -> DataFrame:
    """(cell, block, ids, labels, vs): rows of one cell together, `BLOCK` at most. Ranges cut a cell of many rows."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def out() -> pa.RecordBatch:
            ids, labels = (np.array([r[i] for r in held], "<i8") for i in (1, 2))
            row = [held[0][0], int(ids[0]), ids.tobytes(), labels.tobytes(), b"".join(r[3] for r in held)]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["cell", "block", "ids", "labels", "vs"])

        for batch in batches:
            for r in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if held and (held[0][0] != r[0] or len(held) >= BLOCK):
                    yield out()
                held.append(r)
        if held:
            yield out()

    rows = cells.select("cell", "vec_id", "label", "v")
    ranged = rows.repartitionByRange("cell", "vec_id").sortWithinPartitions("cell", "vec_id")
    return ranged.mapInArrow(pack, "cell int, block long, ids binary, labels binary, vs binary")


def _reach(sp: Space, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(most, least): bounds on the scores of each anchor with the rows of each cell."""
    if not len(sp.pivots):
        return np.full((len(a), 1), np.inf), np.full((len(a), 1), -np.inf)
    square = np.einsum("ij,ij->i", a, a)
    d = _distances(sp, a, np.zeros(len(a)))
    near = d.argmin(axis=1)
    between = np.sqrt(np.maximum(1e-12, ((sp.pivots[near][:, None, :] - sp.pivots[None]) ** 2).sum(axis=2)))
    plane = (d**2 - d[np.arange(len(a)), near][:, None] ** 2) / (2 * between)
    plane[between < 1e-3] = 0
    least_d = np.maximum.reduce([np.zeros_like(d), d - sp.farthest, sp.nearest - d, plane])
    both = (square + sp.top)[:, None]
    slack = 1e-6 * both + 1
    return (both - least_d**2) / 2 + slack, (both - (d + np.maximum(sp.farthest, 0)) ** 2) / 2 - slack


def _slots(sp: Space, ids: np.ndarray, labels: np.ndarray, a: np.ndarray, bands: list[list[tuple]] | None, k: int) -> dict:
    """A group's anchors and their slots: the anchor's place, a key, the least and the largest score. Without `bands` each
    anchor has one slot, for rows of its label; else one for each (key, least, largest), for rows of other labels. The
    k-th best row of the sample that a slot might take proves a higher least score."""
    known = sp.scores(a, sp.sample)
    lowest, highest = (-np.inf, np.inf) if sp.exact else (-(1 << 63), (1 << 63) - 1)
    at, key, lo, hi = [], [], [], []
    for i in range(len(ids)):
        allowed = (sp.sample_labels == labels[i]) if bands is None else (sp.sample_labels != labels[i])
        mine = known[i][allowed & (sp.sample_ids != ids[i])]
        for slot, least, most in [(0, lowest, highest)] if bands is None else bands[i]:
            inside = mine[(mine >= least) & (mine <= most)]
            if len(inside) >= k:
                least = max(least, np.sort(inside)[len(inside) - k])
            at.append(i), key.append(slot), lo.append(least), hi.append(most)
    number = np.float64 if sp.exact else np.int64
    return {"ids": ids, "labels": labels, "a": a.astype(sp.kind), "at": np.array(at, np.int64), "key": np.array(key, np.int64), "lo": np.array(lo, number), "hi": np.array(hi, number), "same": bands is None}


def _groups(anchors: DataFrame, sp: Space, n_anchors: int, k: int) -> DataFrame:
    """(g, anchors): packs of neighbouring anchors with their slots. `anchors` has cell, vec_id, label, v and bands, which
    is null for the first join. Written."""
    shared = anchors.sparkSession.sparkContext.broadcast(sp)
    most = max(8, GROUP * math.isqrt(n_anchors))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, held = shared.value, []

        def out() -> pa.RecordBatch:
            ids, labels = (np.array([r[i] for r in held], np.int64) for i in (1, 2))
            a = s.unpack(b"".join(r[3] for r in held)).astype(np.float64)
            bands = None if held[0][4] is None else [[(b["positive_id"], -(-LOW * b["score"] // 100), HIGH * b["score"] // 100) for b in r[4]] for r in held]
            data = pickle.dumps(_slots(s, ids, labels, a, bands, k))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([int(ids[0])]), pa.array([data], pa.binary())], ["g", "anchors"])

        for batch in batches:
            for r in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                held.append(r)
                if len(held) >= most:
                    yield out()
        if held:
            yield out()

    rows = anchors.select("cell", "vec_id", "label", "v", "bands")
    ranged = rows.repartitionByRange(max(1, -(-n_anchors // most)), "cell", "vec_id").sortWithinPartitions("cell", "vec_id")
    return materialize(ranged.mapInArrow(pack, "g long, anchors binary"), "anchor-groups")


def needed(groups: DataFrame, sp: Space) -> DataFrame:
    """(g, cell): the cells that might serve an anchor of the group."""
    shared = groups.sparkSession.sparkContext.broadcast(sp)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared.value
        for batch in batches:
            for g, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = pickle.loads(data)
                wanted = np.zeros(max(1, len(s.pivots)), bool)
                for begin in range(0, len(x["a"]), 64):
                    most, least = _reach(s, x["a"][begin : begin + 64].astype(np.float64))
                    own = (x["at"] >= begin) & (x["at"] < begin + 64)
                    i = x["at"][own] - begin
                    wanted |= ((most[i] >= x["lo"][own].astype(np.float64)[:, None]) & (least[i] <= x["hi"][own].astype(np.float64)[:, None])).any(axis=0)
                found = np.flatnonzero(wanted).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), g)), pa.array(found)], ["g", "cell"])

    return groups.mapInArrow(cells, "g long, cell int")


def _merged(slot: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first k of each slot by score, largest first, then id."""
    order = np.lexsort((ids, -score if score.dtype == np.float64 else ~score, slot))
    slot, score, ids = slot[order], score[order], ids[order]
    first = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]]) if len(slot) else np.zeros(0, int)
    place = np.arange(len(slot)) - np.repeat(first, np.diff(np.r_[first, len(slot)]))
    keep = place < k
    return slot[keep], score[keep], ids[keep]


class _Best:
    """The best rows of each slot of one group so far."""

    def __init__(self, x: dict, k: int) -> None:
        self.x, self.k, self.floor = x, k, x["lo"].copy()
        self.slot, self.score, self.ids = np.zeros(0, np.int64), np.zeros(0, x["lo"].dtype), np.zeros(0, np.int64)

    def meet(self, sp: Space, ids: np.ndarray, labels: np.ndarray, v: np.ndarray) -> None:
        x = self.x
        s = sp.scores(x["a"], v)[x["at"]]
        same = x["labels"][x["at"]][:, None] == labels
        ok = (same if x["same"] else ~same) & (x["ids"][x["at"]][:, None] != ids) & (s >= self.floor[:, None]) & (s <= x["hi"][:, None])
        slot, at = np.nonzero(ok)
        if not len(slot):
            return
        self.slot, self.score, self.ids = _merged(np.r_[self.slot, slot], np.r_[self.score, s[slot, at]], np.r_[self.ids, ids[at]], self.k)
        full = np.flatnonzero(np.bincount(self.slot, minlength=len(x["at"])) == self.k)
        last = np.searchsorted(self.slot, full, "right") - 1
        self.floor[full] = np.maximum(self.floor[full], self.score[last])

    def rows(self) -> pa.RecordBatch:
        x = self.x
        columns = [x["ids"][x["at"][self.slot]], x["key"][self.slot], self.ids, self.score.astype(np.int64)]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["anchor_id", "slot", "vec_id", "score"])


@contextmanager
def _wide_rows(spark: SparkSession, rows: int = 64) -> Iterator[None]:
    """Python gets `rows` rows at a time while this lasts: the rows hold blocks, of some 100 KB each."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def joined(groups: DataFrame, packed: DataFrame, sp: Space, k: int) -> DataFrame:
    """(anchor_id, slot, vec_id, score, rank): the k best rows of each slot. Written."""
    shared = groups.sparkSession.sparkContext.broadcast(sp)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, at, best = shared.value, None, None
        for batch in batches:
            for i in range(batch.num_rows):
                g = batch.column(0)[i].as_py()
                if g != at:
                    if best is not None:
                        yield best.rows()
                    at, best = g, _Best(pickle.loads(batch.column(1)[i].as_py()), k)
                ids, labels = (np.frombuffer(batch.column(c)[i].as_py(), "<i8") for c in (2, 3))
                best.meet(s, ids, labels, s.unpack(batch.column(4)[i].as_py()))
        if best is not None:
            yield best.rows()

    replicas = packed.join(needed(groups, sp), "cell").withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(SALTS)).cast("int"))
    salted = groups.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    pairs = replicas.join(salted, ["g", "salt"]).select("g", "anchors", "ids", "labels", "vs")
    parts = pairs.mapInArrow(local, "anchor_id long, slot long, vec_id long, score long")
    ranked = parts.withColumn("rank", F.row_number().over(W.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "vec_id")))
    with _wide_rows(groups.sparkSession):
        return materialize(ranked.filter(F.col("rank") <= k), "voronoi-best")


def is_anchor(vec_id: Column) -> Column:
    return vec_id % EVERY == 0


def mine(embeddings: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    spark = embeddings.sparkSession
    rows = materialize(prepared(spread(embeddings)), "usable-vectors")
    sp = space(rows)
    if sp is None:
        return spark.createDataFrame([], schema)
    cells = assigned(rows, sp)
    sp = _with_bounds(cells, sp)
    packed = materialize(blocks(cells), "voronoi-blocks")
    anchors = cells.filter(is_anchor(F.col("vec_id")))
    n = anchors.count()
    if not n:
        return spark.createDataFrame([], schema)
    bands = "array<struct<positive_id: long, score: long>>"
    best = joined(_groups(anchors.withColumn("bands", F.lit(None).cast(bands)), sp, n, positives), packed, sp, positives)
    found = best.groupBy("anchor_id").agg(F.collect_list(F.struct(F.col("vec_id").alias("positive_id"), "score")).alias("bands"))
    second = anchors.join(found, anchors.vec_id == found.anchor_id).drop("anchor_id")
    worst = joined(_groups(second, sp, n, negatives), packed, sp, negatives)
    pairs = best.select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    named = worst.select("anchor_id", F.col("slot").alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return named.join(pairs, ["anchor_id", "positive_id"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def oracle() -> str:
    """The same rows as DuckDB SQL, by all pairs of anchors and rows."""
    return f"""
WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM (
    SELECT vec_id, CASE WHEN vec_id % {SHIFTED} = 0 THEN (label + 1) % {LABELS} ELSE label END::BIGINT AS label, embedding FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  ) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY label, embedding) = 1),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, coalesce(list_sum(list_transform(list_zip(a.v, b.v), lambda z: coalesce(z[1] * z[2], 0))), 0)::BIGINT AS score
  FROM e a JOIN e b ON a.vec_id % {EVERY} = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES}),
n AS (SELECT anchor_id, positive_id, positive_score, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)::INT AS rank
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND {LOW} * positive_score <= 100 * score AND 100 * score <= {HIGH} * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= {NEGATIVES}
"""
