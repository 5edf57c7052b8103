"""Near-duplicate documents by a chosen-path set similarity join over minwise tokens.

A document is the set of its 5-word shingles, and its signature the `TOKENS` minwise tokens of that set. A tree
branches the documents recursively: at each node one or two positions of the signature are chosen (by the path's hash,
1 / `SIMILARITY` of them on average, two from `DEPTH` levels on), and a document follows, for each, the branch of its
token there. Small nodes (`SMALL` documents, `LEAF` from the last of `DEPTH` levels on) are compared exhaustively by
their signatures. Larger ones are branched on, at any depth, until they are small, or coherent: a node where
`COHERENT` of the pairs are likely holds documents that are mostly alike, which no position tells apart. Independent
trees are repeated: two documents that are just similar enough share a leaf of one tree with probability 0.54 at worst
(three levels), so `TREES` = 8 trees miss 0.2 percent of them in the densest nodes, and far less in others.

Links are always confirmed on the full sets, and nothing is left out for an unconfirmed one:

    forests    each node gives a spanning forest of its likely pairs, likeliest ones first, so a group's copies are
               never expanded into pairs, and a tree's further likely pairs if they are no more than its documents; a
               coherent node gives those of its blocks of `BLOCK`, tied by common leaders
    confirm    all these pairs, and components of those that hold
    open       where a pair of a tree has failed and the tree has more likely pairs than it gave, or a coherent node isn't tied,
               the full set of each document outside the node's largest component is compared with all of the tree or
               node, in blocks that are dealt out, and what connects them is a link

The work on open nodes grows with the product of both numbers, but only where confirmed links left documents apart; what
it returns grows with the documents. Documents of equal sets are folded before, and components are found by contraction.

Defined results: a null or empty text, or one without words, has an empty set and is linked with nothing; fewer than 5
words are one shingle; a null doc_id is larger than any other; rows that share a doc_id share their links; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamdex.llm import anchors
from loamdex.llm.anchors import LAST
from loamdex.llm.common import sub_batches, text_slices
from loamdex.session import materialize

SHINGLE = 5
SIMILARITY = 75  # percent
TOKENS, TREES, DEPTH, SMALL = 64, 8, 3, 24
#: Equal tokens from which a pair is likely: 4.6 deviations below the similarity.
LIKELY = 32
#: Documents, and shingles on average, of a block of a large node.
BLOCK, BLOCK_SHINGLES = 512, 500_000
#: Documents of a node that one task compares by signatures, from the last of `DEPTH` levels on.
LEAF = 2048
#: Share of likely pairs from which a large node isn't branched on, and the level from which none is.
COHERENT, DEEPEST = 0.5, 64
BATCH_BYTES = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_FACTORS = anchors.mix(np.arange(1, TOKENS + 1, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's shingles."""
    data = _LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
    begin, end = anchors.word_spans(data)
    words = anchors.word_values(data, begin, end)
    bound = np.searchsorted(begin, np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))))
    rolled = anchors.rolling(words, SHINGLE) if len(words) >= SHINGLE else np.zeros(0, np.uint64)
    out, b = [], 0
    for e in bound.tolist():
        if e - b >= SHINGLE:
            out.append(np.unique(rolled[b : e - SHINGLE + 1]))
        elif e > b:
            out.append(anchors.mix(anchors.rolling(words[b:e], e - b) + np.uint64(e - b)))
        else:
            out.append(np.zeros(0, np.uint64))
        b = e
    return out


def signatures(texts: DataFrame) -> DataFrame:
    """(id, n, set_hi, set_lo, tokens, short): size and 128-bit digest of the set, its minwise tokens of 32 bits each, and
    eight bits of each, enough to compare."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data in text_slices(batch, 1, BATCH_BYTES):
                sets = shingle_sets(data)
                sizes = np.fromiter(map(len, sets), np.int64, len(sets))
                full = np.flatnonzero(sizes)
                tokens = np.zeros((len(sets), TOKENS), np.uint32)
                if len(full):
                    joined, starts = np.concatenate(sets), (np.cumsum(sizes) - sizes)[full]
                    for i in range(TOKENS):
                        tokens[full, i] = np.minimum.reduceat(joined * _FACTORS[i], starts) >> np.uint64(32)
                digests = [np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), "<i8") for s in sets]
                columns = [
                    part.column(0), pa.array(sizes), pa.array([int(d[0]) for d in digests], pa.int64()), pa.array([int(d[1]) for d in digests], pa.int64()),
                    pa.array([t.tobytes() for t in tokens], pa.binary()), pa.array([t.tobytes() for t in tokens.astype(np.uint8)], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["id", "n", "set_hi", "set_lo", "tokens", "short"])

    return texts.mapInArrow(run, "id long, n long, set_hi long, set_lo long, tokens binary, short binary")


def _tokens(column: pa.Array, kind: str = "<u4") -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1) if len(column) else np.zeros((0, TOKENS), kind)


def branch(rows: DataFrame, level: int, trees: int = TREES) -> DataFrame:
    """(node, id): the branches that each row (id, tokens and, below the root, node) follows."""

    def chosen(path: int) -> list[int]:
        """One position, and in a third of the paths a second one; two from `DEPTH` levels on, where each must go on."""
        h = xxhash.xxh64_intdigest(path.to_bytes(8, "little", signed=True), seed=level)
        more = level >= DEPTH or (h >> 32) % 3 == 0
        return [h % TOKENS, *([(h + 1 + (h // TOKENS) % (TOKENS - 1)) % TOKENS] if more else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tokens = batch.column(0).to_numpy(), _tokens(batch.column(1)).astype(np.uint64)
            parents = np.zeros(len(ids), np.int64) if level == 0 else batch.column(2).to_numpy()
            paths, rows_of, at = [], [], []
            if level == 0:
                for tree in range(trees):
                    for i in {*chosen(tree), *chosen(tree + trees)}:
                        rows_of.append(np.arange(len(ids)))
                        at.append(np.full(len(ids), i))
                        paths.append(np.full(len(ids), tree + 1))
            else:
                groups, inverse = np.unique(parents, return_inverse=True)
                choices = [chosen(int(g)) for g in groups]
                for n in (0, 1):
                    one = np.array([c[n] if len(c) > n else -1 for c in choices], np.int64)[inverse]
                    rows_of.append(np.flatnonzero(one >= 0))
                    at.append(one[one >= 0])
                    paths.append(parents[one >= 0])
            r, i, p = np.concatenate(rows_of), np.concatenate(at), np.concatenate(paths)
            node = anchors.mix(anchors.mix(p.view(np.uint64) * np.uint64(2 * TREES + 1) + i.astype(np.uint64)) ^ (tokens[r, i] + np.uint64(level << 40)))
            yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), pa.array(ids[r])], ["node", "id"])

    return rows.select(*(["id", "tokens"] if level == 0 else ["id", "tokens", "node"])).mapInArrow(run, "node long, id long")


def forest(tokens: np.ndarray) -> tuple[list[tuple[int, int, int]], np.ndarray, np.ndarray]:
    """A spanning forest of likely pairs, likeliest ones first, as (row, row, equal tokens), the tree of each row (its
    first row), and with how many rows each makes a likely pair."""
    m = len(tokens)
    tree, likely = np.arange(m), np.zeros(m, np.int64)
    if m <= 2 * SMALL:
        equal = np.count_nonzero(tokens[:, None] == tokens[None], axis=2)
        likely = (equal >= LIKELY).sum(1) - 1
        if not likely.any():
            return [], tree, likely
    edges, open_, best, parent = [], np.ones(m, bool), np.full(m, -1), np.zeros(m, np.int64)
    for _ in range(m):
        i = int(np.argmax(np.where(open_, best, -2)))
        if best[i] >= LIKELY:
            edges.append((int(parent[i]), i, int(best[i])))
            tree[i] = tree[parent[i]]
        else:
            i = int(np.argmax(open_))
        row = equal[i] if m <= 2 * SMALL else np.count_nonzero(tokens == tokens[i], axis=1)
        likely[i] = np.count_nonzero(row >= LIKELY) - 1
        open_[i] = False
        better = open_ & (row > best)
        best[better], parent[better] = row[better], i
    return edges, tree, likely


PAIR, TREE, BLOCKS = 0, 1, 2
_FOUND = "kind int, g long, a long, b long, n long, ids array<long>"


def compare(rows: DataFrame) -> DataFrame:
    """What the signatures of each node's documents tell. `rows` is (node, block, id, short); a node that isn't split has
    the block -1. A node of n documents gives 3 n rows at most:

        PAIR    g (tree of a node, or a split node), a < b, n equal tokens: the pairs of the forest
        TREE    g, ids: a tree of a node that isn't split, with more likely pairs than are given
        BLOCKS  g (a split node), a trees of the block, b likely pairs of n pairs
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, tokens = None, [], []
        out: list[tuple] = []

        def settle() -> None:
            if len(ids) < 2:
                return
            node, split = now[0], now[1] >= 0
            edges, tree, likely = forest(np.stack(tokens))
            if split:
                m = len(ids)
                out.append((BLOCKS, node, m - len(edges), int(likely.sum()) // 2, m * (m - 1) // 2, None))
            if not edges:
                return
            roots, member = np.unique(tree, return_inverse=True)
            name = [node if split else xxhash.xxh64_intdigest(f"{node}:{ids[r]}".encode()) - (1 << 63) for r in roots.tolist()]
            for i, j, n in edges:
                if ids[i] != ids[j]:
                    out.append((PAIR, name[member[i]], min(ids[i], ids[j]), max(ids[i], ids[j]), n, None))
            if not split:
                all_, size = np.bincount(member, likely) / 2, np.bincount(member)
                for t in np.flatnonzero(all_ > size - 1).tolist():
                    rows_ = np.flatnonzero(member == t)
                    if all_[t] > 2 * size[t] - 1:
                        out.append((TREE, name[t], None, None, None, sorted({ids[r] for r in rows_.tolist()})))
                        continue
                    for x, i in enumerate(rows_.tolist()):
                        equal = np.count_nonzero(np.stack([tokens[r] for r in rows_[x + 1 :].tolist()] or [tokens[i]]) == tokens[i], axis=1)
                        for j, n in zip(rows_[x + 1 :].tolist(), equal.tolist(), strict=False):
                            if n >= LIKELY and ids[i] != ids[j]:
                                out.append((PAIR, name[t], min(ids[i], ids[j]), max(ids[i], ids[j]), n, None))

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [()] * 6
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
            made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["kind", "g", "a", "b", "n", "ids"])
            out.clear()
            return made

        for batch in batches:
            short = _tokens(batch.column(3), "u1")
            for r, (node, block, id_) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True)):
                if (node, block) != now:
                    settle()
                    now = (node, block)
                    ids.clear()
                    tokens.clear()
                ids.append(id_)
                tokens.append(short[r])
            yield flush()
        settle()
        yield flush()

    ordered = rows.select("node", "block", "id", "short").repartition("node", "block").sortWithinPartitions("node", "block", "id")
    return ordered.mapInArrow(run, _FOUND)


def split(large: DataFrame, block: int) -> DataFrame:
    """(node, block, id, short): each node of `large` (node, size, id, short) in blocks of about `block` documents, and
    its leaders in each of them."""
    blocks, order = F.ceil(F.col("size") / block), F.xxhash64("id", "node")
    own = large.select("node", F.pmod(F.xxhash64("id", "node", F.lit(1)), blocks).cast("int").alias("block"), "id", "short")
    leader = F.struct(order.alias("h"), F.col("id"), F.col("short"))
    leaders = large.groupBy("node").agg(F.min(leader).alias("x"), F.max(leader).alias("y"), F.min(F.struct(F.col("id"), F.lit(0).alias("h"), F.col("short"))).alias("z"), F.max(blocks).alias("blocks"))
    leaders = leaders.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)))
    each = F.explode(F.array(*[F.struct(F.col(f"{c}.id").alias("id"), F.col(f"{c}.short").alias("short")) for c in "xyz"]))
    return own.union(leaders.select("node", "block", each.alias("l")).select("node", "block", "l.id", "l.short"))


def compare_open(rows: DataFrame, labels: DataFrame, reps: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b) of confirmed links that connect the components in each block of a node, of all its pairs that lie across
    components. `rows` is (node, id), `labels` (id, label); a node of one component has none."""
    rows = rows.join(labels, "id", "left").join(reps.select("id", "n"), "id").select("node", "id", "n", F.coalesce("label", "id").alias("label"))
    rows = materialize(rows, "open-labels")
    sizes = rows.groupBy("node", "label").agg(F.count("*").alias("size"), F.sum("n").alias("n"))
    sizes = sizes.groupBy("node").agg(F.max(F.struct("size", "label", "n")).alias("main"), F.sum("size").alias("size"), F.sum("n").alias("n")).filter("size > main.size")
    blocks = lambda size, n: F.greatest(F.ceil(size / BLOCK), F.ceil(n / BLOCK_SHINGLES))
    few = blocks(F.col("size") - F.col("main.size"), F.col("n") - F.col("main.n"))
    # Written, so that the join below is one of two plain shuffles, whose skewed parts can be split.
    sizes = materialize(sizes.select("node", F.col("main.label").alias("main"), blocks(F.col("size"), F.col("n")).alias("all"), few.alias("few")), "open-sizes")
    rows = rows.join(sizes, "node").select("node", "id", "label", "all", "few", (F.col("label") != F.col("main")).alias("outside"))
    to = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    probes = rows.filter("outside").select("node", F.pmod(F.xxhash64("id"), "few").alias("x"), to("all").alias("y"), "id", "label", F.lit(True).alias("probe"))
    others = rows.select("node", to("few").alias("x"), F.pmod(F.xxhash64("id"), "all").alias("y"), "id", "label", F.lit(False).alias("probe"))
    # An id's classes are one row each, and all its texts meet, as in `confirm`.
    met = materialize(probes.union(others).distinct(), "open-blocks")
    own = materialize(texts.join(met.select("id").distinct().hint("merge"), "id"), "open-texts")

    def run(block: pa.Table) -> pa.Table:
        sets = shingle_sets(block["text"].cast(pa.binary()).to_pylist())
        full = [i for i, s in enumerate(sets) if len(s)]
        ids, labels, probe = (block[c].to_numpy()[full] for c in ("id", "label", "probe"))
        sets = [sets[i] for i in full]
        sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        inverse = sets and np.split(np.unique(np.concatenate(sets), return_inverse=True)[1], np.cumsum(sizes)[:-1])
        at = np.flatnonzero(~probe)
        out: tuple[list, list] = ([], [])
        if len(at):
            joined, starts = np.concatenate([inverse[i] for i in at]), np.cumsum(sizes[at]) - sizes[at]
            groups = np.unique(labels, return_inverse=True)[1]
            root = np.arange(len(groups))
            mark = np.zeros(sizes.sum(), np.int32)
            for i in np.flatnonzero(probe).tolist():
                mark[inverse[i]] = 1
                common = np.add.reduceat(mark[joined], starts)
                mark[inverse[i]] = 0
                similar = 100 * common >= SIMILARITY * (sizes[i] + sizes[at] - common)
                for j in at[similar & (root[groups[at]] != root[groups[i]])].tolist():
                    x, y = root[groups[j]], root[groups[i]]
                    if x != y:
                        root[root == x] = y
                        out[0].append(min(ids[i], ids[j]))
                        out[1].append(max(ids[i], ids[j]))
        return pa.table({"a": pa.array(out[0], pa.int64()), "b": pa.array(out[1], pa.int64())})

    return met.hint("merge").join(own, "id").select("node", "x", "y", "id", "label", "probe", "text").groupBy("node", "x", "y").applyInArrow(run, "a long, b long")


def candidates(reps: DataFrame, leaf: int = LEAF) -> tuple[DataFrame, DataFrame | None]:
    """What `compare` found in all nodes, and (node, id) of the coherent ones. `reps` is (id, tokens, short, n), written."""
    found, coherent, rows, level = [], [], reps, 0
    while True:
        last = level >= DEPTH - 1
        small = leaf if last else min(SMALL, leaf)
        nodes = materialize(branch(rows, level), "path-nodes")
        sizes = nodes.groupBy("node").agg(F.count("*").alias("size")).filter("size > 1")
        nodes = materialize(nodes.join(sizes, "node"), "path-level")
        leaves = nodes.filter(F.col("size") <= small).join(reps.select("id", "short"), "id").withColumn("block", F.lit(-1))
        found.append(materialize(compare(leaves), "path-found"))
        large = materialize(nodes.filter(F.col("size") > small).join(reps, "id").select("id", "tokens", "node", "short", "size"), "path-large")
        if large.isEmpty():
            break
        if last:
            met = materialize(compare(split(large, min(BLOCK, leaf))), "path-found")
            found.append(met)
            share = met.filter(F.col("kind") == BLOCKS).groupBy(F.col("g").alias("node")).agg((F.sum("b") / F.sum("n")).alias("share"))
            alike = materialize(share.filter(F.lit(level >= DEEPEST) | (F.col("share") >= COHERENT)).select("node"), "path-coherent")
            coherent.append(large.join(alike, "node", "left_semi").select("node", "id"))
            large = materialize(large.join(alike, "node", "left_anti"), "path-large")
            if large.isEmpty():
                break
        rows, level = large, level + 1
    return _union(found), _union(coherent)


def _union(frames: list[DataFrame]) -> DataFrame | None:
    out = None
    for frame in frames:
        out = frame if out is None else out.unionByName(frame)
    return out


def confirm(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b) of the pairs whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            left, right = batch.column(2), batch.column(3)
            size = pc.add(pc.binary_length(left), pc.binary_length(right)).to_pylist()
            for b, e in sub_batches(size, BATCH_BYTES):
                sets = shingle_sets([t for side in (left, right) for t in side.slice(b, e - b).cast(pa.binary()).to_pylist()])
                for k in range(e - b):
                    x, y = sets[k], sets[k + e - b]
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    good.append(common > 0 and 100 * common >= SIMILARITY * (len(x) + len(y) - common))
            mask = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])

    # Always by a sorted merge: neither side has a bound, and the plan is the same at every size.
    x = pairs.select("a", "b").hint("merge").join(texts.select(F.col("id").alias("a"), F.col("text").alias("x")), "a")
    return x.hint("merge").join(texts.select(F.col("id").alias("b"), F.col("text").alias("y")), "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(id, label): the least id reachable, of all ids that have an edge.

    Large-star and small-star steps alternate until nothing changes: each links a node's neighbours to the least one
    among them, which keeps the components and ends in stars.
    """
    edges = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    while True:
        before = edges.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first()
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").filter("u <> v")
        edges = materialize(small.distinct(), "links")
        if edges.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first() == before:
            break
    return edges.select(F.col("u").alias("id"), F.col("v").alias("label")).union(edges.select(F.col("v").alias("id"), F.col("v").alias("label"))).groupBy("id").agg(F.min("label").alias("label"))


def across(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs that lie across components."""
    label = lambda side: labels.select(F.col("id").alias(side), F.col("label").alias(f"{side}_label"))
    left = pairs.join(label("a"), "a", "left").join(label("b"), "b", "left")
    return left.filter(F.coalesce("a_label", "a") != F.coalesce("b_label", "b")).select(*pairs.columns)


def pair_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    wanted = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    return materialize(texts.join(wanted.hint("merge"), "id"), "pair-texts")


def group(docs: DataFrame, leaf: int = LEAF) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of `docs`."""
    texts = anchors.narrow(docs)
    signed = materialize(signatures(texts), "signatures")
    classes = materialize(signed.filter("n > 0").groupBy("set_hi", "set_lo").agg(F.min(F.struct("id", "tokens", "short", "n")).alias("r")).select("set_hi", "set_lo", "r.*"), "set-classes")
    reps = classes.select("id", "tokens", "short", "n")
    found, coherent = candidates(reps, leaf)
    trees = found.filter(F.col("kind") == PAIR).select("g", "a", "b")
    pairs = materialize(trees.select("a", "b").distinct(), "pairs")
    links = materialize(confirm(pairs, pair_texts(pairs, texts)), "confirmed")
    labels = components(links)
    # A tree whose pairs are all within components is within one; else its further likely pairs are compared.
    failed = materialize(trees.join(across(pairs, labels).select("a", "b"), ["a", "b"]).select("g").distinct(), "failed")
    # Trees of the same documents are one.
    wanted = found.filter(F.col("kind") == TREE).join(failed, "g", "left_semi").groupBy("ids").agg(F.min("g").alias("node"))
    wanted = wanted.select("node", F.explode("ids").alias("id"))
    if coherent is not None:
        untied = found.filter((F.col("kind") == BLOCKS) & (F.col("a") > 1)).select("g").union(failed).distinct()
        wanted = wanted.union(coherent.join(untied.withColumnRenamed("g", "node"), "node", "left_semi").select("node", "id"))
    wanted = materialize(wanted, "open")
    if not wanted.isEmpty():
        more = materialize(compare_open(wanted, labels, reps, texts), "confirmed")
        if not more.isEmpty():
            labels = components(links.union(more))
    sets = signed.filter("n > 0").select("id", "n", "set_hi", "set_lo").join(classes.select("set_hi", "set_lo", F.col("id").alias("rep")), ["set_hi", "set_lo"])
    found = sets.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("id", "n", F.coalesce("label", "rep").alias("component"))
    found = found.union(signed.filter("n = 0").select("id", "n", F.col("id").alias("component")))
    null_last = lambda c: F.when(F.col(c) != LAST, F.col(c))
    return found.select(null_last("id").alias("doc_id"), F.col("n").alias("n_shingles"), null_last("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))
