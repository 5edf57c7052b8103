"""The search index: positional postings in blocks with maxima, of which a search reads few.

Documents are dealt to slots by a hash of their ids, about `SLOT_DOCS` to each. A block has the postings of one term in one
slot, and beside them the largest frequencies and the least length in it. Sums over these give the most that a document
of a slot can score for a query, so that only the slots are read that can hold one of the best k (block-maximum pruning):
first the most promising ones, whose k-th score is the floor, then what can still reach it. Heads and postings are columns
of one table that is ranged by term and slot, so that heads are read without postings and both are pruned by term.

Document frequencies are sums over heads, not kept in postings: a change rewrites the blocks of the slots it touches.

What the analyser splits out of one word of a query must stand together in a field, as a phrase: its frequency is the
number of places where it does.
"""

from __future__ import annotations

import functools
import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamdex.functions import analysis
from loamdex.operators.index import ID_TOKENS
from loamdex.session import materialize

#: Documents of a slot, on average; slots are dealt anew when there are twice as many.
SLOT_DOCS = 128
#: Slots that are read for the floor.
FIRST = 8
#: Blocks that are read at once, as finding out which to leave costs more.
FEW = 1024
#: Places of a score that count in the order; what sums of doubles differ by otherwise is no order.
PLACES = 9
#: Terms whose frequencies an open index keeps.
KEPT_TERMS = 10_000
#: Postings that a task hands on at once, at least.
_HELD = 100_000

K1, B = 1.2, 0.75
TITLE_WEIGHT, BODY_WEIGHT = 5.0, 1.0
LEAST_IDF = 1e-6

HEAD = ("term", "slot", "n", "n_title", "n_body", "max_title", "max_body", "least_length")
Unit = tuple[str, ...]


@dataclass
class BlockIndex:
    """blocks: HEAD and `postings`, an array of (doc_id, length, tf_title, tf_body, title_at, body_at) by doc_id. lengths:
    (slot, doc_id, length) of all documents. totals: one row of (n_docs, total_length, slots)."""

    blocks: DataFrame
    lengths: DataFrame
    totals: DataFrame
    _stats: tuple[int, float, int] | None = field(default=None, repr=False)
    _terms: dict[str, tuple[int, ...]] = field(default_factory=dict, repr=False)

    def frequencies(self, terms: list[str]) -> dict[str, tuple[int, ...]]:
        """(documents, with it in the title, in the body, blocks) of each term. What an open index has been asked for is
        kept, `KEPT_TERMS` terms at most, so that a search service asks for a common term once."""
        missing = [t for t in terms if t not in self._terms]
        if missing:
            if len(self._terms) + len(missing) > KEPT_TERMS:
                self._terms.clear()
                missing = terms
            found = _frequencies(self.blocks.filter(F.col("term").isin(missing)))
            self._terms |= {t: found.get(t, (0, 0, 0, 0)) for t in missing}
        return {t: self._terms[t] for t in terms}

    def stats(self) -> tuple[int, float, int]:
        """(number of documents, average length, slots), read once."""
        if self._stats is None:
            row = self.totals.first()
            self._stats = (row.n_docs, (row.total_length or 0) / max(1, row.n_docs) or 1.0, row.slots)
        return self._stats


def _frequencies(blocks: DataFrame) -> dict[str, tuple[int, ...]]:
    """By term; for the blocks of a few terms."""
    rows = blocks.groupBy("term").agg(*[F.sum(c) for c in ("n", "n_title", "n_body")], F.count("*")).collect()
    return {r[0]: tuple(r[1:]) for r in rows}


def slot_of(doc_id: str, slots: int) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(slots))


def postings(docs: DataFrame, slots: int) -> DataFrame:
    """(doc_id, slot, term, length, title_at, body_at): a row for each document and term; and one without a term for each
    document. The texts go through one Arrow stage, which stems a word that it has met before only once."""
    words = docs.select("doc_id", slot_of("doc_id", slots).alias("slot"), analysis.raw_words(F.col("title")).alias("t"), analysis.raw_words(F.col("body")).alias("b"))
    kind = T.StructType([docs.schema["doc_id"], *T.StructType.fromDDL("slot long, term string, length int, title_at array<int>, body_at array<int>").fields])
    names = kind.names

    def analyse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, str] = {}

        def stems(words: list[str]) -> list[str]:
            for w in words:
                if w not in known:
                    known[w] = analysis.stem(w)
            return [s for s in map(known.__getitem__, words) if s]

        def out(rows: list[tuple], ids: pa.DataType) -> pa.RecordBatch:
            kinds = (ids, pa.int64(), pa.string(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in batches:
            rows: list[tuple] = []
            for i, slot, *texts in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                at: dict[str, tuple[list[int], list[int]]] = {}
                length = ID_TOKENS
                for which, text in enumerate(texts):
                    found = stems(text)
                    length += len(found)
                    for place, term in enumerate(found):
                        at.setdefault(term, ([], []))[which].append(place)
                rows.append((i, slot, None, length, [], []))
                rows += [(i, slot, term, length, *both) for term, both in at.items()]
                if len(rows) >= _HELD:
                    yield out(rows, batch.column(0).type)
                    rows = []
            if len(known) > 500_000:
                known.clear()
            if rows:
                yield out(rows, batch.column(0).type)

    return words.mapInArrow(analyse, kind)


def _blocks(rows: DataFrame) -> DataFrame:
    """From (slot, term, doc_id, length, tf_title, tf_body, title_at, body_at); a block has a slot's documents at most."""
    one = F.struct("doc_id", "length", "tf_title", "tf_body", "title_at", "body_at")
    return rows.groupBy("term", "slot").agg(
        F.count("*").alias("n"), F.count_if(F.col("tf_title") > 0).alias("n_title"), F.count_if(F.col("tf_body") > 0).alias("n_body"),
        F.max("tf_title").alias("max_title"), F.max("tf_body").alias("max_body"), F.min("length").alias("least_length"), F.sort_array(F.collect_list(one)).alias("postings"),
    )


def _counted(rows: DataFrame) -> DataFrame:
    return rows.filter("term IS NOT NULL").withColumn("tf_title", F.size("title_at")).withColumn("tf_body", F.size("body_at"))


def _totals(lengths: DataFrame, slots: int) -> DataFrame:
    return lengths.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("length"), F.lit(0)).alias("total_length")).withColumn("slots", F.lit(slots))


def _slot_blocks() -> Callable[[pa.Table], pa.Table]:
    """A slot's documents to its blocks, and one block of no term that has the length of each document."""
    known: dict[str, str] = {}

    def stems(words: list[str]) -> list[str]:
        for w in words:
            if w not in known:
                known[w] = analysis.stem(w)
        return [s for s in map(known.__getitem__, words) if s]

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("doc_id")
        if len(known) > 500_000:
            known.clear()
        found: dict[str | None, list[tuple]] = {None: []}
        for i, texts in enumerate(zip(table["t"].to_pylist(), table["b"].to_pylist(), strict=True)):
            at: dict[str, tuple[list[int], list[int]]] = {}
            length = ID_TOKENS
            for which, words in enumerate(map(stems, texts)):
                length += len(words)
                for place, term in enumerate(words):
                    at.setdefault(term, ([], []))[which].append(place)
            found[None].append((i, length, [], []))
            for term, both in at.items():
                found.setdefault(term, []).append((i, length, *both))
        rows = [r for rs in found.values() for r in rs]
        at, length, title, body = zip(*rows, strict=True)
        places = pa.list_(pa.int32())
        tf = [pa.array([len(x) for x in f], pa.int32()) for f in (title, body)]
        items = [table["doc_id"].combine_chunks().take(pa.array(at)), pa.array(length, pa.int32()), *tf, pa.array(title, places), pa.array(body, places)]
        offsets = [0]
        for rs in found.values():
            offsets.append(offsets[-1] + len(rs))
        postings = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(items, ["doc_id", "length", "tf_title", "tf_body", "title_at", "body_at"]))
        heads = [(len(rs), sum(map(bool, t)), sum(map(bool, b)), max(map(len, t)), max(map(len, b)), min(n)) for rs in found.values() for _, n, t, b in [tuple(zip(*rs, strict=True))]]
        n, n_title, n_body, max_title, max_body, least = zip(*heads, strict=True)
        slot = table["slot"][0].as_py()
        columns = [pa.array(list(found), pa.string()), pa.array([slot] * len(found), pa.int64()), *(pa.array(c, pa.int64()) for c in (n, n_title, n_body)), *(pa.array(c, pa.int32()) for c in (max_title, max_body, least)), postings]
        return pa.table(columns, [*HEAD, "postings"])

    return run


def build(docs: DataFrame, slot_docs: int = SLOT_DOCS) -> BlockIndex:
    """The index of rows with doc_id, title and body. Texts are brought together by slot, each once, so a task makes whole
    blocks and no posting is shuffled. Written."""
    slots = max(1, math.ceil(docs.count() / slot_docs))
    kind = dict(docs.dtypes)["doc_id"]
    dealt = docs.select("doc_id", "title", "body", slot_of("doc_id", slots).alias("slot")).repartition("slot")
    words = dealt.select("doc_id", "slot", analysis.raw_words(F.col("title")).alias("t"), analysis.raw_words(F.col("body")).alias("b"))
    schema = f"""term string, slot long, n long, n_title long, n_body long, max_title int, max_body int, least_length int,
        postings array<struct<doc_id: {kind}, length: int, tf_title: int, tf_body: int, title_at: array<int>, body_at: array<int>>>"""
    rows = materialize(words.groupBy("slot").applyInArrow(_slot_blocks(), schema), "blocks")
    lengths = rows.filter("term IS NULL").select("slot", F.explode("postings").alias("p")).select("slot", "p.doc_id", "p.length")
    return BlockIndex(rows.filter("term IS NOT NULL"), lengths, _totals(lengths, slots))


def refresh(stored: BlockIndex, changed: DataFrame, live: DataFrame, slot_docs: int = SLOT_DOCS) -> BlockIndex:
    """The index after a change: only the texts of `changed` are analysed, and only the blocks of slots with a changed or
    missing document are taken apart; the others are passed on as they are. `live` has the doc_id of all documents. If the
    documents have doubled, all are dealt to more slots."""
    slots = stored.stats()[2]
    wanted = math.ceil(live.count() / slot_docs)
    again = wanted > 2 * slots
    slots = wanted if again else slots
    fresh = materialize(postings(changed, slots), "positions")
    old = stored.lengths.withColumn("slot", slot_of("doc_id", slots)) if again else stored.lengths
    same = old.join(live.select("doc_id"), "doc_id", "left_semi").join(changed.select("doc_id"), "doc_id", "left_anti")
    lengths = materialize(same.select("slot", "doc_id", "length").unionByName(fresh.filter("term IS NULL").select("slot", "doc_id", "length")), "lengths")
    gone = old.join(same.select("doc_id"), "doc_id", "left_anti").select("slot")
    touched = materialize(gone.unionByName(fresh.select("slot")).distinct(), "touched-slots")
    opened = stored.blocks if again else stored.blocks.join(touched, "slot", "left_semi")
    rows = opened.select("term", "slot", F.explode("postings").alias("p")).select("term", "slot", "p.*")
    if again:
        rows = rows.withColumn("slot", slot_of("doc_id", slots))
    rows = rows.join(same.select("doc_id"), "doc_id", "left_semi").select("slot", "term", "doc_id", "length", "tf_title", "tf_body", "title_at", "body_at")
    new = _blocks(rows.unionByName(_counted(fresh).select(*rows.columns)))
    if not again:
        new = stored.blocks.join(touched, "slot", "left_anti").select(*new.columns).unionByName(new)
    return BlockIndex(materialize(new, "blocks"), lengths, _totals(lengths, slots))


def save(index: BlockIndex, path: str) -> None:
    """Ranged by term and slot, so that the terms of a query prune row groups by their statistics."""
    index.blocks.repartitionByRange("term", "slot").sortWithinPartitions("term", "slot").write.mode("overwrite").option("parquet.block.size", 16 << 20).parquet(f"{path}/blocks")
    index.lengths.write.mode("overwrite").parquet(f"{path}/lengths")
    index.totals.write.mode("overwrite").parquet(f"{path}/totals")


def load(spark: SparkSession, path: str) -> BlockIndex:
    return BlockIndex(*(spark.read.parquet(f"{path}/{name}") for name in ("blocks", "lengths", "totals")))


def _minus(k: int) -> Callable[[Column], Column]:
    return lambda x: x - k


def phrase_blocks(index: BlockIndex, phrase: Unit) -> DataFrame:
    """The blocks of a phrase under its own name: documents with its terms side by side in a field. Only slots that have
    blocks of all its terms are read."""
    terms = sorted(set(phrase))
    own = index.blocks.filter(F.col("term").isin(terms))
    slots = own.groupBy("slot").agg(F.count("*").alias("m")).filter(F.col("m") == len(terms)).select("slot")
    rows = own.join(slots, "slot", "left_semi").select("term", "slot", F.explode("postings").alias("p"))
    # A document has a row for each of the terms at most.
    places = [F.max(F.when(F.col("term") == t, F.col(f"p.{f}_at"))).alias(f"{f}{i}") for i, t in enumerate(terms) for f in ("title", "body")]
    both = rows.groupBy("slot", F.col("p.doc_id").alias("doc_id")).agg(F.max("p.length").alias("length"), F.count("*").alias("m"), *places).filter(F.col("m") == len(terms))

    def starts(f: str) -> Column:
        """Places at which the phrase begins: each term's places, moved back by its place in the phrase, have them."""
        moved = [F.transform(F.col(f"{f}{terms.index(t)}"), _minus(k)) for k, t in enumerate(phrase)]
        return functools.reduce(F.array_intersect, moved)

    at = both.select(F.lit(" ".join(phrase)).alias("term"), "slot", "doc_id", "length", starts("title").alias("title_at"), starts("body").alias("body_at"))
    return materialize(_blocks(_counted(at).filter("tf_title + tf_body > 0")), "phrase")


def by_score() -> Column:
    return F.round("bm25", PLACES)


def _part(tf: Column, length: Column, average: float) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.lit(average)))


@dataclass
class Scorer:
    """What a query asks of an index: the blocks of its units and their weights."""

    index: BlockIndex
    units: list[Unit]
    only: str | None = None
    title_weight: float = TITLE_WEIGHT
    body_weight: float = BODY_WEIGHT

    def __post_init__(self) -> None:
        self.weights = (self.title_weight * (self.only != "body"), self.body_weight * (self.only != "title"))
        times = Counter(" ".join(u) for u in self.units)
        single = sorted({u[0] for u in self.units if len(u) == 1})
        own, known = self.index.blocks.filter(F.col("term").isin(single)), dict(self.index.frequencies(single)) if single else {}
        for phrase in sorted({u for u in self.units if len(u) > 1}):
            found = phrase_blocks(self.index, phrase)
            own, known = own.unionByName(found), known | _frequencies(found)
        self.blocks = own.select(*HEAD, "postings")
        self.n_blocks = sum(x[3] for x in known.values())
        n_docs, self.average, _ = self.index.stats()
        df = {t: x[{"title": 1, "body": 2}.get(self.only or "", 0)] for t, x in known.items()}
        self.weight = {t: times[t] * max(math.log((n_docs - n + 0.5) / (n + 0.5)), LEAST_IDF) for t, n in df.items() if n}

    def _weighted(self, part: Column) -> Column:
        weight = F.lit(0.0)
        for term, w in self.weight.items():
            weight = F.when(F.col("term") == term, F.lit(w)).otherwise(weight)
        return weight * part

    def bounds(self) -> DataFrame:
        """(slot, bound): no document of the slot scores more. Reads heads alone."""
        most = self.weights[0] * F.col("max_title") + self.weights[1] * F.col("max_body")
        return self.blocks.groupBy("slot").agg(F.sum(self._weighted(_part(most, F.col("least_length"), self.average))).alias("bound")).filter("bound > 0")

    def scores(self, blocks: DataFrame | None = None) -> DataFrame:
        """(doc_id, bm25) of all documents of the blocks; lower is better."""
        rows = (self.blocks if blocks is None else blocks).select("term", F.explode("postings").alias("p"))
        tf = self.weights[0] * F.col("p.tf_title") + self.weights[1] * F.col("p.tf_body")
        hits = rows.select("term", F.col("p.doc_id").alias("doc_id"), tf.alias("tf"), F.col("p.length").alias("length")).filter("tf > 0")
        return hits.groupBy("doc_id").agg((-F.sum(self._weighted(_part(F.col("tf"), F.col("length"), self.average)))).alias("bm25"))


@dataclass
class Best:
    """The k best rows (doc_id, bm25), how many blocks the query has, and those of them that are read (a number, or a row
    for each)."""

    rows: DataFrame
    chosen: int | DataFrame
    blocks: int

    def read(self) -> int:
        return self.chosen if isinstance(self.chosen, int) else self.chosen.count()


def best(index: BlockIndex, units: list[Unit], k: int, allowed: DataFrame | None = None, only: str | None = None, first: int = FIRST, few: int = FEW) -> Best:
    """The k best documents, the same as by summing all postings; ties at `PLACES` places go to the smaller doc_id. `allowed` limits them to
    its doc_ids; statistics cover all. A query of `few` blocks at most reads them all at once."""
    scorer = Scorer(index, units, only)
    kept = lambda rows: rows if allowed is None else rows.join(allowed.select("doc_id"), "doc_id", "left_semi")
    if scorer.n_blocks <= few:
        return Best(kept(scorer.scores()).orderBy(by_score(), "doc_id").limit(k), scorer.n_blocks, scorer.n_blocks)
    bounds = scorer.bounds()
    top = [r.slot for r in bounds.orderBy(F.desc("bound"), "slot").limit(first).collect()]
    early = kept(scorer.scores(scorer.blocks.filter(F.col("slot").isin(top)))).orderBy(by_score(), "doc_id").limit(k)
    found = early.collect()  # k rows
    rest = bounds.filter(~F.col("slot").isin(top))
    if len(found) >= k:
        rest = rest.filter(F.col("bound") >= -found[-1].bm25 * (1 - 1e-9) - 2 * 10.0**-PLACES)  # what rounds to the floor
    later = scorer.blocks.join(rest.select("slot"), "slot", "left_semi")
    head = index.blocks.sparkSession.createDataFrame(found, early.schema)
    read = scorer.blocks.filter(F.col("slot").isin(top)).select("slot").unionByName(later.select("slot"))
    return Best(head.unionByName(kept(scorer.scores(later))).orderBy(by_score(), "doc_id").limit(k), read, scorer.n_blocks)


def all_scores(index: BlockIndex, units: list[Unit], only: str | None = None) -> DataFrame:
    """(doc_id, bm25) of every document that has a unit."""
    return Scorer(index, units, only).scores()
