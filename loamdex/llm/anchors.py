"""Anchored segments: how texts that share a window of units (bytes or words) are brought together without comparing all.

Every window of `window` units has an anchor, the gram of `gram` units with the least hash in it (the leftmost, of
equal ones). The anchor depends on the window's units alone, so equal windows have equal anchors, and neighbouring
windows mostly share theirs: a text has about one anchor in (window - gram + 2) / 2 units. A segment is what the
windows of one anchor cover. Anchors that occur once need no look at the text at all.

    occurrences   (fp, id) of all anchors, a narrow table                         one pass over the texts
    repeated      anchors that occur again, by a count with map-side sums         shuffle of fp
    candidates    the repeated anchors of each id                                 join on fp, which skew joins may split
    segments      (fp, id, tag, starts, segment), each once a text                join on id; anchors are found again
    solve         for each fp, in order of id and start: what is a repeat         shuffle of segments by fp
    apply         what remains of each text                                       join on id, the texts' shuffle is used again

An anchor with more than `HOT` occurrences is refined: its windows are dealt by longer contexts, of their left or
their right side, so that a short phrase that is everywhere doesn't bring all its texts to one task. Whole copies of a
smaller id's text leave after the count: each of their windows is a repeat. For `solve`, equal segments are folded where
they are cut: one that has an earlier equal in its task is a repeat as a whole, so a segment that a third of all texts
share is shuffled about once a task, and the runs of the others go along by their text, not by the anchor.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamdex.llm.common import text_slices
from loamdex.session import materialize

#: Stands for a null doc_id, which is larger than all others.
LAST = (1 << 63) - 1
HOT = 2048
#: Bytes of text that are hashed at once, and bytes of distinct segments that are solved at once (more, if one fp has more).
BATCH_BYTES, SOLVE_BYTES = 1 << 20, 1 << 20
#: Distinct segments that a task remembers when it folds; beyond that it starts anew, and more are left to `solve`.
FOLD = 1 << 16

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_LOW = np.uint64((1 << 20) - 1)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, _INVERSE)):
            p = np.full(n + n // 2, base, np.uint64)
            p[0] = 1
            _powers[i] = np.cumprod(p, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values (the finaliser of MurmurHash3)."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def rolling(values: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n values, by their place. Differences of a prefix sum, shifted to a common power."""
    up, down = _power(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mix((total[n:] - total[:-n]) * down[: len(values) - n + 1])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while have < width:
        step = min(have, width - have)
        x = np.minimum(x[:-step], x[step:])
        have += step
    return x


def anchors(values: np.ndarray, lengths: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of joined texts: fp, text, anchor's place, first and last window start, each for one anchor; places are joined ones."""
    n = len(values)
    if n < window:
        return (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 4)
    grams = rolling(values, gram)
    keys = (grams & ~_LOW) | (np.arange(len(grams), dtype=np.uint64) & _LOW)
    least = sliding_min(keys, window - gram + 1)
    ends = np.cumsum(lengths)
    start = np.arange(len(least))
    start = start[np.repeat(ends, lengths)[: len(least)] - start >= window]
    if not len(start):
        return (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 4)
    owner = start + ((least[start] & _LOW).astype(np.int64) - start & int(_LOW))
    first = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (start[1:] != start[:-1] + 1)]))
    last = np.append(first[1:], len(start)) - 1
    at = owner[first]
    return grams[at], np.searchsorted(ends, at, "right"), at, start[first], start[last]


_BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


class Bytes:
    """Units are the bytes of UTF-8."""

    name = "byte"
    count = staticmethod(len)

    @staticmethod
    def values(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return _BYTE_VALUES[np.frombuffer(b"".join(texts), np.uint8)], np.fromiter(map(len, texts), np.int64, len(texts))

    class Cutter:
        def __init__(self, text: bytes):
            self.text = text

        def cut(self, begin: int, end: int) -> bytes:
            return self.text[begin:end]


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the words of UTF-8 bytes."""
    inside = np.concatenate([[False], ~_SPACE[data], [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return edge[::2], edge[1::2]


def word_values(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each word."""
    up, down = _power(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[data] * up[: len(data)], out=total[1:])
    return mix((total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64))


class Words:
    """Units are words; a segment is its words joined by one space."""

    name = "word"

    @staticmethod
    def count(segment: bytes) -> int:
        return segment.count(b" ") + 1

    @staticmethod
    def values(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        begin, end = word_spans(data)
        bound = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
        return word_values(data, begin, end), np.diff(np.searchsorted(begin, bound), prepend=0)

    class Cutter:
        def __init__(self, text: bytes):
            self.words = text.split()

        def cut(self, begin: int, end: int) -> bytes:
            return b" ".join(self.words[begin:end])


def tag_of(text: bytes) -> int:
    """Tells rows of one id with different texts apart."""
    return xxhash.xxh64_intdigest(text) & 0x7FFF


def narrow(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, text) and the columns to carry: a null doc_id is `LAST`, a null text is empty."""
    own = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("id")
    return docs.select(own, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *[F.col(f"`{c}`") for c in carry])


def occurrences(texts: DataFrame, unit, window: int, gram: int) -> DataFrame:
    """(fp, id) of each anchor of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data in text_slices(batch, 1, BATCH_BYTES):
                fp, text, *_ = anchors(*unit.values(data), window, gram)
                yield pa.RecordBatch.from_arrays([pa.array(fp.view(np.int64)), pa.array(part.column(0).to_numpy()[text])], ["fp", "id"])

    return texts.select("id", "text").mapInArrow(run, "fp long, id long")


def copies(texts: DataFrame) -> DataFrame:
    """(id, copied): hashes of those texts of an id that a smaller id has as a whole. Rows of one id can have others. It is
    written once, for `segments` and `apply`."""
    hashed = texts.select("id", F.md5("text").alias("h"), F.xxhash64("text").alias("own"))
    first = hashed.groupBy("h").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first < last")
    # Written, so that a text with many copies can be split in the join below.
    found = hashed.join(materialize(first, "first-copies"), "h").filter("id > first")
    return materialize(found.groupBy("id").agg(F.collect_set("own").alias("copied")), "copies")


def _is_copy() -> Column:
    """Whether `text` is among `copied`, which is null for an id without copies."""
    return F.coalesce(F.array_contains("copied", F.xxhash64("text")), F.lit(False))


def segments(texts: DataFrame, found: DataFrame, copied: DataFrame, unit, window: int, gram: int, between: bool, fold: bool = False) -> DataFrame:
    """(fp, id, tag, starts, segment) of anchors that repeat; with `between`, in texts of different ids. A text's equal
    segments are one row with all their starts, in order. With `fold`, those after an earlier equal one of the task are
    left out, and a text's runs of them are one row without a segment, whose starts are begins and ends in turn."""
    count = found.groupBy("fp").agg(F.count("*").alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi"))
    # Written, so that the join below is one of two plain shuffles, whose skewed parts can be split.
    repeated = materialize(count.filter("lo < hi" if between else "n > 1").select("fp", (F.col("n") > HOT).alias("hot")), "anchors")
    candidates = found.join(repeated, "fp").groupBy("id").agg(F.collect_set(F.struct("fp", "hot")).alias("at"))
    candidates = candidates.join(copied, "id", "left")
    side = (window - gram) // 2
    column = len(texts.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["fp", "id", "tag", "starts", "segment"]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.binary()]
        earliest: dict[tuple[int, bytes], tuple[int, int]] = {}
        for batch in batches:
            for part, data in text_slices(batch, 1, BATCH_BYTES):
                rows: tuple[list, ...] = ([], [], [], [], [])
                values, lengths = unit.values(data)
                fps, text, ats, firsts, lasts = anchors(values, lengths, window, gram)
                base = (np.cumsum(lengths) - lengths)[text]
                found_ = [x.tolist() for x in (fps.view(np.int64), ats - base, firsts - base, lasts - base)]
                bounds = np.searchsorted(text, np.arange(len(data) + 1)).tolist()
                ids = part.column(0).to_pylist()
                for r, source in enumerate(data):
                    wanted = part.column(column)[r].values
                    wanted = dict(zip(wanted.field(0).to_pylist(), wanted.field(1).to_pylist(), strict=True))
                    own, cutter = tag_of(source), unit.Cutter(source)
                    cuts: dict[tuple[int, bytes], list[int]] = {}
                    for fp, at, first, last in zip(*(x[bounds[r] : bounds[r + 1]] for x in found_), strict=True):
                        hot = wanted.get(fp)
                        if hot is None:
                            continue
                        pieces = [(fp, first, last)]
                        if hot:
                            pieces = []
                            if first <= at - side:
                                pieces.append((_refined(fp, b"<" + cutter.cut(at - side, at)), first, min(last, at - side)))
                            if last > at - side:
                                pieces.append((_refined(fp, b">" + cutter.cut(at + gram, at + gram + side)), max(first, at - side + 1), last))
                        for key, begin, end in pieces:
                            cuts.setdefault((key, cutter.cut(begin, end + window)), []).append(begin)
                    made, repeats = [], []
                    for (key, segment), starts in cuts.items():
                        if fold:
                            place, name = (ids[r], starts[0]), (key, xxhash.xxh3_128_digest(segment))
                            first = earliest.get(name)
                            if first is not None and first < place:
                                repeats += [(start, start + unit.count(segment)) for start in starts]
                                continue
                            earliest[name] = place
                        made.append((key, ids[r], own, starts, segment))
                    if repeats:
                        made.append((_refined(ids[r], b""), ids[r], own, [x for run in merged(repeats) for x in run], None))
                    for row in made:
                        for c, value in zip(rows, row, strict=True):
                            c.append(value)
                    if len(earliest) > FOLD:
                        earliest.clear()
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], names)

    # All columns of the texts go along, so that this shuffle of the texts serves `apply` too.
    return texts.join(candidates, "id").filter(~_is_copy()).select(*texts.columns, "at").mapInArrow(run, "fp long, id long, tag int, starts array<int>, segment binary")


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs that overlap or touch as one, in order."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(runs):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def _refined(fp: int, context: bytes) -> int:
    return xxhash.xxh64_intdigest(context, seed=fp & 0xFFFFFFFFFFFFFFFF) - (1 << 63)


#: (segment, id, first start) of distinct segments -> (index, first and last removed window) of each.
Solver = Callable[[list[bytes], list[int], list[int]], Iterator[tuple[int, int, int]]]


def solve(cut: DataFrame, solver: Solver, unit, window: int) -> DataFrame:
    """(id, tag, lo, hi): runs of units to remove. Runs that were folded pass. In each fp's rows, by id and start, the first of equal segments is met
    first: those after it are repeats as a whole, and only the distinct ones are kept and given to the solver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: tuple[list, ...] = ([], [], [], [])

        def add(id_: int, tag: int, lo: int, hi: int) -> None:
            for column, value in zip(out, (id_, tag, lo, hi), strict=True):
                column.append(value)

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.int32(), pa.int32(), pa.int32()), strict=True)], ["id", "tag", "lo", "hi"])
            for column in out:
                column.clear()
            return batch

        kept: list[tuple[bytes, int, int, list[int]]] = []
        size, now, seen = 0, None, {}

        def settle() -> None:
            if kept:
                for i, first, last in solver([k[0] for k in kept], [k[1] for k in kept], [k[3][0] for k in kept]):
                    _, id_, tag, starts = kept[i]
                    add(id_, tag, starts[0] + first, starts[0] + last + window)
            kept.clear()

        for batch in batches:
            for fp, id_, tag, starts, segment in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if segment is None:
                    for lo, hi in zip(starts[::2], starts[1::2], strict=True):
                        add(id_, tag, lo, hi)
                    continue
                if fp != now:
                    if size > SOLVE_BYTES:
                        settle()
                        size = 0
                    now, seen = fp, {}
                first = seen.setdefault(segment, (id_, starts[0]))
                repeats = [s for s in starts if first < (id_, s)]
                if len(repeats) < len(starts):
                    kept.append((segment, id_, tag, starts))
                    size += len(segment)
                for start in repeats:
                    add(id_, tag, start, start + unit.count(segment))
            if len(out[0]) > 100_000:
                yield flush()
        settle()
        yield flush()

    ordered = cut.repartition("fp").sortWithinPartitions("fp", "id", "starts")
    return ordered.mapInArrow(run, "id long, tag int, lo int, hi int")


def apply(texts: DataFrame, removed: DataFrame, copied: DataFrame, finish: Callable[[bytes, list[tuple[int, int]], bool], tuple], names: list[str], schema: str, kinds: list) -> DataFrame:
    """One row for each text: doc_id, the carried columns and what `finish` makes of the text, its merged runs to
    remove, and whether it is a copy."""
    runs = removed.groupBy("id").agg(F.collect_list(F.struct("tag", "lo", "hi")).alias("runs"))
    marked = runs.join(copied, "id", "full_outer")
    carried, column = texts.columns[2:], len(texts.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data in text_slices(batch, 1, BATCH_BYTES):
                ids = [None if i == LAST else i for i in part.column(0).to_pylist()]
                rows: list[list] = [[] for _ in names]
                for text, own, copy in zip(data, part.column(column).to_pylist(), part.column(column + 1).to_pylist(), strict=True):
                    tag = tag_of(text) if own else 0
                    spans = merged([(r["lo"], r["hi"]) for r in own or () if r["tag"] == tag])
                    for c, value in zip(rows, finish(text, spans, bool(copy)), strict=True):
                        c.append(value)
                columns = [pa.array(ids, pa.int64()), *part.columns[2:column], *(pa.array(c, k) for c, k in zip(rows, kinds, strict=True))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", *carried, *names])

    types = dict(texts.dtypes)
    full = ", ".join(["doc_id long", *(f"`{c}` {types[c]}" for c in carried), schema])
    return texts.join(marked, "id", "left").select(*texts.columns, "runs", _is_copy().alias("copy")).mapInArrow(run, full)
