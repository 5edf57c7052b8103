"""Removal of repeated byte strings by suffix arrays, sorted in two stages.

Texts that share a 100-byte string are brought together in segments (see `anchors`). The suffix array of the joined
segments is built in two stages: the suffixes smaller than their successors are sorted directly, all others are
induced by scanning the buckets in order (Itoh and Tanaka). The common prefixes of neighbours in the array then show
which strings are equal, and of each group of equal strings all but the first in the corpus are removed.

Order within the array matters only up to `WINDOW` bytes, so directly sorted suffixes are compared that far, and ties
stand by place; induced ones are ordered at least as deep.

Defined results: a null text is empty; a null doc_id is larger than any other; rows that share a doc_id are ordered
by start alone, and equal starts of equal rows are no repeats of each other; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loamdex.llm import anchors
from loamdex.llm.anchors import Bytes

WINDOW = 100
#: Bytes of an anchor. Shorter ones are fewer, but occur by chance more often.
GRAM = 24
#: Bytes by which directly sorted suffixes are compared; a multiple of 8 above WINDOW.
DEPTH = 104


def suffix_array(text: np.ndarray) -> np.ndarray:
    """The places of all suffixes of the bytes in order, as deep as the module's comment says."""
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64)
    padded = np.concatenate([text, np.zeros(DEPTH, np.uint8)])
    # Smaller than the successor: at the next place where the byte changes, it rises. The last suffix is larger than the empty one.
    change = np.flatnonzero(text[:-1] != text[1:])
    ahead = np.append(change, n - 1)[np.searchsorted(change, np.arange(n))]
    rising = padded[ahead] < padded[ahead + 1]
    rising[ahead == n - 1] = False
    # First stage: direct sort, by 8 bytes and then, among equal ones, by all.
    direct = np.flatnonzero(rising)
    words = np.ndarray((n,), ">u8", padded.tobytes(), strides=(1,))
    head = words[direct].astype(np.uint64)
    order = np.argsort(head, kind="stable")
    head = head[order]
    same = head[1:] == head[:-1]
    tied = np.flatnonzero(np.concatenate([[False], same]) | np.concatenate([same, [False]]))
    if len(tied):
        strings = np.ndarray((n,), f"S{DEPTH}", padded.tobytes(), strides=(1,))
        among = order[tied]
        order[tied] = among[np.argsort(strings[direct[among]], kind="stable")]
    direct = direct[order]
    # Second stage: in each bucket the induced suffixes stand before the directly sorted ones.
    sizes = np.bincount(text, minlength=256)
    ends = np.cumsum(sizes)
    lead = text[direct]
    direct_sizes = np.bincount(lead, minlength=256)
    out = np.empty(n, np.int64)
    out[(ends - direct_sizes)[lead] + np.arange(len(direct)) - (np.cumsum(direct_sizes) - direct_sizes)[lead]] = direct
    queue: list[list[np.ndarray]] = [[] for _ in range(256)]
    if not rising[n - 1]:
        queue[text[n - 1]].append(np.array([n - 1]))
    for c in np.flatnonzero(sizes).tolist():
        at, begin = ends[c] - sizes[c], ends[c] - sizes[c]
        now = np.concatenate(queue[c]) if queue[c] else np.zeros(0, np.int64)
        while len(now):
            out[at : at + len(now)] = now
            at += len(now)
            before = now[now > 0] - 1
            now = before[text[before] == c]
        before = out[begin : ends[c]]
        before = before[before > 0] - 1
        lead = text[before]
        larger = lead > c
        before, lead = before[larger], lead[larger]
        by = np.argsort(lead, kind="stable")
        before, lead = before[by], lead[by]
        cuts = np.flatnonzero(lead[1:] != lead[:-1]) + 1
        for part in np.split(before, cuts):
            if len(part):
                queue[text[part[0]]].append(part)
    return out


def equal_neighbours(text: np.ndarray, places: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """For places in the array's order: whether the common prefix with the place before is `window` bytes or more."""
    padded = np.concatenate([text, np.zeros(DEPTH, np.uint8)])
    words = np.ndarray((len(text) + DEPTH - 8,), "<u8", padded.tobytes(), strides=(1,))
    equal = np.zeros(len(places), bool)
    left = np.arange(1, len(places))
    for step in [*range(0, window - 7, 8), *([window - 8] if window % 8 else [])]:
        left = left[words[places[left] + step] == words[places[left - 1] + step]]
    equal[left] = True
    return equal


def solver(parts: list[bytes], ids: list[int], starts: list[int]) -> Iterator[tuple[int, int, int]]:
    """Runs of windows of the distinct segments `parts` that an earlier window equals: (segment, first, last)."""
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    text = np.frombuffer(b"".join(parts), np.uint8)
    begin = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(parts)), size)
    inside = np.arange(len(text)) - begin[owner]
    places = suffix_array(text)
    places = places[inside[places] + WINDOW <= size[owner[places]]]
    equal = equal_neighbours(text, places)
    rank = np.unique(np.array(ids), return_inverse=True)[1]
    key = (rank[owner[places]] << 32) | (np.array(starts)[owner[places]] + inside[places])
    groups = np.flatnonzero(~equal)
    least = np.minimum.reduceat(key, groups) if len(groups) else key
    repeat = np.sort(places[key > np.repeat(least, np.diff(np.append(groups, len(places))))])
    if not len(repeat):
        return
    cut = np.flatnonzero((repeat[1:] != repeat[:-1] + 1) | (owner[repeat[1:]] != owner[repeat[:-1]]))
    for a, b in zip(repeat[np.append(0, cut + 1)].tolist(), repeat[np.append(cut, len(repeat) - 1)].tolist(), strict=True):
        yield int(owner[a]), int(inside[a]), int(inside[b])


def removed_runs(docs: DataFrame, carry: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(texts, runs of bytes to remove, copies)."""
    texts = anchors.narrow(docs, carry)
    found, copied = anchors.occurrences(texts, Bytes, WINDOW, GRAM), anchors.copies(texts)
    cut = anchors.segments(texts, found, copied, Bytes, WINDOW, GRAM, between=False, fold=True)
    return texts, anchors.solve(cut, solver, Bytes, WINDOW), copied


def _kept(text: bytes, spans: list[tuple[int, int]], copy: bool) -> tuple[bytes, list[tuple[int, int]]]:
    if copy and len(text) >= WINDOW:
        return b"", [(0, len(text))]
    if not spans:
        return text, spans
    edges = [0, *(x for span in spans for x in span), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)), spans


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every whole text."""

    def finish(text: bytes, spans: list[tuple[int, int]], copy: bool) -> tuple:
        kept, spans = _kept(text, spans, copy)
        return len(text), len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()

    texts, removed, copied = removed_runs(docs)
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
    return anchors.apply(texts, removed, copied, finish, ["n_bytes", "n_removed", "n_spans", "kept_sha256"], "n_bytes long, n_removed long, n_spans long, kept_sha256 string", kinds)


def kept_texts(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns to carry and the text that remains. Bytes of a cut character are dropped with it."""

    def finish(text: bytes, spans: list[tuple[int, int]], copy: bool) -> tuple:
        return (_kept(text, spans, copy)[0].decode("utf-8", "ignore"),)

    texts, removed, copied = removed_runs(docs, carry)
    return anchors.apply(texts, removed, copied, finish, ["text"], "text string", [pa.string()])
