"""Removal of repeated passages by automata.

Texts that share 50 words in a row are brought together in segments (see `anchors`), whose rows all have the same anchor.

    confirm   of each anchor's distinct segments (equal ones are folded before the shuffle): windows of 50 words that are
              found with several ids. A passage is a run of such windows in the segment of the least id that holds them
    compile   an anchor's passages are cut into blocks of 25 words, at fixed steps; those of as many anchors as fill a
              shard are compiled into one Aho-Corasick automaton
    stream    the segments of all documents are streamed through their shard's automaton. Every 50-word window of a
              passage holds a whole block, so each occurrence is located by a block, and the windows that hold it are then compared
              word by word with the passages'. What lies in a passage that a smaller id holds is removed

Parts of a document that no segment covers have anchors that occur nowhere else, so they hold no passage. Segments and
passages meet by a sorted merge on the anchor, which adaptive execution may split where one anchor is very common.

Words are letters of the automaton's alphabet (one code point each, numbered within the shard; one letter stands for all
words that no passage holds).

Defined results: a null text has no words; a null doc_id is larger than any other; rows that share a doc_id are the
same document, whose windows are no repeats of each other; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamdex.llm import anchors
from loamdex.llm.anchors import Words
from loamdex.llm.common import sub_batches
from loamdex.session import materialize

WINDOW, GRAM = 50, 20
#: Words of a block; every window of 2 * BLOCK - 1 words or more holds one that begins at a multiple of BLOCK.
BLOCK = 25


def recurring(words: list[list[bytes]], least: list[int], most: list[int]) -> list[tuple[int, int, int]]:
    """The passages, as runs (segment, first, last) of windows whose hash is found with two ids or more. `least` and `most`
    are the ids of the documents that hold a segment; each window is told once, in the segment of the least id."""
    joined = b"\n".join(b" ".join(w) for w in words) + b"\n"
    begin, end = anchors.word_spans(data := np.frombuffer(joined, np.uint8))
    size = np.fromiter(map(len, words), np.int64, len(words))
    owner = np.repeat(np.arange(len(words)), size)
    inside = np.arange(len(begin)) - (np.cumsum(size) - size)[owner]
    if len(begin) < WINDOW:
        return []
    hashes = anchors.rolling(anchors.word_values(data, begin, end), WINDOW)
    at = np.flatnonzero(inside[: len(hashes)] + WINDOW <= size[owner[: len(hashes)]])
    if not len(at):
        return []
    low, high = np.array(least)[owner[at]], np.array(most)[owner[at]]
    order = np.lexsort((at, low, hashes[at]))
    sorted_hash = hashes[at][order]
    group = np.flatnonzero(np.concatenate([[True], sorted_hash[1:] != sorted_hash[:-1]]))
    many = np.maximum.reduceat(high[order], group) > low[order][group]
    first = np.sort(at[order[group[many]]])
    if not len(first):
        return []
    cut = np.flatnonzero((first[1:] != first[:-1] + 1) | (owner[first[1:]] != owner[first[:-1]]))
    firsts, lasts = first[np.append(0, cut + 1)], first[np.append(cut, len(first) - 1)]
    return list(zip(owner[firsts].tolist(), inside[firsts].tolist(), inside[lasts].tolist(), strict=True))


def compile_blocks(passages: list[str]) -> ahocorasick.Automaton:
    """The automaton of the passages' blocks."""
    automaton = ahocorasick.Automaton()
    for p in passages:
        for y in range(0, len(p) - BLOCK + 1, BLOCK):
            automaton.add_word(p[y : y + BLOCK], BLOCK)
    automaton.make_automaton()
    return automaton


class Shard:
    """The automaton of some passages, each with the least id that holds it."""

    def __init__(self, passages: list[tuple[bytes, int]]):
        self.letters: dict[bytes, str] = {}
        self.texts = [self._text(p.split(b" "), True) for p, _ in passages]
        self.automaton = compile_blocks(self.texts) if passages else None
        self.windows: dict[str, int] = {}
        for p, (_, least) in zip(self.texts, passages, strict=True):
            for y in range(len(p) - WINDOW + 1):
                w = p[y : y + WINDOW]
                self.windows[w] = min(least, self.windows.get(w, least))

    def _text(self, words: list[bytes], learn: bool = False) -> str:
        if learn:
            for w in words:
                if w not in self.letters:
                    n = len(self.letters) + 2
                    self.letters[w] = chr(n if n < 0xD800 else n + 0x800)  # surrogates stand for no letter
        return "".join([self.letters.get(w, "\x01") for w in words])

    def locate(self, segment: bytes) -> list[tuple[int, int, int]]:
        """Runs of words (first, end) of the segment that a passage holds, and the passage's least id."""
        if self.automaton is None:
            return []
        text, out, done = self._text(segment.split(b" ")), [], 0
        for last, size in self.automaton.iter(text):
            x = last - size + 1
            # The windows that hold the block, each looked at once, however many blocks it holds.
            for start in range(max(done, x + size - WINDOW), min(x, len(text) - WINDOW) + 1):
                least = self.windows.get(text[start : start + WINDOW])
                if least is not None:
                    if out and out[-1][2] == least and out[-1][1] == start + WINDOW - 1:
                        out[-1] = (out[-1][0], start + WINDOW, least)
                    else:
                        out.append((start, start + WINDOW, least))
            done = max(done, x + 1)
        return out


def passages(cut: DataFrame) -> DataFrame:
    """(fp, passages): the confirmed passages of each anchor with the least id of each. `cut` are the segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fps: list[int] = []
        parts: list[list[bytes]] = []
        least: list[int] = []
        most: list[int] = []
        size = 0

        def settle() -> pa.RecordBatch:
            found: dict[int, list[dict]] = {}
            # A window has one anchor, so those of different anchors are never equal.
            for j, first, last in recurring(parts, least, most) if parts else ():
                found.setdefault(fps[j], []).append({"text": b" ".join(parts[j][first : last + WINDOW]), "least": least[j]})
            made = pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.int64()), pa.array(found.values(), pa.list_(pa.struct([("text", pa.binary()), ("least", pa.int64())])))], ["fp", "passages"])
            for column in (fps, parts, least, most):
                column.clear()
            return made

        for batch in batches:
            for fp, segment, lo, hi in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size > anchors.SOLVE_BYTES and fp != fps[-1]:
                    yield settle()
                    size = 0
                for column, value in zip((fps, parts, least, most), (fp, segment.split(b" "), lo, hi), strict=True):
                    column.append(value)
                size += len(segment)
        yield settle()

    folded = cut.groupBy("fp", "segment").agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
    ordered = folded.repartition("fp").sortWithinPartitions("fp", "lo", "segment")
    return ordered.mapInArrow(run, "fp long, passages array<struct<text: binary, least: long>>")


def located(cut: DataFrame, confirmed: DataFrame) -> DataFrame:
    """(id, tag, lo, hi): runs of words to remove, found by streaming the segments `cut` through the automata."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            fps = column["fp"].to_numpy()
            new = np.flatnonzero(np.concatenate([[True], fps[1:] != fps[:-1]])) if len(fps) else []
            sizes = (column["n"].to_numpy()).tolist()
            out: tuple[list, ...] = ([], [], [], [])
            for begin, end in sub_batches(sizes, anchors.SOLVE_BYTES):
                firsts = sorted({begin, *(int(x) for x in new if begin <= x < end)})
                shard = Shard(list(dict.fromkeys((p["text"], p["least"]) for r in firsts for p in column["passages"][r].as_py())))
                part = [column[c].slice(begin, end - begin).to_pylist() for c in ("id", "tag", "starts", "segment")]
                known: dict[bytes, list[tuple[int, int, int]]] = {}
                for id_, tag, starts, segment in zip(*part, strict=True):
                    if (runs := known.get(segment)) is None:
                        runs = known[segment] = shard.locate(segment)
                    for lo, hi in anchors.merged([(a, b) for a, b, least in runs if least < id_]):
                        for start in starts:
                            for c, value in zip(out, (id_, tag, start + lo, start + hi), strict=True):
                                c.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.int32(), pa.int32(), pa.int32()), strict=True)], ["id", "tag", "lo", "hi"])

    met = cut.hint("merge").join(confirmed, "fp").select("fp", "id", "tag", "starts", "segment", "passages", F.length("segment").alias("n"))
    return met.mapInArrow(run, "id long, tag int, lo int, hi int")


def removed_runs(docs: DataFrame, carry: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(texts, runs of words to remove, copies)."""
    texts = anchors.narrow(docs, carry)
    found, copied = anchors.occurrences(texts, Words, WINDOW, GRAM), anchors.copies(texts)
    # Written, so that both passes read it.
    cut = materialize(anchors.segments(texts, found, copied, Words, WINDOW, GRAM, between=True), "segments")
    return texts, located(cut, materialize(passages(cut), "passages")), copied


def _kept(text: bytes, spans: list[tuple[int, int]], copy: bool) -> tuple[int, list[bytes]]:
    words = text.split()
    if copy and len(words) >= WINDOW:
        return len(words), []
    edges = [0, *(x for span in spans for x in span), len(words)]
    return len(words), [w for a, b in zip(edges[::2], edges[1::2], strict=True) for w in words[a:b]]


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every whole text."""

    def finish(text: bytes, spans: list[tuple[int, int]], copy: bool) -> tuple:
        n, kept = _kept(text, spans, copy)
        return n, n - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()

    texts, removed, copied = removed_runs(docs)
    return anchors.apply(texts, removed, copied, finish, ["n_words", "n_removed", "kept_sha256"], "n_words long, n_removed long, kept_sha256 string", [pa.int64(), pa.int64(), pa.string()])


def kept_texts(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns to carry and the kept words, joined by one space."""
    texts, removed, copied = removed_runs(docs, carry)
    return anchors.apply(texts, removed, copied, lambda *x: (b" ".join(_kept(*x)[1]).decode(),), ["text"], "text string", [pa.string()])


def oracle() -> str:
    """`digests` as DuckDB SQL, for tables whose ids are distinct."""
    return f"""
WITH w AS MATERIALIZED (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS p FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents)),
win AS (SELECT doc_id, p, word, CASE WHEN count(*) OVER t = {WINDOW} THEN md5(string_agg(word, ' ') OVER t) END AS h FROM w WINDOW t AS (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING)),
firsts AS (SELECT h, min(doc_id) AS lo FROM win WHERE h IS NOT NULL GROUP BY h),
hit AS (SELECT win.doc_id, p, word, coalesce(lo < win.doc_id, false) AS later FROM win LEFT JOIN firsts USING (h)),
gone AS (SELECT doc_id, p, word, bool_or(later) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW) AS gone FROM hit),
kept AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, sha256(coalesce(string_agg(word, ' ' ORDER BY p) FILTER (NOT gone), '')) AS kept_sha256 FROM gone GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, coalesce(kept_sha256, sha256('')) AS kept_sha256 FROM documents LEFT JOIN kept USING (doc_id)
"""
