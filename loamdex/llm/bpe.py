"""BPE encoding and decoding with a vocabulary file of the tokenizers library, by a lexicon of frequent words.

The corpus's pieces (words, digits, runs of marks) are counted; the most frequent ones are encoded once and compiled
into a minimal acyclic transducer with their ids as outputs (see `lexicon`), which every worker memory-maps. A piece
that isn't in it is merged exactly, by the file's merge ranks. What a worker has found is kept in a bounded memory.

The files supported are byte-level BPE with an end-of-word suffix, NFC and lower case, whose decoder joins tokens by
one space. Special tokens are recognised in raw text, as the library does.

Defined results: a null text is read as the empty text, which has no ids; repeated rows are encoded alike; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamdex.llm import lexicon
from loamdex.llm.common import only, sub_batches
from loamdex.session import materialize

#: Words in the lexicon; pieces longer than LONGEST characters never are.
LEXICON_SIZE = 1 << 16
LONGEST = 40
#: Pieces that a worker keeps at most, in counting and in encoding.
COUNT_MEMORY = 300_000
ENCODE_MEMORY = 400_000
#: Characters in a row that are handled at once.
BATCH_CHARS = 1 << 21
#: No merge; and what makes one key of two ids.
NONE, PAIR = 1 << 60, 1 << 24


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 as it is, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


#: The pattern of pieces that has a twin for the standard library, and that twin. They find the same pieces in texts without
#: the characters of `_RARE`: controls that only one takes for white space, numbers that are no digits, and all beyond Latin.
_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_TWIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
_RARE = re.compile("[\x1c-\x1f\x85\xa0²³¹¼-¾\u0250-\U0010ffff]")


class Vocabulary:
    """What encoding needs of a vocabulary file."""

    def __init__(self, text: str):
        data = json.loads(text)
        self.suffix = data["model"]["end_of_word_suffix"]
        vocab = data["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.tokens = {i: t for t, i in (vocab | self.special).items()}
        letters = byte_letters()
        self.inner = [vocab[x] for x in letters]
        self.last = [vocab[x + self.suffix] for x in letters]
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(data["model"]["merges"]):
            self.pairs.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        self._inner, self._last = np.array(self.inner, np.int64), np.array(self.last, np.int64)
        ranked = sorted((rank, a * PAIR + b, new) for (a, b), (rank, new) in self.pairs.items())
        self._keys, self._new = np.array([k for _, k, _ in ranked], np.int64), np.array([n for _, _, n in ranked], np.int64)
        self._table = np.full(1 << 20, -1, np.int64)
        for i, slot in enumerate(self._slot(self._keys).tolist()):
            while self._table[slot] >= 0:
                slot = (slot + 1) & (len(self._table) - 1)
            self._table[slot] = i
        pattern = data["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.twin = _TWIN.findall if pattern == _PIECES else None
        space = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
        self.find = regex.compile(pattern.replace(r"[^\s\p{L}\p{N}]", rf"[^{space}\p{{L}}\p{{N}}]")).findall
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split
        self.token_bytes = [self.tokens.get(i, "").encode() for i in range(max(self.tokens) + 1)]

    def pieces(self, text: str) -> list[str]:
        """The pieces of a text without special tokens, normalised."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        if self.twin and (text.isascii() and text.isprintable() or not _RARE.search(text)):
            return self.twin(text.lower())
        # Lower case is taken letter by letter, so a final sigma is an ordinary one.
        return self.find(text.lower() if "Σ" not in text else "".join(map(str.lower, text)))

    def merge(self, piece: str) -> list[int]:
        """The ids of one piece by the merge ranks."""
        data = piece.encode("utf-8", "surrogatepass")
        ids = [self.inner[b] for b in data]
        ids[-1] = self.last[data[-1]]
        get, none = self.pairs.get, (1 << 60, -1)
        if len(ids) > 64:
            return self._merge_long(ids)
        while len(ids) > 1:
            ranks = [get(p, none) for p in zip(ids, ids[1:])]
            best = min(ranks)
            if best is none or best[1] < 0:
                break
            i, out, n = 0, [], len(ids)
            while i < n:
                if i < n - 1 and ranks[i] == best:
                    out.append(best[1])
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            ids = out
        return ids

    def merge_many(self, pieces: list[str]) -> list[list[int]]:
        """`merge` of many pieces at once: in each round every piece makes its best merge wherever that occurs in it."""
        out: list[list[int]] = [[]] * len(pieces)
        data = [p.encode("utf-8", "surrogatepass") for p in pieces]
        short = [i for i, d in enumerate(data) if len(d) <= 64]
        for i, d in enumerate(data):
            if len(d) > 64:
                out[i] = self.merge(pieces[i])
        if not short:
            return out
        size = np.fromiter((len(data[i]) for i in short), np.int64, len(short))
        flat = np.frombuffer(b"".join(data[i] for i in short), np.uint8)
        ends = np.cumsum(size) - 1
        ids = self._inner[flat]
        ids[ends] = self._last[flat[ends]]
        owner = np.repeat(np.array(short), size)
        while len(ids):
            first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            rank, new = np.full(len(ids), NONE), np.zeros(len(ids), np.int64)
            inside = np.flatnonzero(owner[1:] == owner[:-1])
            rank[inside], new[inside] = self._ranks(ids[inside], ids[inside + 1])
            best = np.minimum.reduceat(rank, first)
            counts = np.diff(np.append(first, len(ids)))
            done = best == NONE
            if done.any():
                flags = np.repeat(done, counts)
                for o, b, e in zip(owner[first[done]].tolist(), (c := np.cumsum(counts[done]) - counts[done]).tolist(), (c + counts[done]).tolist(), strict=True):
                    out[o] = (b, e)
                ready = ids[flags].tolist()
                for o in owner[first[done]].tolist():
                    b, e = out[o]
                    out[o] = ready[b:e]
                ids, owner, rank, new = ids[~flags], owner[~flags], rank[~flags], new[~flags]
                best, counts = best[~done], counts[~done]
                if not len(ids):
                    break
            hit = rank == np.repeat(best, counts)
            # In a run of hits (the same letter again and again) every second one is merged.
            at = np.flatnonzero(hit)
            fresh = np.concatenate([[True], at[1:] != at[:-1] + 1])
            place = np.arange(len(at)) - np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
            at = at[place % 2 == 0]
            ids[at] = new[at]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            ids, owner = ids[keep], owner[keep]
        return out

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks and results of merges, from a table with open addresses; `NONE` where there is no merge."""
        key = a * PAIR + b
        slot = self._slot(key)
        entry = self._table[slot]
        rank, new = np.full(len(key), NONE), np.zeros(len(key), np.int64)
        open_ = np.flatnonzero(entry >= 0)
        while len(open_):
            found = self._keys[entry[open_]] == key[open_]
            good = open_[found]
            rank[good], new[good] = entry[good], self._new[entry[good]]
            open_ = open_[~found]
            slot[open_] = (slot[open_] + 1) & (len(self._table) - 1)
            entry[open_] = self._table[slot[open_]]
            open_ = open_[entry[open_] >= 0]
        return rank, new

    @staticmethod
    def _slot(key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same in n log n steps: a heap of (rank, place) over a linked list."""
        import heapq

        n, get = len(ids), self.pairs.get
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(p[0], i, ids[i], ids[i + 1], p[1]) for i in range(n - 1) if (p := get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i]
            if j < 0 or ids[i] != a or ids[j] != b:
                continue
            ids[i], ids[j] = new, -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if p := get((new, ids[k])):
                    heapq.heappush(heap, (p[0], i, new, ids[k], p[1]))
            if (h := before[i]) >= 0 and (p := get((ids[h], new))):
                heapq.heappush(heap, (p[0], h, ids[h], new, p[1]))
        return [x for x in ids if x >= 0]


class Encoder:
    """Encodes and decodes texts: lexicon first, then exact merges. Ids are packed as little-endian 32-bit integers."""

    def __init__(self, vocabulary: Vocabulary, words: lexicon.Lexicon | None):
        self.v, self.words = vocabulary, words
        self.known: dict[str, bytes] = {}

    def encode(self, text: str) -> list[int]:
        return unpack(self.encode_many([text])[0])

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """The packed ids of each text. The pieces that are new in all the texts are looked up together."""
        parts = [[pack([self.v.special[p]]) if p in self.v.special else self.v.pieces(p) for p in self.v.split(t)] if "<|" in t else [self.v.pieces(t)] for t in texts]
        known = self.known
        if len(known) > ENCODE_MEMORY:
            known.clear()
        new = set()
        for text in parts:
            for part in text:
                if isinstance(part, list):
                    new.update(part)
        self._learn([p for p in new if p not in known])
        get = known.__getitem__
        return [b"".join(b"".join(map(get, part)) if isinstance(part, list) else part for part in text) for text in parts]

    def _learn(self, pieces: list[str]) -> None:
        found = self.words.get_many([p.encode("utf-8", "surrogatepass") for p in pieces]) if self.words is not None and pieces else [None] * len(pieces)
        left = []
        for piece, ids in zip(pieces, found, strict=True):
            if ids is None:
                left.append(piece)
            else:
                self.known[piece] = pack(ids)
        self.known.update(zip(left, map(pack, self.v.merge_many(left)), strict=True))

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b" ".join(map(self.v.token_bytes.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(ids).decode("utf-8", "surrogatepass")


def pack(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def unpack(packed: bytes) -> list[int]:
    return np.frombuffer(packed, "<u4").tolist()


_vocabularies: dict[bytes, Vocabulary] = {}
_encoders: dict[bytes, Encoder] = {}


def _vocabulary(text: str) -> Vocabulary:
    """The vocabulary of a file's text, which a worker reads once for all its tasks."""
    key = hashlib.sha256(text.encode()).digest()
    if key not in _vocabularies:
        _vocabularies.clear()
        _vocabularies[key] = Vocabulary(text)
    return _vocabularies[key]


def _encoder(text: str, words: bytes) -> Encoder:
    """The encoder of a file and a lexicon. What a worker's tasks have learnt is kept for its later ones."""
    key = hashlib.sha256(text.encode() + words).digest()
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(_vocabulary(text), lexicon.Lexicon(words))
    return _encoders[key]


def count_pieces(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(piece, n) over all texts. A piece that a worker met only once between two flushes isn't counted there."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, seen = _vocabulary(vocabulary), Counter()

        def flush() -> pa.RecordBatch:
            often = [(p, n) for p, n in seen.items() if n > 1 and len(p) <= LONGEST]
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array([p for p, _ in often], pa.string()), pa.array([n for _, n in often], pa.int64())], ["piece", "n"])

        for batch in batches:
            for text in batch.column(0):
                seen.update(v.pieces(text.as_py() or ""))
                if len(seen) > COUNT_MEMORY:
                    yield flush()
        yield flush()

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))


def compile_lexicon(docs: DataFrame, vocabulary: str, size: int = LEXICON_SIZE) -> bytes:
    """The automaton of the `size` most frequent pieces, whose number bounds what the driver holds and sends."""
    v = Vocabulary(vocabulary)
    counts = materialize(count_pieces(docs, vocabulary), "pieces")
    if (pieces := counts.count()) > 2 * size:  # what is clearly rarer isn't sorted, so each task sends on its part of the top only
        counts = counts.filter(F.col("n") >= counts.approxQuantile("n", [1 - 1.5 * size / pieces], 0.2 * size / pieces)[0])
    top = counts.orderBy(F.desc("n"), "piece").limit(size).select("piece").collect()
    return lexicon.dump(lexicon.build([(row.piece.encode(), v.merge(row.piece)) for row in top]))


def encode(docs: DataFrame, vocabulary: str, words: bytes | None = None, size: int = LEXICON_SIZE) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers), decoded."""
    return _mapped(docs, vocabulary, words, size, False)


def encode_digests(docs: DataFrame, vocabulary: str, words: bytes | None = None, size: int = LEXICON_SIZE) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text."""
    return _mapped(docs, vocabulary, words, size, True)


def _mapped(docs: DataFrame, vocabulary: str, words: bytes | None, size: int, digests: bool) -> DataFrame:
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((vocabulary, words if words is not None else compile_lexicon(docs, vocabulary, size)))
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["doc_id", "n_tokens", "ids", "decoded"]
    kinds = [pa.int64(), pa.int64(), *([pa.string()] * 2 if digests else [pa.binary(), pa.string()])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(*shared.value)
        for batch in batches:
            for begin, end in sub_batches(pa.compute.fill_null(pa.compute.utf8_length(batch.column(1)), 0).to_pylist(), BATCH_CHARS):
                part, rows = batch.slice(begin, end - begin), ([], [], [])
                for packed in encoder.encode_many([text or "" for text in part.column(1).to_pylist()]):
                    decoded = encoder.decode_bytes(unpack(packed))
                    rows[0].append(len(packed) // 4)
                    rows[1].append(hashlib.sha256(packed).hexdigest() if digests else packed)
                    rows[2].append(hashlib.sha256(decoded).hexdigest() if digests else decoded.decode("utf-8", "surrogatepass"))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x, k) for x, k in zip(rows, kinds[1:], strict=True))], names)

    schema = "doc_id long, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digests else "ids binary, decoded string")
    return only(docs, doc_id="long", text="string").mapInArrow(run, schema)
