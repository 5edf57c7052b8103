"""Toxicity: noisy-channel deobfuscation, then a score of the restored text.

A character language model (interpolated trigrams over word letters) is counted over all documents. A token that looks
disguised (digits or signs for letters, letters three times or more, letters set apart) becomes a lattice of readings:
each run of equal characters offers the letters it may stand for, once, twice or as often as written, at channel costs.
Viterbi search finds the likeliest reading under the language model. The restored tokens are scored: words and word
beginnings have log odds learnt from labelled texts, and a logistic model weighs what a text's odds add up to.

Labels are learnt from a bounded sample (`SAMPLE` rows by hash order, near copies once) of the rows whose crc32(doc_id
as text) mod `FOLDS` isn't `HELD_OUT`: odds on one half, the logistic weights on the other. Labels, lang, source and
doc_id are no inputs of a score.

Defined results: a null text is scored as the empty one; a null doc_id isn't held out and has no label; null labels
count for nothing and a document labelled both ways counts as toxic; without labels of both kinds every score is the
share of toxic ones (0 without any); repeated rows are scored alike; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamdex.llm.common import hash_sample, only
from loamdex.session import materialize

FOLDS, HELD_OUT = 3, 1
SAMPLE = 12_000
CUTOFF = 0.7
#: Log odds from which a word or word beginning counts and from which it is strong; least times that it is met in toxic
#: texts, and most features in the model (by odds).
LEAST_ODDS, STRONG_ODDS, LEAST_TIMES, FEATURES = 1.2, 2.2, 5, 20_000
#: Tokens that a worker remembers at most.
MEMORY = 300_000

#: The language model's letters; 0 is a word's end, the last class any other letter or digit.
LETTERS = "abcdefghijklmnopqrstuvwxyzßàáâäãåæçèéêëìíîïñòóôöõøùúûüýÿœ"
OTHER = len(LETTERS) + 1
BASE = 64
CLASS = {c: i + 1 for i, c in enumerate(LETTERS)}
#: Letters that a sign or digit may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "€": "e", "£": "l", "¡": "i", "(": "c", "<": "c"}
#: Channel costs (natural logarithms): a sign for a letter; a letter once for a double; once, twice, or as written for more.
COST_SIGN, COST_HALVED, COST_LONG = 1.0, 3.0, (1.0, 1.5, 5.0)

_EDGE = ".,;:!?\"'()[]{}<>*#%&|$…«»„“”‘’-_/\\~^=+"
#: Letters that stand alone, and three or more of them with what parts them; nothing is tried twice.
_ALONE, _CHAIN = re.compile(r"[^\W_]"), re.compile(r"(?<!\S)(?:[^\W_][ .\-_*]++){3,}+")
_SINGLE = re.compile(r"[^\W_](?:[.\-_*+][^\W_]){2,}")
_LONG = re.compile(r"([^\W\d_])\1\1")
_MARKS = "0123456789@$!|+€£¡(<"
_MARK, _MARK_LETTER = re.compile(f"[{re.escape(_MARKS)}]"), re.compile(rf"[{re.escape(_MARKS)}][^\W\d_]")
_LETTER, _END_MARKS = re.compile(r"[^\W\d_]"), "0123456789@$|€£"


def spelled(text: str) -> Iterator[str]:
    """Runs of four or more letters with signs or spaces between them ("h e l l o"), from a letter that no other sign
    stands before to the last one that none follows. A chain of such letters is gone through once: if no end is found in
    it from its first letter, none is from a later one."""
    at = 0
    while m := _CHAIN.search(text, at):
        begin, at = m.span()
        if _ALONE.match(text, at) and not text[at + 1 : at + 2].strip():
            yield text[begin : at + 1]
            continue
        letters = [x.start() for x in _ALONE.finditer(text, begin, at)]
        for i in reversed(letters[3:]):
            if text[i + 1] == " ":
                yield text[begin : i + 1]
                break


def disguised(token: str) -> bool:
    """Whether signs or digits stand among the letters: between two of them, before two or more, or after one at the end.
    Each search is one pass, however long the token."""
    if not _MARK.search(token) or not (first := _LETTER.search(token)):
        return False
    last = len(token) - 1
    while not _LETTER.match(token, last):
        last -= 1
    if _MARK.search(token, first.start(), last):
        return True
    before = _MARK_LETTER.search(token)
    if before and before.start() + 1 < last:
        return True
    head = token.rstrip(_END_MARKS)
    return len(head) < len(token) and bool(head) and bool(_LETTER.match(head, len(head) - 1))


def _class_table() -> np.ndarray:
    """Class by code point below 2 ** 16: 0 outside words."""
    table = np.zeros(1 << 16, np.int64)
    for i in range(1 << 16):
        c = chr(i)
        if c.isalnum():
            table[i] = CLASS.get(c.lower(), OTHER)
    return table


def trigram_counts(docs: DataFrame) -> DataFrame:
    """(code, n): how often three classes follow each other in the words of all texts, ends included."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, total = _class_table(), np.zeros(BASE**3, np.int64)
        for batch in batches:
            for text in batch.column(0):
                points = np.frombuffer((text.as_py() or "").encode("utf-32-le", "surrogatepass"), "<u4")
                classes = np.concatenate([[0, 0], table[np.minimum(points, 0xFFFF)], [0]])
                codes = (classes[:-2] * BASE + classes[1:-1]) * BASE + classes[2:]
                # A word begins after two ends; white space runs themselves aren't counted.
                keep = (classes[1:-1] > 0) | (classes[2:] > 0)
                codes = np.where((classes[1:-1] == 0) & keep, classes[2:], codes)
                total += np.bincount(codes[keep], minlength=BASE**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["code", "n"])

    return docs.select(F.col("text").cast("string")).mapInArrow(count, "code int, n long").groupBy("code").agg(F.sum("n").alias("n"))


def language_model(counts: dict[int, int]) -> list[list[list[float]]]:
    """Natural logarithms of P(c | a, b), interpolated with P(c | b) and P(c), as [a][b][c]."""
    tri = np.zeros(BASE**3)
    for code, n in counts.items():
        tri[code] = n
    tri = tri.reshape(BASE, BASE, BASE)
    bi, uni = tri.sum(0), tri.sum((0, 1)) + 0.5
    uni /= uni.sum()
    bi = (bi + 2 * uni) / (bi.sum(1, keepdims=True) + 2)
    tri = (tri + 2 * bi) / (tri.sum(2, keepdims=True) + 2)
    return np.log(tri).tolist()


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """For each run of equal characters, its readings (letters, cost)."""
    out, i = [], 0
    while i < len(token):
        j = i
        while j < len(token) and token[j] == token[i]:
            j += 1
        n, c = j - i, token[i]
        letters = [(x, COST_SIGN) for x in LEET.get(c, "")] + [(c, 0.0)]
        if n == 1:
            out.append([(x, k) for x, k in letters])
        elif n == 2:
            out.append([r for x, k in letters for r in ((x * 2, 2 * k), (x, k + COST_HALVED))])
        else:
            a, b, d = COST_LONG
            out.append([r for x, k in letters for r in ((x, k + a), (x * 2, k + b), (x * n, n * k + d))])
        i = j
    return out


def decode(token: str, model: list) -> str:
    """The likeliest reading of the token's lattice: Viterbi search over the last two letters' classes."""
    best = {(0, 0): (0.0, None)}  # state -> cost, (letters, what was before)
    for readings in lattice(token):
        new: dict[tuple[int, int], tuple[float, tuple]] = {}
        for (a, b), (cost, trace) in best.items():
            for letters, extra in readings:
                x, y, total = a, b, cost + extra
                for c in letters:
                    z = CLASS.get(c, OTHER)
                    total -= model[x][y][z]
                    x, y = y, z
                if (x, y) not in new or total < new[x, y][0]:
                    new[x, y] = (total, (letters, trace))
        best = new
    _, trace = min(((cost - model[a][b][0], trace) for (a, b), (cost, trace) in best.items()), key=lambda x: x[0])
    parts = []
    while trace:
        parts.append(trace[0])
        trace = trace[1]
    return "".join(reversed(parts))


def restore(raw: str, model: list) -> str:
    """The token without marks at its edges, in lower case, and read through its disguise if it has one."""
    low = raw.lower()
    core = low.strip(_EDGE)
    if core and _SINGLE.fullmatch(core):
        return decode(re.sub(r"[.\-_*+]", "", core), model)
    signed = low.rstrip(".,;:!?\"')]}>*#%&|…»“”").lstrip(".,;:?\"'[{*#%&…«„“")
    if disguised(signed):
        return decode(signed, model).strip(_EDGE)
    return decode(core, model) if _LONG.search(core) else core


def restored_tokens(text: str, model: list, known: dict[str, str]) -> set[str]:
    """The distinct restored tokens of a whole text."""
    raw = set(text.split())
    out = set()
    for t in raw:
        r = known.get(t)
        if r is None:
            r = known[t] = restore(t, model)
        out.add(r)
    for run in spelled(text):
        out.add(decode(re.sub(r"[ .\-_*]+", "", run.lower()), model))
    if len(known) > MEMORY:
        known.clear()
    out.discard("")
    return out


def features(token: str) -> list[str]:
    """The word, and its beginnings of 4 to 6 letters."""
    return [token, *(f"{token[:n]}*" for n in (4, 5, 6) if len(token) >= n)]


def _sampled(docs: DataFrame, labels: DataFrame, model, sample: int) -> DataFrame:
    """(doc_id, toxic, half, tokens) of the sampled labelled rows; of those with one least shingle hash, which near copies
    share, the one of the least id (then label, then tokens)."""
    fold = F.crc32(F.col("doc_id").cast("string")) % FOLDS
    marks = only(labels, doc_id="long", toxic="int").filter("toxic IN (0, 1) AND doc_id IS NOT NULL").filter(fold != HELD_OUT).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = materialize(hash_sample(marks, sample, "doc_id"), "toxic-sample")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        lm, known = model.value, {}
        for batch in batches:
            keys, tokens = [], []
            for text in batch.column(2):
                text = text.as_py() or ""
                words = text.split()
                shingles = (" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2)))
                keys.append(min(xxhash.xxh64_intdigest(s) >> 1 for s in shingles))
                tokens.append(sorted(restored_tokens(text, lm, known)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.int64()), pa.array(tokens, pa.list_(pa.string()))], ["doc_id", "toxic", "key", "tokens"])

    # The sample has `sample` rows at most, so its ids may be sent to all.
    rows = only(docs, doc_id="long", text="string").join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "text")
    rows = rows.mapInArrow(run, "doc_id long, toxic int, key long, tokens array<string>")
    rows = rows.groupBy("key").agg(F.min(F.struct("doc_id", "toxic", "tokens")).alias("r")).select("key", "r.*")
    return materialize(rows.withColumn("half", F.col("key") % 2 == 0), "toxic-tokens")


def _odds(sampled: DataFrame) -> dict[str, float]:
    """Log odds that a token with a feature comes from a toxic text, of one half's texts, at most `FEATURES` features."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for toxic, tokens in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen[toxic].update(f for t in tokens for f in features(t))
        names = list(seen[0].keys() | seen[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([seen[1][x] for x in names], pa.int64()), pa.array([seen[0][x] for x in names], pa.int64())], ["feature", "bad", "good"])

    half = sampled.filter("half")
    size = F.size("tokens")
    bad, good = half.agg(F.coalesce(F.sum(size * F.col("toxic")), F.lit(0)), F.coalesce(F.sum(size * (1 - F.col("toxic"))), F.lit(0))).first()
    if not bad or not good:
        return {}
    odds = F.log((F.col("bad") + 0.5) / (bad + 1.0)) - F.log((F.col("good") + 0.5) / (good + 1.0))
    counted = half.select("toxic", "tokens").mapInArrow(count, "feature string, bad long, good long").groupBy("feature").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    best = counted.filter(F.col("bad") >= LEAST_TIMES).withColumn("odds", odds).filter(F.col("odds") >= LEAST_ODDS)
    return {r.feature: r.odds for r in best.orderBy(F.desc("odds"), F.desc("bad"), "feature").limit(FEATURES).collect()}


def token_odds(token: str, odds: dict[str, float]) -> float:
    return max((odds.get(f, 0.0) for f in features(token)), default=0.0)


def summary(values: list[float], n: int) -> list[float]:
    """What the logistic model sees: of the `n` distinct tokens of a text, those with odds."""
    strong = [v for v in values if v >= STRONG_ODDS]
    return [math.log1p(len(values)), math.log1p(len(strong)), max(values, default=0.0), math.sqrt(len(values) / max(1, n)), math.sqrt(sum(strong) / max(1, n)), math.log1p(n)]


def fit_logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Intercept and weights by Newton steps with a small ridge."""
    x = np.column_stack([np.ones(len(x)), x])
    w, ridge = np.zeros(x.shape[1]), np.diag([1e-6, *[0.5] * (x.shape[1] - 1)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + ridge, x.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, model, sample: int = SAMPLE) -> tuple[dict[str, float], list[float]]:
    """(log odds, logistic weights)."""
    sampled = _sampled(docs, labels, model, sample)
    odds = _odds(sampled)
    shared = docs.sparkSession.sparkContext.broadcast(odds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for tokens in batch.column(1).to_pylist():
                values = [v for t in tokens if (v := token_odds(t, shared.value)) > 0]
                rows.append(summary(values, len(tokens)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], ["toxic", "x"])

    rows = sampled.filter("NOT half").select("toxic", "tokens").mapInArrow(run, "toxic int, x array<double>").collect()
    y = np.array([r.toxic for r in rows], float)
    if not len(y) or y.min() == y.max() or not odds:
        share = min(max(float(y.mean()) if len(y) else 0.0, 1e-6), 1 - 1e-6)
        return {}, [math.log(share / (1 - share)), *[0.0] * 6]
    return odds, fit_logistic(np.array([r.x for r in rows]), y).tolist()


def score_texts(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of `docs`."""
    context = docs.sparkSession.sparkContext
    # The model's size is that of its alphabet, 64 ** 3 numbers, however long the corpus.
    model = context.broadcast(language_model({r.code: r.n for r in trigram_counts(docs).collect()}))
    shared = context.broadcast(train(docs, labels, model, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lm, (odds, weights) = model.value, shared.value
        known: dict[str, tuple[str, float]] = {}
        for batch in batches:
            scores = []
            for text in batch.column(1):
                text = text.as_py() or ""
                raw = set(text.split())
                for t in raw.difference(known):
                    r = restore(t, lm)
                    known[t] = (r, token_odds(r, odds))
                found = set(map(known.__getitem__, raw))
                for run in spelled(text):
                    r = decode(re.sub(r"[ .\-_*]+", "", run.lower()), lm)
                    found.add((r, token_odds(r, odds)))
                found.discard(("", 0.0))
                x = summary([v for _, v in found if v > 0], len(found))
                total = weights[0] + sum(w * v for w, v in zip(weights[1:], x, strict=True))
                scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, total)))))
                if len(known) > MEMORY:
                    known.clear()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    scored = only(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, score double")
    held: Column = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == HELD_OUT, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= CUTOFF).cast("int").alias("predicted"))
