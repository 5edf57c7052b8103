"""Quality classifier: a sparse ensemble of rules over text statistics, compiled into Spark column expressions.

Statistics of every whole text are column expressions. On a bounded sample of labelled rows (`SAMPLE`, by hash order)
shallow trees are boosted; each path from a root to a node is a conjunctive rule. A logistic model with a lasso penalty
weighs the rules, most weights become 0, and the rest are compiled into one column expression that scores all rows.

Labels are learnt only from rows whose crc32(doc_id as text) mod `FOLDS` isn't 0. Labels, lang, source and doc_id
are no inputs of a score.

Defined results: a null text is scored as the empty one; a null doc_id isn't held out and has no label; null labels
count for nothing and a document labelled both ways counts as 0; without labels of both kinds every score is the share
of label 1 (0.5 without any); repeated rows are scored alike; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamdex.llm.common import SPACE, hash_sample, only, words
from loamdex.session import materialize

FOLDS = 5
SAMPLE = 20_000
CUTOFF = 0.3
#: Boosting: trees, depth, learning rate, least rows in a node, cut points tried for each statistic.
TREES, DEPTH, RATE, LEAST, CUTS = 40, 3, 0.2, 20, 32
#: Lasso penalties tried, on a fifth of the sample kept for it, and steps of proximal gradient.
PENALTIES, STEPS = (3e-2, 1e-2, 3e-3, 1e-3), 300


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of every whole text, in one projection."""
    text = F.coalesce(F.col("text"), F.lit(""))
    without = lambda pattern: F.length("text") - F.length(F.regexp_replace("text", pattern, ""))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    per = lambda a, b: a / F.greatest(b, F.lit(1))
    base = only(docs, doc_id="long", text="string").withColumn("text", text).withColumn("w", words(F.col("text"))).withColumn("lines", lines)
    counted = base.select(
        "doc_id",
        F.length("text").alias("n"),
        F.size("w").alias("nw"),
        F.size(F.array_distinct("w")).alias("nd"),
        F.expr("size(filter(w, (x, i) -> x = get(w, i - 1)))").alias("again"),
        F.expr("array_max(transform(w, x -> length(x)))").alias("longest"),
        F.length(F.array_join("w", "")).alias("wc"),
        without(r"\p{Lu}+").alias("upper"),
        without(r"\p{L}+").alias("letters"),
        without(r"\p{N}+").alias("digits"),
        without(r"[#*$%&|<>]+").alias("symbols"),
        without(r"[!?]+").alias("calls"),
        without(r"[.,;:]+").alias("stops"),
        F.size("lines").alias("nl"),
        F.size(F.array_distinct("lines")).alias("ndl"),
    )
    c = F.col
    return counted.select(
        "doc_id",
        F.log1p(c("nw")).alias("log_words"),
        per(c("wc"), c("nw")).alias("word_length"),
        F.coalesce(c("longest"), F.lit(0)).cast("double").alias("longest_word"),
        per(c("nd"), c("nw")).alias("distinct_words"),
        per(c("again"), c("nw")).alias("repeated_next"),
        per(c("upper"), c("n")).alias("upper"),
        per(c("letters"), c("n")).alias("letters"),
        per(c("digits"), c("n")).alias("digits"),
        per(c("symbols"), c("n")).alias("symbols"),
        per(c("calls"), c("n")).alias("calls"),
        per(c("stops"), c("nw")).alias("stops"),
        per(c("nl") - c("ndl"), c("nl")).alias("repeated_lines"),
        per(c("nw"), c("nl")).alias("line_words"),
    )


Rule = tuple[tuple[int, bool, float], ...]  # conditions: statistic, is above, cut


def grow(x: np.ndarray, residual: np.ndarray, weight: np.ndarray, rows: np.ndarray, cuts: list[np.ndarray], bins: np.ndarray, depth: int, path: Rule, out: list[Rule], value: np.ndarray) -> None:
    """One regression tree on `residual` by Newton steps: appends the rule of every node and sets the leaves' values."""
    g, h = residual[rows].sum(), weight[rows].sum()
    if path:
        out.append(path)
    best = (1e-6, -1, 0)
    if depth and len(rows) >= 2 * LEAST:
        base = g * g / (h + 1)
        for f, c in enumerate(cuts):
            if not len(c):
                continue
            b = bins[rows, f]
            n = np.cumsum(np.bincount(b, minlength=len(c) + 1))[:-1]
            gl = np.cumsum(np.bincount(b, residual[rows], len(c) + 1))[:-1]
            hl = np.cumsum(np.bincount(b, weight[rows], len(c) + 1))[:-1]
            gain = np.where((n >= LEAST) & (len(rows) - n >= LEAST), gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - base, -1)
            i = int(gain.argmax())
            if gain[i] > best[0]:
                best = (gain[i], f, i)
    _, f, i = best
    if f < 0:
        value[rows] = g / (h + 1)
        return
    right = bins[rows, f] > i
    cut = float(cuts[f][i])
    grow(x, residual, weight, rows[~right], cuts, bins, depth - 1, (*path, (f, False, cut)), out, value)
    grow(x, residual, weight, rows[right], cuts, bins, depth - 1, (*path, (f, True, cut)), out, value)


def extract_rules(x: np.ndarray, y: np.ndarray, seed: int = 7) -> list[Rule]:
    """The distinct rules of boosted trees, each grown on a random half of the rows, in order of appearance."""
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, CUTS + 2)[1:-1])) for c in x.T]
    cuts = [np.unique(np.concatenate([c, [0.0]])) if (x[:, i] > 0).any() and (x[:, i] == 0).any() else c for i, c in enumerate(cuts)]
    bins = np.stack([np.searchsorted(c, x[:, i], "left") for i, c in enumerate(cuts)], 1)  # bin > i: above cut i
    score, out = np.full(len(y), np.log(y.mean() / (1 - y.mean()))), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        value = np.zeros(len(y))
        rows = np.flatnonzero(rng.random(len(y)) < 0.5)
        found: list[Rule] = []
        grow(x, y - p, p * (1 - p), rows, cuts, bins, DEPTH, (), found, value)
        score += RATE * value
        out += found
    return list(dict.fromkeys(out))


def rule_matrix(x: np.ndarray, rules: list[Rule]) -> np.ndarray:
    out = np.ones((len(x), len(rules)), np.float32)
    for j, rule in enumerate(rules):
        for f, above, cut in rule:
            out[:, j] *= x[:, f] > cut if above else x[:, f] <= cut
    return out


def fit_lasso(m: np.ndarray, y: np.ndarray, penalty: float) -> tuple[float, np.ndarray]:
    """Intercept and weights of the logistic model with an l1 penalty, by accelerated proximal gradient."""
    n = len(y)
    v = np.ones(m.shape[1] + 1) / np.sqrt(m.shape[1] + 1)
    for _ in range(20):  # the largest eigenvalue bounds the step
        u = m @ v[1:] + v[0]
        v = np.concatenate([[u.sum()], m.T @ u])
        norm = np.linalg.norm(v)
        v /= norm
    step = 4 * n / (1.05 * norm)
    w = np.zeros(m.shape[1] + 1)
    w[0] = np.log(y.mean() / (1 - y.mean()))
    z, t = w.copy(), 1.0
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-(m @ z[1:] + z[0])))
        new = z - step * np.concatenate([[(p - y).mean()], m.T @ (p - y) / n])
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * penalty, 0)
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        z, w = new + (before - 1) / t * (new - w), new
    return float(w[0]), w[1:]


def fit(x: np.ndarray, y: np.ndarray) -> tuple[float, list[tuple[Rule, float]]]:
    """Intercept and weighted rules. The penalty with the least log loss on a fifth of the rows is used."""
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.5
        share = min(max(share, 1e-3), 1 - 1e-3)
        return float(np.log(share / (1 - share))), []
    rules = extract_rules(x, y)
    if not rules:
        return float(np.log(y.mean() / (1 - y.mean()))), []
    m, apart = rule_matrix(x, rules), np.arange(len(y)) % 5 == 0
    losses = []
    for penalty in PENALTIES:
        if y[~apart].min() == y[~apart].max():
            losses.append(0.0)
            continue
        b, w = fit_lasso(m[~apart], y[~apart], penalty)
        p = np.clip(1 / (1 + np.exp(-(m[apart] @ w + b))), 1e-6, 1 - 1e-6)
        losses.append(float(-(y[apart] * np.log(p) + (1 - y[apart]) * np.log(1 - p)).mean()))
    b, w = fit_lasso(m, y, PENALTIES[int(np.argmin(losses))])
    return b, [(rule, float(c)) for rule, c in zip(rules, w, strict=True) if abs(c) > 1e-6]


def compile_score(names: list[str], intercept: float, weighted: list[tuple[Rule, float]]) -> Column:
    """The model as one column expression over the statistics."""
    total = F.lit(intercept)
    for rule, weight in weighted:
        held = F.lit(True)
        for f, above, cut in rule:
            held = held & ((F.col(names[f]) > F.lit(cut)) if above else (F.col(names[f]) <= F.lit(cut)))
        total = total + F.when(held, F.lit(weight)).otherwise(F.lit(0.0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def fold(doc_id: Column, folds: int) -> Column:
    return F.crc32(doc_id.cast("string")) % folds


def train(stats: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Column:
    """The score as a column expression over `stats`, learnt from the labelled rows of the training folds."""
    names = [c for c in stats.columns if c != "doc_id"]
    marks = only(labels, doc_id="long", quality="int").filter("quality IN (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    labelled = stats.filter(fold(F.col("doc_id"), FOLDS) != 0).join(marks, "doc_id")
    rows = hash_sample(labelled, sample, "doc_id", *names).select(*names, "quality").toPandas()
    return compile_score(names, *fit(rows[names].to_numpy(float), rows["quality"].to_numpy(float)))


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of `docs`. The statistics are written once and read twice."""
    stats = materialize(statistics(docs), "text-statistics")
    score = train(stats, labels, sample)
    scored = stats.select("doc_id", F.coalesce(fold(F.col("doc_id"), FOLDS) == 0, F.lit(False)).alias("held_out"), score.alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= CUTOFF).cast("int"))
