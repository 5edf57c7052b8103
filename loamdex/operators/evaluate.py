"""Evaluation of searches: hit rates, significance, sweeps and behaviour logs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def golden_ranks(cases: DataFrame, results: DataFrame, k: int = 5) -> DataFrame:
    """(case_id, rank): the first of the case's k results (case_id, rank, title) whose title contains the expected one, or null."""
    met = results.filter(F.col("rank") <= k).join(cases.select("case_id", "expected"), "case_id").filter(F.lower("title").contains(F.lower("expected")))
    return cases.select("case_id").join(met.groupBy("case_id").agg(F.min("rank").alias("rank")), "case_id", "left")


def hit_rate(ranks: DataFrame) -> DataFrame:
    return ranks.agg(F.count("*").alias("cases"), F.count("rank").alias("hits"), (F.count("rank") / F.count("*")).alias("rate"), F.coalesce(F.avg(1 / F.col("rank")), F.lit(0.0)).alias("mean_reciprocal_of_hits"))


def mcnemar_p(b: int, c: int) -> float:
    """The exact two-sided p of b against c discordant pairs."""
    n = b + c
    return 1.0 if n == 0 else min(1.0, 2 * sum(math.comb(n, i) for i in range(min(b, c) + 1)) * 0.5**n)


def least_discordant(alpha: float = 0.05) -> int:
    """The fewest discordant pairs that can be significant."""
    return next((n for n in range(1, 101) if mcnemar_p(0, n) < alpha), 100)


def mcnemar(a: DataFrame, b: DataFrame) -> DataFrame:
    """(only_a, only_b, p) of two result lists (case_id, hit), paired by case."""
    paired = a.select("case_id", F.col("hit").alias("x")).join(b.select("case_id", F.col("hit").alias("y")), "case_id")
    counts = paired.agg(F.count_if(F.col("x") & ~F.col("y")).alias("only_a"), F.count_if(F.col("y") & ~F.col("x")).alias("only_b"))
    n, k = F.col("only_a") + F.col("only_b"), F.least("only_a", "only_b")
    # P(X <= k) for X ~ Binomial(n, 1/2): each term from the one before, in logarithms.
    tail = F.expr(
        """aggregate(sequence(0L, least(only_a, only_b)), named_struct('log', (only_a + only_b) * ln(0.5D), 'sum', 0D),
             (acc, j) -> named_struct('log', acc.log + coalesce(ln(nullif((only_a + only_b - j) / (j + 1D), 0D)), 0D), 'sum', acc.sum + exp(acc.log)), acc -> acc.sum)"""
    )
    return counts.select("only_a", "only_b", F.when((n == 0) | k.isNull(), 1.0).otherwise(F.least(F.lit(1.0), 2 * tail)).alias("p"))


def sweep(configs: DataFrame, cases: DataFrame) -> DataFrame:
    """Every case under every configuration: both are small, stated lists."""
    return cases.withColumn("one", F.lit(1)).join(configs.withColumn("one", F.lit(1)), "one").drop("one")


def latency(searches: DataFrame, column: str = "latency_ms") -> DataFrame:
    """(n, p50, p95): the median, and the value at place floor(0.95 n) of the sorted ones."""
    given = searches.filter(F.col(column).isNotNull())
    n = given.agg(F.count("*").alias("n"), F.percentile(column, F.lit(0.5)).alias("p50"))
    at = F.greatest(F.floor(F.col("n") * 0.95), F.lit(1))
    counts = given.groupBy(column).agg(F.count("*").alias("c"))  # one row for each value
    upto = counts.withColumn("upto", F.sum("c").over(W.orderBy(column)))
    return upto.crossJoin(F.broadcast(n)).groupBy("n", "p50").agg(F.min(F.when(F.col("upto") >= at, F.col(column))).alias("p95"))


_COUNTS = "array<struct<value: bigint, n: bigint>>"


def _states(counts: DataFrame) -> DataFrame:
    """(day, n, state) of (day, value, n), in which a value may occur more than once."""
    once = counts.groupBy("day", "value").agg(F.sum("n").alias("n"))
    return once.groupBy("day").agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("value", "n"))).cast(_COUNTS).alias("state"))


def daily_latency(searches: DataFrame, column: str = "latency_ms", at: str = "ts") -> DataFrame:
    """(day, n, state): how often each whole latency occurs on a day, to be stored. Such counts merge without loss, and
    grow with the different latencies of a day, not with its searches."""
    given = searches.filter(F.col(column).isNotNull())
    return _states(given.groupBy(F.to_date(at).alias("day"), F.col(column).cast("long").alias("value")).agg(F.count("*").alias("n")))


def _counts(states: DataFrame, by: str) -> DataFrame:
    return states.select(by, F.explode("state").alias("x")).groupBy(by, "x.value").agg(F.sum("x.n").alias("n"))


def add_days(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """The stored states with those of newly read searches merged in; no earlier search is read again."""
    return _states(_counts(stored.select("day", "state").unionByName(fresh.select("day", "state")), "day"))


def period_latency(states: DataFrame, period: Column | None = None) -> DataFrame:
    """(period, n, p50, p95) of stored days, by an expression over `day` (all days are one period without it): the least
    latencies that at least half and 95 % of the period's searches don't exceed."""
    counts = _counts(states.withColumn("period", period if period is not None else F.lit("all")), "period")
    upto = counts.withColumn("upto", F.sum("n").over(W.partitionBy("period").orderBy("value")))  # a row for each value
    total = counts.groupBy(F.col("period").alias("of")).agg(F.sum("n").alias("total"))
    both = upto.join(total, F.col("period").eqNullSafe(F.col("of")))
    least = [F.min(F.when(F.col("upto") * 100 >= F.col("total") * q, F.col("value"))).alias(name) for name, q in (("p50", 50), ("p95", 95))]
    return both.groupBy("period").agg(F.max("total").alias("n"), *least)


def rank_quality(selections: DataFrame) -> DataFrame:
    """(n, mrr, top1) of the selected ranks."""
    given = selections.filter("rank IS NOT NULL AND rank > 0")
    return given.agg(F.count("*").alias("n"), F.avg(1 / F.col("rank")).alias("mrr"), (F.count_if(F.col("rank") == 1) / F.count("*")).alias("top1"))


def rank_histogram(selections: DataFrame) -> DataFrame:
    return selections.filter("rank IS NOT NULL AND rank > 0").groupBy("rank").agg(F.count("*").alias("n"))


def abandonment(searches: DataFrame, selections: DataFrame) -> DataFrame:
    """(searches, abandoned, empty): searches without selection, and those of them without results."""
    left = searches.join(selections.select("search_id").distinct(), "search_id", "left_anti")
    total = searches.agg(F.count("*").alias("searches"))
    return left.agg(F.count("*").alias("abandoned"), F.count_if(F.coalesce("n_results", F.lit(0)) == 0).alias("empty")).crossJoin(total).select("searches", "abandoned", "empty")  # one row each


def golden_from_logs(searches: DataFrame, selections: DataFrame, docs: DataFrame, least: int = 1) -> DataFrame:
    """(query, doc_id, title, n): what was selected for a query at least so often."""
    pairs = selections.join(searches.select("search_id", "query"), "search_id").groupBy("query", "doc_id").agg(F.count("*").alias("n"))
    return pairs.filter(F.col("n") >= least).join(docs.select("doc_id", "title"), "doc_id").select("query", "doc_id", "title", "n")


def sessions(events: DataFrame, gap_hours: float = 12.0, key: str = "user_id", at: str = "ts") -> DataFrame:
    """Adds `session`: a key's events without a gap of more than so many hours, numbered from 1."""
    w = W.partitionBy(key).orderBy(at, "event_id")
    ms = F.unix_micros(F.col(at).cast("timestamp"))
    fresh = F.when(F.lag(ms).over(w).isNull() | (ms - F.lag(ms).over(w) > int(gap_hours * 3_600_000_000)), 1).otherwise(0)
    return events.withColumn("_new", fresh).withColumn("session", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_new")


def last_search(events: DataFrame, is_search: Column, is_selection: Column, key: str = "user_id", at: str = "ts") -> DataFrame:
    """Selections with the id of the session's last search before them (null if there is none)."""
    w = W.partitionBy(key, "session").orderBy(at, "event_id").rowsBetween(W.unboundedPreceding, 0)
    marked = events.withColumn("search_id", F.last(F.when(is_search, F.col("event_id")), True).over(w))
    return marked.filter(is_selection)


def purge(log: DataFrame, before: Column, at: str = "ts") -> DataFrame:
    return log.filter(F.col(at) >= before)


def pick_threads(profile: DataFrame, within: float = 0.05) -> DataFrame:
    """Of measurements (threads, ms) the fewest threads within so much of the best."""
    best = profile.agg(F.min("ms").alias("best"))
    return profile.crossJoin(F.broadcast(best)).filter(F.col("ms") <= F.col("best") * (1 + within)).orderBy("threads").limit(1).select("threads", "ms")  # best is one row


def regression_verdict(before: DataFrame, after: DataFrame, key: str = "name", value: str = "ms", allowed: float = 0.1) -> DataFrame:
    """(key, before, after, verdict): worse, better or same beyond the allowed change."""
    both = before.select(key, F.col(value).alias("before")).join(after.select(key, F.col(value).alias("after")), key)
    ratio = F.col("after") / F.col("before")
    return both.withColumn("verdict", F.when(ratio > 1 + allowed, "worse").when(ratio < 1 - allowed, "better").otherwise("same"))
