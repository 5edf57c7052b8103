"""Mixing sources to target weights by temperature, in DataFrame functions alone.

A source's share of the tokens is raised to an exponent in [0, 1] and the results are normalised: 1 keeps the natural
shares, 0 makes all sources equal. The exponent is bisected to the largest one whose weights reach the target entropy
(a part of ln(number of sources)), and raised further as far as the repetition limit needs it: no source may be read
more than `max_epochs` times. Weights times budget are the sources' quotas. A quota is realised as whole epochs and a
last, partial one. In each epoch a source's hash blocks are put in pseudo-random order (a block permutation), and so
are the documents of a block; the partial epoch takes whole blocks up to the quota and cuts the next block.

Defined results: a null source is the source ''; a null text has no tokens; a source without tokens has no weight and
gives no rows; a repeated row is a further document; a null doc_id is hashed as the text 'null'; an empty table gives
no rows; extra columns are ignored by `mix` and kept by `mix_rows`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loamdex.llm.common import WORD
from loamdex.session import materialize

ENTROPY = 0.97
MAX_EPOCHS = 4.0
BLOCKS = 256
SEED = "mix-1"
#: The exponent is searched in so many rounds of so many parts, then rounded to so many digits.
ROUNDS, PARTS, DIGITS = 6, 32, 6


def _source(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(""))


def _name(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("string"), F.lit("null"))


def _block(doc_id: Column, blocks: int, seed: str) -> Column:
    head = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), _name(doc_id))), 1, 8)
    return (F.conv(head, 16, 10).cast("long") % blocks).cast("int")


def _curve(totals: DataFrame, total: int, lo: float, hi: float) -> list:
    """At the ends of the parts of [lo, hi]: exponent e, entropy of the weights, z (sum of share ** e), top (largest share ** (e - 1))."""
    at = F.explode(F.array(*[F.lit(lo + (hi - lo) * i / PARTS) for i in range(PARTS + 1)]))
    share = F.col("tokens") / F.lit(float(total))
    power = F.pow(share, F.col("e"))
    sums = (
        totals.select("tokens", at.alias("e"))
        .groupBy("e")
        .agg(F.sum(power).alias("z"), F.sum(power * F.col("e") * F.log(share)).alias("zl"), F.max(F.pow(share, F.col("e") - 1)).alias("top"))
    )
    return sums.select("e", "z", "top", (F.log("z") - F.col("zl") / F.col("z")).alias("entropy")).orderBy("e").collect()


def find_exponent(totals: DataFrame, total: int, sources: int, largest: int, budget: int | None, entropy: float, max_epochs: float) -> float:
    """The exponent. `totals` has one row (source, tokens > 0) for each source; each look at it brings PARTS + 1 rows.

    Without a budget, a source's epochs are counted with the largest source read once.
    """
    wanted = entropy * math.log(sources)

    def epochs(point) -> float:
        return point.top * budget / (point.z * total) if budget is not None else point.top / (largest / total) ** (point.e - 1)

    def last(good) -> float:
        """The end of the run of exponents from 0 on for which `good` holds; it fails from some exponent on."""
        lo, hi = 0.0, 1.0
        for _ in range(ROUNDS):
            points = _curve(totals, total, lo, hi)
            held = sum(map(good, points))
            if held in (0, len(points)):
                return hi if held else lo
            lo, hi = points[held - 1].e, points[held].e
        return lo

    return round(max(last(lambda p: p.entropy >= wanted - 1e-12), last(lambda p: epochs(p) > max_epochs + 1e-9)), DIGITS)


def plan(docs: DataFrame, budget: int | str, entropy: float, max_epochs: float, blocks: int, seed: str) -> tuple[DataFrame, DataFrame]:
    """(documents as doc_id, source, n_tokens, block; blocks as source, block, epochs, rest, partial).

    `epochs` whole epochs of each block are read. In the epoch after them, `partial` is 'all', 'none' or 'cut', and of
    a cut block so many documents, in their order, as fit in `rest` tokens.
    """
    narrow = materialize(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            _source(F.col("source")).alias("source"),
            F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("long").alias("n_tokens"),
            _block(F.col("doc_id"), blocks, seed).alias("block"),
        ),
        "mix-documents",
    )
    by_block = materialize(narrow.groupBy("source", "block").agg(F.sum("n_tokens").alias("block_tokens")), "mix-blocks")
    totals = by_block.groupBy("source").agg(F.sum("block_tokens").alias("tokens")).filter("tokens > 0")
    total, sources, largest = totals.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.count("*"), F.coalesce(F.max("tokens"), F.lit(0))).first()
    exponent, tokens = 1.0, 0
    if sources:
        tokens = None if budget == "cover" else int(min(total if budget == "natural" else budget, max_epochs * total))
        exponent = find_exponent(totals, total, sources, largest, tokens, entropy, max_epochs)
    power = F.pow(F.col("tokens") / F.lit(float(total or 1)), F.lit(exponent))
    z, top = totals.agg(F.coalesce(F.sum(power), F.lit(1.0)), F.coalesce(F.max(power), F.lit(1.0))).first()
    if tokens is None:
        tokens = math.ceil(largest * z / top - 1e-6)  # rounded down, the largest source would lose a document
    quota = F.floor(F.round(power / F.lit(z) * F.lit(float(tokens)), 3)).cast("long")
    quotas = totals.select("source", "tokens", quota.alias("quota"))
    quotas = quotas.select("source", F.floor(F.col("quota") / F.col("tokens")).cast("int").alias("epochs"), (F.col("quota") % F.col("tokens")).alias("left"))
    order = F.md5(F.concat_ws(":", F.lit(seed), "source", F.col("epochs").cast("string"), F.col("block").cast("string")))
    before = F.sum("block_tokens").over(W.partitionBy("source").orderBy("order", "block").rowsBetween(W.unboundedPreceding, -1))
    rest = F.col("left") - F.coalesce(F.col("before"), F.lit(0))
    partial = F.when(F.col("block_tokens") <= rest, "all").when(rest > 0, "cut").otherwise("none")
    planned = (
        by_block.join(quotas, "source")
        .withColumn("order", order)
        .withColumn("before", before)
        .select("source", "block", "epochs", rest.alias("rest"), partial.alias("partial"))
    )
    return narrow, planned


def _with_epochs(rows: DataFrame, planned: DataFrame, seed: str) -> DataFrame:
    """`rows` (doc_id, n_tokens, mix_source, mix_block and more) once for each epoch that reads them, with epoch and key."""
    p = planned.select(F.col("source").alias("mix_source"), F.col("block").alias("mix_block"), "epochs", "rest", "partial")
    key = F.md5(F.concat_ws(":", F.lit(seed), F.col("epoch").cast("string"), _name(F.col("doc_id"))))
    joined = rows.join(p, ["mix_source", "mix_block"])
    whole = joined.filter("epochs > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("epochs") - 1))).withColumn("key", key)
    last = joined.filter("partial = 'all'").withColumn("epoch", F.col("epochs")).withColumn("key", key)
    cut = joined.filter("partial = 'cut'").withColumn("epoch", F.col("epochs")).withColumn("key", key)
    so_far = F.sum("n_tokens").over(W.partitionBy("mix_source", "mix_block").orderBy("key").rangeBetween(W.unboundedPreceding, 0))
    cut = cut.withColumn("so_far", so_far).filter("so_far <= rest").drop("so_far")
    return whole.unionByName(last).unionByName(cut).drop("epochs", "rest", "partial")


def mix(docs: DataFrame, budget: int | str = "natural", entropy: float = ENTROPY, max_epochs: float = MAX_EPOCHS, blocks: int = BLOCKS, seed: str = SEED) -> DataFrame:
    """(doc_id, source, n_tokens, epoch, block, key) for each time that a document is read.

    `budget` is a number of tokens, 'natural' (as many as there are) or 'cover' (what reads the largest source once, so
    that no document is left out). Read in the order of epoch, then blocks as permuted for the epoch, then key.
    """
    narrow, planned = plan(docs, budget, entropy, max_epochs, blocks, seed)
    rows = narrow.select("doc_id", "n_tokens", F.col("source").alias("mix_source"), F.col("block").alias("mix_block"))
    return _with_epochs(rows, planned, seed).select("doc_id", F.col("mix_source").alias("source"), "n_tokens", "epoch", F.col("mix_block").alias("block"), "key")


def mix_rows(docs: DataFrame, budget: int | str = "cover", entropy: float = ENTROPY, max_epochs: float = 2.0, blocks: int = BLOCKS, seed: str = SEED) -> DataFrame:
    """The rows of `docs`, each as often as the mix reads it. The text isn't shuffled to learn the plan."""
    _, planned = plan(docs, budget, entropy, max_epochs, blocks, seed)
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col("doc_id"),
        F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("long").alias("n_tokens"),
        _source(F.col("source")).alias("mix_source"),
        _block(F.col("doc_id"), blocks, seed).alias("mix_block"),
    )
    return _with_epochs(rows, planned, seed).select("row.*")


def oracle() -> str:
    """`mix` with its defaults as DuckDB SQL."""
    return f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, coalesce(source, '') AS source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n_tokens,
  (('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT % {BLOCKS})::INTEGER AS block FROM documents),
b AS (SELECT source, block, sum(n_tokens)::BIGINT AS block_tokens FROM d GROUP BY ALL),
t AS MATERIALIZED (SELECT source, sum(block_tokens)::BIGINT AS tokens FROM b GROUP BY ALL HAVING sum(block_tokens) > 0),
n AS MATERIALIZED (SELECT sum(tokens)::DOUBLE AS total, count(*) AS sources FROM t),
bis AS (SELECT 0 AS i, 0::DOUBLE AS elo, 1::DOUBLE AS ehi, 0::DOUBLE AS rlo, 1::DOUBLE AS rhi
  UNION ALL
  SELECT i + 1, CASE WHEN h THEN (elo + ehi) / 2 ELSE elo END, CASE WHEN h THEN ehi ELSE (elo + ehi) / 2 END, CASE WHEN r THEN (rlo + rhi) / 2 ELSE rlo END, CASE WHEN r THEN rhi ELSE (rlo + rhi) / 2 END
  FROM (SELECT i, any_value(elo) AS elo, any_value(ehi) AS ehi, any_value(rlo) AS rlo, any_value(rhi) AS rhi,
    ln(sum(pow(tokens / total, (elo + ehi) / 2))) - sum(pow(tokens / total, (elo + ehi) / 2) * (elo + ehi) / 2 * ln(tokens / total)) / sum(pow(tokens / total, (elo + ehi) / 2)) >= {ENTROPY} * ln(any_value(sources)) - 1e-12 AS h,
    max(pow(tokens / total, (rlo + rhi) / 2 - 1)) / sum(pow(tokens / total, (rlo + rhi) / 2)) > {MAX_EPOCHS} + 1e-9 AS r
    FROM bis, t, n WHERE i < 40 GROUP BY i)),
nat AS (SELECT ln(sum(tokens / total * 1.0)) - sum(tokens / total * ln(tokens / total)) >= {ENTROPY} * ln(any_value(sources)) - 1e-12 AS h FROM t, n),
e AS (SELECT round(greatest(CASE WHEN h THEN 1 ELSE elo END, rlo), {DIGITS}) AS e FROM bis, nat WHERE i = 40),
z AS (SELECT sum(pow(tokens / total, e)) AS z FROM t, n, e),
q AS (SELECT source, tokens, floor(round(pow(tokens / total, e) / z * total, 3))::BIGINT AS quota FROM t, n, e, z),
q2 AS (SELECT source, (quota // tokens)::INTEGER AS epochs, quota % tokens AS rest FROM q),
p AS MATERIALIZED (SELECT source, block, epochs, block_tokens, rest - coalesce(sum(block_tokens) OVER (PARTITION BY source ORDER BY md5('{SEED}:' || source || ':' || epochs || ':' || block), block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest FROM b JOIN q2 USING (source)),
j AS (SELECT d.*, epochs, rest, block_tokens, md5('{SEED}:' || epochs || ':' || coalesce(doc_id::VARCHAR, 'null')) AS key FROM d JOIN p USING (source, block)),
whole AS (SELECT doc_id, source, n_tokens, epoch, block, md5('{SEED}:' || epoch || ':' || coalesce(doc_id::VARCHAR, 'null')) AS key FROM (SELECT *, unnest(range(epochs))::INTEGER AS epoch FROM j WHERE epochs > 0)),
last AS (SELECT doc_id, source, n_tokens, epochs AS epoch, block, key FROM (SELECT *, sum(n_tokens) OVER (PARTITION BY source, block ORDER BY key RANGE UNBOUNDED PRECEDING) AS so_far FROM j WHERE rest > 0) WHERE block_tokens <= rest OR so_far <= rest)
SELECT * FROM whole UNION ALL SELECT * FROM last
"""
