"""How the sources of a language differ: smoothed term shares, distances of all pairs of sources, and the terms that each
source has most above its language.

Terms are counted in one pass over the texts, combined in each task. All arithmetic is on integers. A share is
p = 1 + floor(SCALE (count + PRIOR) / (N + PRIOR V)).

Pairs. A term that a source lacks has the source's baseline share there, so the distance of two sources over all V terms
is V |b - b'|, corrected for each term that one of them has. Those corrections are sums over sparse rows: one for each
source against the other's baseline (running sums over the sorted distinct shares, met at the baseline, instead of a row
for each term and other source), and one over the terms that both have.

Ranks. `top_k` selects by radix: a histogram of the values' leading bits (their number and the first 12) gives each
group's bucket in which the k-th value lies, one of the remaining bits its value; what is above stays, and rows of that very value are settled by
histograms over their items' UTF-8 bytes, two at a time, until a group's candidates fit. Each histogram is summed in the
tasks first and has 2^20 buckets a group at most, as many as there are distinct values; no group is sorted as a whole.

Defined results: null texts, languages and sources are empty; each row is a document, repeated rows too; a group without
terms takes part with its baseline (with V = 0 all values are 0); a language of one source has no pairs; ties of values
go by the item's bytes; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loamdex.llm.common import only, text_slices
from loamdex.session import materialize, spread

MIN_DOCS = 30
PRIOR = 5
SCALE = 1_000_000_000
TOP = 50

#: Letters and all bytes of characters beyond ASCII; A-Z are lower-cased before.
_TERM = re.compile(rb"[a-z\x80-\xff]+")
#: Distinct (group, term) that a task holds before it sends its counts on; texts that are split at once, in bytes.
_HELD, _SLICE = 300_000, 4 << 20
#: A group's rows are dealt to so many tasks where it meets its threshold.
_SALTS = 16
#: Leading bits of a value that the first histogram tells apart.
_LEAD = 12


def counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term in the texts of a task; a row with an empty
    term marks the group. Rows of a group and term are to be summed."""
    one = 1 << 40  # a document; below it, occurrences

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], dict[bytes, int]] = {}
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), found in held.items():
                both = np.fromiter(found.values(), np.int64, len(found))
                columns = [pa.repeat(lang, len(found)), pa.repeat(source, len(found)), pa.array(list(found), pa.binary()).cast(pa.string()), pa.array(both & (one - 1)), pa.array(both >> 40)]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])
            held.clear()

        for batch in batches:
            for part, texts in text_slices(batch, 0, _SLICE):
                for lang, source, text in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), texts, strict=True):
                    own = held.setdefault((lang, source), {b"": 0})
                    before, get = len(own), own.get
                    for term, n in Counter(_TERM.findall(text.lower())).items():
                        own[term] = get(term, 0) + (n | one)
                    size += len(own) - before
                    if size >= _HELD:
                        yield from out()
                        size = 0
        yield from out()

    rows = only(docs, text="string", lang="string", source="string")
    rows = rows.select("text", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"))
    return rows.mapInArrow(count, "lang string, source string, term string, n long, docs long")


def share(n: Column, total: Column, kept: Column, prior: int = PRIOR) -> Column:
    """1 + floor(SCALE (n + prior) / (total + prior kept)); 1 where nothing is kept. Longs hold it for most counts."""
    over, under = F.lit(SCALE) * (n + prior).cast("decimal(20,0)"), total + prior * kept
    whole = F.floor(over.cast("decimal(38,0)") / under.cast("decimal(20,0)")).cast("decimal(20,0)")
    # Division rounds its last digit: the quotient is set right by the remainder.
    product = (whole * under.cast("decimal(20,0)")).cast("decimal(38,0)")
    exact = (whole - F.when(product > over, 1).when(product + under <= over, -1).otherwise(0)).cast("long")
    short = F.lit(SCALE) * (n + prior)
    return F.lit(1).cast("long") + F.when(under <= 0, F.lit(0).cast("long")).when(n + prior < (1 << 62) // SCALE, F.call_function("div", short, under)).otherwise(exact)


def shares(docs: DataFrame, min_docs: int = MIN_DOCS, prior: int = PRIOR) -> tuple[DataFrame, DataFrame]:
    """(rows, groups), both written. rows: (lang, source, term, p, q) of the terms that a source has, with its share and
    the language's; groups: (lang, source, kept, baseline) of all sources."""
    # The tasks have summed; one exchange by language and term serves both sums, over a source and over the language.
    parts = counts(spread(docs)).repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = W.partitionBy("lang", "term")  # a row for each source
    both = parts.withColumn("lang_docs", F.sum("docs").over(term)).withColumn("lang_n", F.sum("n").over(term))
    found = materialize(both.filter((F.col("term") == "") | (F.col("lang_docs") >= min_docs)).select("lang", "source", "term", "n", "lang_n"), "kept-terms")
    held = found.filter("term <> ''")
    own = held.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = held.groupBy("lang", "term").agg(F.max("lang_n").alias("lang_n")).groupBy("lang").agg(F.count("*").alias("kept"), F.sum("lang_n").alias("lang_total"))
    groups = found.filter("term = ''").select("lang", "source").join(own, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0)
    groups = materialize(groups.withColumn("baseline", share(F.lit(0).cast("long"), F.col("total"), F.col("kept"), prior)), "term-groups")
    rows = _salted(held, F.xxhash64("term")).join(_replicated(groups), ["lang", "source", "salt"])
    p, q = share(F.col("n"), F.col("total"), F.col("kept"), prior), share(F.col("lang_n"), F.col("lang_total"), F.col("kept"), prior)
    rows = materialize(rows.select("lang", "source", "term", p.alias("p"), q.alias("q")), "term-shares")
    return rows, groups.select("lang", "source", "kept", "baseline")


def _salted(rows: DataFrame, by: Column) -> DataFrame:
    return rows.withColumn("salt", F.pmod(by, F.lit(_SALTS)).cast("int"))


def _replicated(rows: DataFrame) -> DataFrame:
    """A row for each salt."""
    return rows.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(_SALTS)])))


def distances(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, other, value) of all ordered pairs of different sources of a language."""
    other = groups.select("lang", F.col("source").alias("other"), F.col("baseline").alias("other_baseline"))
    pairs = groups.join(other, "lang").filter("source <> other")

    # Each source against the other's baseline: the sum of |p - x| - |b - x| over its terms, x the other's baseline. The
    # distinct shares, few and with how often they occur, and the baselines are sorted together; sums run below and above.
    base = groups.select("lang", "source", F.col("baseline").alias("own"))
    times = rows.groupBy("lang", "source", "p").agg(F.count("*").alias("n"))
    at = [F.col("p").alias("x"), "n", F.lit(None).cast("string").alias("other"), F.lit(None).cast("long").alias("kept")]
    points = times.select("lang", "source", *at).unionByName(pairs.select("lang", "source", F.col("other_baseline").alias("x"), F.lit(0).cast("long").alias("n"), "other", "kept"))
    ordered, all_of = W.partitionBy("lang", "source").orderBy("x").rangeBetween(W.unboundedPreceding, W.currentRow), W.partitionBy("lang", "source")
    mass = F.col("n") * F.col("x")
    sums = points.select(
        "lang", "source", "other", "kept", "x",
        F.sum("n").over(ordered).alias("n_below"), F.sum(mass).over(ordered).alias("sum_below"), F.sum("n").over(all_of).alias("n_all"), F.sum(mass).over(all_of).alias("sum_all"),
    ).filter("other IS NOT NULL")
    spread_out = F.expr("x * n_below - sum_below + (sum_all - sum_below) - x * (n_all - n_below)")
    against = sums.join(base, ["lang", "source"]).select(
        "lang", "source", "other", "kept", F.col("own").alias("b"), F.col("x").alias("c"), (spread_out - F.col("n_all") * F.abs(F.col("own") - F.col("x"))).alias("moved")
    )
    # The same from the other's side.
    back = against.select("lang", F.col("other").alias("source"), F.col("source").alias("other"), F.col("moved").alias("moved_back"))

    # Terms that both have: their distance instead of the three that were taken above.
    both = rows.join(base, ["lang", "source"]).select("lang", "term", "source", "p", F.col("own").alias("b"))
    right = both.select("lang", "term", F.col("source").alias("other"), F.col("p").alias("r"), F.col("b").alias("c"))
    met = both.join(right, ["lang", "term"]).filter("source < other")
    common = met.groupBy("lang", "source", "other").agg(F.sum(F.expr("abs(p - r) - abs(p - c) - abs(r - b) + abs(b - c)")).alias("common"))
    common = common.unionByName(common.select("lang", F.col("other").alias("source"), F.col("source").alias("other"), "common"))

    keys = ["lang", "source", "other"]
    value = F.expr("kept * abs(b - c) + moved + moved_back + coalesce(common, 0L)")
    return against.join(back, keys).join(common, keys, "left").select(*keys, value.alias("value"))


def _threshold(hist: DataFrame, group: list[str], bucket: str, ascending: bool) -> DataFrame:
    """From (group, bucket, c, need): each group's bucket in which the need-th row lies, and the need that is left in it.
    `c` are the rows of a bucket. Groups with fewer rows than needed have their last bucket."""
    order = F.asc(bucket) if ascending else F.desc(bucket)
    running = W.partitionBy(*group).orderBy(order)
    summed = hist.withColumn("before", F.sum("c").over(running) - F.col("c")).filter("before < need")
    last = F.max_by(F.struct(F.col(bucket).alias("bucket"), (F.col("need") - F.col("before")).alias("left")), "before").alias("t")
    return summed.groupBy(*group).agg(last).select(*group, F.col("t.bucket").alias("threshold"), F.col("t.left").alias("left"))


def _byte(item: str, at: int) -> Column:
    """1 more than the byte at a place of the item's UTF-8 form; 0 where it has ended."""
    digits = F.conv(F.hex(F.substring(F.encode(item, "UTF-8"), at + 1, 1)), 16, 10).cast("long")
    return F.when(F.octet_length(item) > at, digits + 1).otherwise(0)


def top_k(rows: DataFrame, group: list[str], value: str, item: str, k: int) -> DataFrame:
    """The first k rows of each group by `value` (a long from 0 to 2^32 - 1), largest first, then by the UTF-8 bytes of
    `item`, which a group has once; with `rank`. Radix selection, see above."""
    rows = _salted(rows.select(*group, value, item), F.xxhash64(item))

    def split(found: DataFrame, need: Column, digit: Column, ascending: bool, wanted: DataFrame | None) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(rows before the threshold's bucket, rows in it, what is still needed of them by group)"""
        marked = found.withColumn("digit", digit)
        hist = marked.groupBy(*group, "digit").agg(F.count("*").alias("c"))
        hist = hist.withColumn("need", need) if wanted is None else hist.join(wanted.withColumnRenamed("left", "need"), group)
        edge = materialize(_threshold(hist, group, "digit", ascending), "radix-thresholds")
        met = marked.join(_replicated(edge.select(*group, "threshold")), [*group, "salt"])
        before = F.col("digit") < F.col("threshold") if ascending else F.col("digit") > F.col("threshold")
        met = materialize(met.filter(before | (F.col("digit") == F.col("threshold"))).withColumn("sure", before), "radix-rows")
        plain = [*group, value, item, "salt"]
        return met.filter("sure").select(*plain), met.filter("NOT sure").select(*plain), edge.select(*group, "left")

    bits = f"length(bin(`{value}`))"
    cut = f"greatest({bits} - {_LEAD}, 0)"
    kept, rest, wanted = split(rows, F.lit(k).cast("long"), F.expr(f"({bits} << {_LEAD}) + shiftright(`{value}`, {cut})"), False, None)
    sure, rest, wanted = split(rest, F.lit(0), F.expr(f"`{value}` & (shiftleft(1L, {cut}) - 1L)"), False, wanted)
    kept = kept.unionByName(sure)
    # Rows of the threshold's value: two bytes of the item more in each round. A group whose are no more than it needs is done.
    at = 0
    while True:
        open_groups = rest.groupBy(*group).agg(F.count("*").alias("c")).join(wanted, group)
        done = _replicated(open_groups.filter("c <= left").select(*group))
        still = materialize(open_groups.filter("c > left").select(*group, "left"), "radix-open")
        kept = kept.unionByName(rest.join(done, [*group, "salt"], "left_semi"))
        if still.isEmpty():
            break
        rest = rest.join(_replicated(still.select(*group)), [*group, "salt"], "left_semi")
        sure, rest, wanted = split(rest, F.lit(0), _byte(item, at) * 257 + _byte(item, at + 1), True, still)
        kept = kept.unionByName(sure)
        at += 2
    chosen = materialize(kept.select(*group, value, item), "radix-chosen")
    return chosen.withColumn("rank", F.row_number().over(W.partitionBy(*group).orderBy(F.desc(value), F.encode(item, "UTF-8"))))  # k rows a group


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, prior: int = PRIOR, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: all pairs of sources of a language, and each source's `top` terms."""
    rows, groups = shares(docs, min_docs, prior)
    pairs = materialize(distances(rows, groups), "source-distances")
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), F.encode("other", "UTF-8"))
    pair = pairs.select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), "value", F.row_number().over(order).alias("rank"))
    above = rows.filter("p > q").select("lang", "source", "term", (F.col("p") - F.col("q")).alias("value"))
    best = top_k(above, ["lang", "source"], "value", "term", top)
    term = best.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")
    return pair.unionByName(term)


def oracle() -> str:
    """The same rows as DuckDB SQL, over dense rows of all groups and terms."""
    share_of = lambda n, total: f"(1 + ({SCALE}::HUGEINT * ({n} + {PRIOR})) // ({total} + {PRIOR} * v))::BIGINT"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
t AS (SELECT rid, lang, source, translate(unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM t GROUP BY ALL HAVING count(DISTINCT rid) >= {MIN_DOCS}),
l AS (SELECT lang, count(*) AS v, sum(n)::BIGINT AS total FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
gt AS (SELECT lang, source, sum(n)::BIGINT AS total FROM c GROUP BY ALL),
p AS (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n, {share_of("coalesce(c.n, 0)", "coalesce(gt.total, 0)")} AS p, {share_of("kept.n", "l.total")} AS q
  FROM g JOIN kept USING (lang) JOIN l USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term LEFT JOIN gt ON gt.lang = g.lang AND gt.source = g.source),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS f FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pr AS (SELECT a.lang, a.source, b.source AS item, coalesce(f.f, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
tm AS (SELECT lang, source, term AS item, p - q AS value FROM p WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, encode(item))::INT AS rank FROM pr
UNION ALL
SELECT * FROM (SELECT lang, source, 'term' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, encode(item))::INT AS rank FROM tm) WHERE rank <= {TOP}
"""
