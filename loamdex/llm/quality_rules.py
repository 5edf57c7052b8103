"""Quality rules with risk-controlled thresholds, in DataFrame functions alone.

Base statistics of every text decide the fixed base rule. Further rules reject a text when a statistic is above a
cutoff. The cutoffs stand on a ladder from loose to strict, all rules together: level i has the i-th cutoff of each, and
what a level rejects, all stricter ones do. For each stratum (language), labelled texts certify levels: a level
is certified when the exact binomial test rejects "it turns away more than `alpha` of the good texts". The levels are
tested from loose to strict up to the first failure, which needs no correction (a fixed sequence); the strata share
`delta` equally (Bonferroni). A stratum takes part if its number of labelled texts could certify anything at its share, which
depends on no outcome. The strictest certified level is used; a stratum without one has the base rule alone. So in
no stratum more than `alpha` of the good texts are turned away, with confidence `1 - delta` over all strata at once.

Defined results: a null text has no words (so `base_failed`); a null or unknown language falls in stratum `other`;
repeated rows are judged alike, each once; labels that are null count for nothing, and a document labelled both ways
is not good; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loamdex.llm.common import SPACE, only, words
from loamdex.session import materialize

LANGS = ("en", "fr", "de", "es")
ALPHA = 0.02
DELTA = 0.05
#: Statistic -> cutoffs, from loose to strict, one for each level. The ladder doesn't depend on the data.
LADDER = {
    "symbol_ratio": (0.2, 0.1, 0.05, 0.02, 0.01, 0.005),
    "dup_line_ratio": (0.7, 0.5, 0.4, 0.3, 0.2, 0.1),
    "repeat_ratio": (0.45, 0.4, 0.35, 0.3, 0.2, 0.15),
    "mean_word_chars": (20.0, 15.0, 12.0, 11.0, 10.0, 9.0),
}

#: Words in 3-word windows that a text holds twice or more. `w` are the words, `s` the windows sorted with their
#: places, `p` the sorted places of the windows that have an equal neighbour; a place covers up to 3 words of its own.
_REPEATED = """
transform(array({words}), w ->
  transform(array(sort_array(transform(slice(w, 1, greatest(size(w) - 2, 0)),
      (x, i) -> named_struct('g', concat_ws(' ', x, get(w, i + 1), get(w, i + 2)), 'p', i)))), s ->
    transform(array(sort_array(transform(filter(s, (x, i) -> x.g <=> get(s, i - 1).g or x.g <=> get(s, i + 1).g), x -> x.p))), p ->
      aggregate(transform(p, (x, i) -> least(3, coalesce(get(p, i + 1), x + 3) - x)), 0L, (a, b) -> a + b))[0])[0])[0]
"""


def base_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words of every whole text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    found = only(docs, doc_id="long", text="string", lang="string").withColumn("w", words(F.col("text")))
    return found.select(
        "doc_id",
        "lang",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.size(lines).cast("long").alias("n_lines"),
        F.expr(_REPEATED.format(words="w")).alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (F.lit(100) * F.col("n_repeat_words") > F.lit(50) * F.col("n_words"))


def _stratum() -> Column:
    return F.when(F.col("lang").isin(*LANGS), F.col("lang")).otherwise(F.lit("other"))


def _ratios() -> dict[str, Column]:
    over = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return {
        "symbol_ratio": over("n_symbols", "word_chars"),
        "dup_line_ratio": over("n_dup_lines", "n_lines"),
        "repeat_ratio": over("n_repeat_words", "n_words"),
        "mean_word_chars": over("word_chars", "n_words"),
    }


def _rejected_from(ladder: dict) -> Column:
    """The loosest level that rejects a text; null if none does."""
    ratios, levels = _ratios(), len(next(iter(ladder.values())))
    at = F.lit(None).cast("int")
    for i in reversed(range(levels)):
        above = F.lit(False)
        for rule, cutoffs in ladder.items():
            above = above | (ratios[rule] > F.lit(float(cutoffs[i])))
        at = F.when(above, F.lit(i)).otherwise(at)
    return at


#: ln(x!) by its exact value or Stirling's series (within 1e-12), and P(Binomial(n, a) <= k) for k < a n: its terms from
#: the k-th down, each by the ratio to the one before, as many as matter.
_FACTORIAL = "CASE WHEN {x} < 20 THEN ln(factorial(cast(least({x}, 19) AS int))) ELSE ({x} + 0.5D) * ln({x}) - {x} + 0.91893853320467274D + 1 / (12D * {x}) - 1 / (360D * pow({x}, 3)) + 1 / (1260D * pow({x}, 5)) END"
_TAIL = """
exp({n_} - {k_} - {r_} + k * ln({a}D) + (n - k) * ln(1 - {a}D)) *
  aggregate(sequence(0L, least(k, 200L + 40L * cast(ceil(sqrt(k)) AS bigint))), named_struct('term', 1D, 'sum', 0D),
    (acc, j) -> named_struct('term', acc.term * (k - j) * (1 - {a}D) / ((n - k + j + 1) * {a}D), 'sum', acc.sum + acc.term), acc -> acc.sum)
"""


def tail(a: float) -> Column:
    n, k, r = (_FACTORIAL.format(x=f"cast({x} AS double)") for x in ("n", "k", "(n - k)"))
    return F.expr(_TAIL.format(a=repr(a), n_=n, k_=k, r_=r))


def certified_levels(stats: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA, ladder: dict = LADDER) -> DataFrame:
    """(stratum, level): the strictest certified level, at most one row for each stratum."""
    levels = len(next(iter(ladder.values())))
    good = only(labels, doc_id="long", quality="int").dropna().groupBy("doc_id").agg(F.min("quality").alias("quality")).filter("quality = 1")
    held = stats.filter(~base_failed()).join(good, "doc_id", "left_semi").select(_stratum().alias("stratum"), _rejected_from(ladder).alias("at"))
    counts = held.groupBy("stratum").agg(F.count("*").alias("n"), *[F.count_if(F.col("at") <= i).alias(f"k{i}") for i in range(levels)])
    # A row for each stratum. The most that can take part: the m-th largest n must do at delta / m, were nothing rejected.
    ranked = counts.withColumn("rank", F.row_number().over(W.orderBy(F.desc("n"), "stratum")))
    able = F.when(F.pow(F.lit(1 - alpha), F.col("n")) <= F.lit(delta) / F.col("rank"), F.col("rank"))
    tested = ranked.withColumn("tests", F.max(able).over(W.partitionBy())).filter("rank <= tests")
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("level"), F.col(f"k{i}").alias("k")) for i in range(levels)]))
    passed = (F.col("k") < F.lit(alpha) * F.col("n")) & (tail(alpha) <= F.lit(delta) / F.col("tests"))
    rows = tested.select("stratum", "n", "tests", each.alias("e")).select("stratum", "n", "tests", "e.*").withColumn("passed", passed)
    failed = rows.groupBy("stratum").agg(F.coalesce(F.min(F.when(~F.col("passed"), F.col("level"))), F.lit(levels)).alias("failed"))
    return failed.filter("failed > 0").select("stratum", (F.col("failed") - 1).alias("level"))


def apply_rules(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA, ladder: dict = LADDER) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept of every row of `docs`.

    The statistics, a few numbers a text, are written once; both the certification and the verdict read them. The
    levels come to the driver as a row for each stratum and are compiled into one column expression.
    """
    stats = materialize(base_statistics(docs), "rule-statistics")
    rejected = F.lit(False)
    for row in sorted(certified_levels(stats, labels, alpha, delta, ladder).collect()):
        rejected = rejected | ((_stratum() == row.stratum) & F.coalesce(_rejected_from(ladder) <= row.level, F.lit(False)))
    return stats.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed().alias("base_failed"),
        (~base_failed() & ~rejected).alias("kept"),
    )


def oracle() -> str:
    """The same verdicts as DuckDB SQL."""
    ladder = ", ".join(f"('{rule}', {i}, {c!r}::DOUBLE)" for rule, cs in LADDER.items() for i, c in enumerate(cs))
    levels = len(LADDER["symbol_ratio"])
    langs = ", ".join(f"'{x}'" for x in LANGS)
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, CASE WHEN lang IN ({langs}) THEN lang ELSE 'other' END AS stratum FROM documents),
w AS (SELECT rid, unnest(ws) AS word, unnest(range(len(ws))) AS p FROM (SELECT rid, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws FROM d)),
g AS (SELECT rid, p, word || ' ' || lead(word) OVER t || ' ' || lead(word, 2) OVER t AS gram FROM w WINDOW t AS (PARTITION BY rid ORDER BY p)),
dup AS (SELECT rid, p FROM (SELECT rid, p, count(*) OVER (PARTITION BY rid, gram) AS c FROM g WHERE gram IS NOT NULL) WHERE c > 1),
rep AS (SELECT rid, count(DISTINCT q) AS n_repeat_words FROM (SELECT rid, p + unnest([0, 1, 2]) AS q FROM dup) GROUP BY rid),
ln AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY rid),
wc AS (SELECT rid, count(*) AS n_words, sum(length(word))::BIGINT AS word_chars FROM w GROUP BY rid),
s AS (SELECT d.rid, d.doc_id, stratum, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
  length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_lines, 0) AS n_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM d LEFT JOIN wc USING (rid) LEFT JOIN ln USING (rid) LEFT JOIN rep USING (rid)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, n_symbols / greatest(word_chars, 1) AS symbol_ratio, n_dup_lines / greatest(n_lines, 1) AS dup_line_ratio,
  n_repeat_words / greatest(n_words, 1) AS repeat_ratio, word_chars / greatest(n_words, 1) AS mean_word_chars FROM s),
v AS (SELECT rid, stratum, rule, value FROM b UNPIVOT (value FOR rule IN (symbol_ratio, dup_line_ratio, repeat_ratio, mean_word_chars))),
good AS (SELECT doc_id FROM labels WHERE quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1),
ladder(rule, level, cutoff) AS (VALUES {ladder}),
r AS (SELECT rid, stratum, min(level) AS lowest FROM v JOIN ladder USING (rule) WHERE value > cutoff GROUP BY ALL),
k AS (SELECT b.stratum, l.level, count(*) AS n, count(*) FILTER (lowest <= l.level) AS k FROM b JOIN good USING (doc_id) LEFT JOIN r USING (rid) CROSS JOIN (SELECT unnest(range({levels})) AS level) l WHERE NOT base_failed GROUP BY ALL),
m AS (SELECT max(place) AS tests FROM (SELECT n, row_number() OVER (ORDER BY n DESC, stratum) AS place FROM k WHERE level = 0) WHERE pow(1 - {ALPHA}, n) <= {DELTA} / place),
t AS (SELECT stratum, tests FROM (SELECT stratum, row_number() OVER (ORDER BY n DESC, stratum) AS place FROM k WHERE level = 0), m WHERE place <= tests),
c AS (SELECT stratum, coalesce(min(level) FILTER (NOT (k < {ALPHA} * n AND
  list_sum(list_transform(range(k + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({ALPHA}) + (n - j) * ln(1 - {ALPHA})))) <= {DELTA} / tests)), {levels}) AS failed FROM k JOIN t USING (stratum) GROUP BY stratum),
bad AS (SELECT rid FROM r JOIN c USING (stratum) WHERE lowest < failed)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND bad.rid IS NULL AS kept FROM b LEFT JOIN bad USING (rid)
"""
