"""The analyser of the search index: one chain for texts and queries.

Lower case, particles off, words split at everything that is no letter, digit or mark (so at `_`, too), diacritics folded,
English inflections stemmed. Splitting is done by column expressions; folding and stemming by one Arrow stage, which does
equal words of a batch once.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from loamdex.functions.stem import fold, porter
from loamdex.functions.text import TEXT_PARTICLE, WORD_PARTICLE

#: What words are made of, in Java's and RE2's syntax.
ANALYSED = r"\p{L}\p{N}\p{M}"


def raw_words(text: Column) -> Column:
    """The words in order, before folding and stemming."""
    low = F.lower(F.coalesce(text, F.lit("")))
    low = F.when(low.rlike("[가-힣]"), F.regexp_replace(low, TEXT_PARTICLE, "$1")).otherwise(low)
    return F.regexp_extract_all(low, F.lit(f"([{ANALYSED}]+)"))


def stem(word: str) -> str:
    return porter(fold(word))


def query_units(query: str) -> list[tuple[str, ...]]:
    """A query's words as the index has them, each a tuple of the terms that it is split into, which must stand together.
    Words of one character, and those of which nothing is left, are skipped."""
    import unicodedata

    particle = re.compile(WORD_PARTICLE)
    words = [particle.sub(r"\1", w) for w in re.sub(r"[^\w\s]", " ", query.lower()).split()]
    units = []
    for w in words:
        if len(w) < 2:
            continue
        parts = "".join(c if unicodedata.category(c)[0] in "LNM" else " " for c in w).split()
        terms = tuple(t for t in map(stem, parts) if t)
        if terms:
            units.append(terms)
    return units


# Porter's rules as regular expressions; the measure counts vowel-consonant sequences.
_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
_M0, _M1, _ONE = f"^({_C})?{_V}{_C}", f"^({_C})?{_V}{_C}{_V}{_C}", f"^({_C})?{_V}{_C}({_V})?$"
_HAS_VOWEL, _CVC = f"^({_C})?[aeiouy]", f"^{_C}[aeiouy][^aeiouwxy]$"


def stems_sql(words: str, name: str = "stems") -> str:
    """CTEs in DuckDB's SQL that end in `name`(word, stem), for the words of the relation `words`(word): the same stems by
    regular expressions over distinct words."""
    from loamdex.functions.stem import _STEP2, _STEP3, _STEP4

    # A first y is a consonant; it is written Y meanwhile, which no class has as a vowel.
    def cut(w: str, ends: dict[str, str], condition: str) -> str:
        """The longest end that fits is replaced if what stands before it fits the condition."""
        cases = []
        for end in sorted(ends, key=len, reverse=True):
            before = f"{w}[:-{len(end) + 1}]"
            extra = f" AND regexp_matches({before}, '[st]$')" if end == "ion" else ""
            cases.append(f"WHEN ends_with({w}, '{end}') THEN CASE WHEN regexp_matches({before}, '{condition}'){extra} THEN {before} || '{ends[end]}' ELSE {w} END")
        return f"CASE {' '.join(cases)} ELSE {w} END"

    vowel, m0, m1 = _HAS_VOWEL, _M0, _M1
    return f"""{name}_0 AS (SELECT DISTINCT word, strip_accents(word) AS folded FROM {words}),
{name}_a AS (SELECT word, folded, regexp_replace(folded, '^y', 'Y') AS w FROM {name}_0 WHERE regexp_matches(folded, '^[a-z]{{3,}}$')),
{name}_b AS (SELECT word, CASE WHEN ends_with(w, 'sses') OR ends_with(w, 'ies') THEN w[:-3] WHEN ends_with(w, 'ss') THEN w WHEN ends_with(w, 's') THEN w[:-2] ELSE w END AS w FROM {name}_a),
{name}_c AS (SELECT word, CASE WHEN ends_with(w, 'eed') THEN CASE WHEN regexp_matches(w[:-4], '{m0}') THEN w[:-2] ELSE w END
  WHEN ends_with(w, 'ed') AND regexp_matches(w[:-3], '{vowel}') THEN '+' || w[:-3] WHEN ends_with(w, 'ing') AND regexp_matches(w[:-4], '{vowel}') THEN '+' || w[:-4] ELSE w END AS w FROM {name}_b),
{name}_d AS (SELECT word, CASE WHEN NOT starts_with(w, '+') THEN w WHEN regexp_matches(w, '(at|bl|iz)$') THEN w[2:] || 'e'
  WHEN length(w) > 2 AND w[-1] = w[-2] AND regexp_matches(w, '[^aeiouylsz]$') THEN w[2:-2] WHEN regexp_matches(w[2:], '{_ONE}') AND regexp_matches(w[2:], '{_CVC}') THEN w[2:] || 'e' ELSE w[2:] END AS w FROM {name}_c),
{name}_e AS (SELECT word, CASE WHEN ends_with(w, 'y') AND regexp_matches(w[:-2], '{vowel}') THEN w[:-2] || 'i' ELSE w END AS w FROM {name}_d),
{name}_f AS (SELECT word, {cut("w", _STEP2, m0)} AS w FROM {name}_e),
{name}_g AS (SELECT word, {cut("w", _STEP3, m0)} AS w FROM {name}_f),
{name}_h AS (SELECT word, {cut("w", dict.fromkeys(_STEP4, ""), m1)} AS w FROM {name}_g),
{name}_i AS (SELECT word, CASE WHEN ends_with(w, 'e') AND (regexp_matches(w[:-2], '{m1}') OR regexp_matches(w[:-2], '{_ONE}') AND NOT regexp_matches(w[:-2], '{_CVC}')) THEN w[:-2] ELSE w END AS w FROM {name}_h),
{name}_j AS (SELECT word, CASE WHEN ends_with(w, 'll') AND regexp_matches(w[:-2], '{m1}') THEN w[:-2] ELSE w END AS w FROM {name}_i),
{name} AS (SELECT word, lower(w) AS stem FROM {name}_j UNION ALL SELECT word, folded FROM {name}_0 WHERE NOT regexp_matches(folded, '^[a-z]{{3,}}$'))"""
