"""Diacritics folding and Porter's stemmer (Porter 1980), for an index that matches inflected English words."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The suffix rules of Porter's paper, by step.
_STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
          "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _shape(word: str) -> str:
    """c and v for each letter: y is a vowel after a consonant."""
    out = ""
    for c in word:
        out += "v" if c in "aeiou" or c == "y" and out.endswith("c") else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _short(stem: str) -> bool:
    return bool(re.search("cvc$", _shape(stem))) and stem[-1] not in "wxy"


def porter(word: str) -> str:
    if len(word) <= 2 or not word.isascii() or not word.isalpha():
        return word
    w = word
    # 1a: plurals
    for end, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(end):
            w = w[: len(w) - len(end)] + new
            break
    # 1b: -eed, -ed, -ing
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) else w
    else:
        end = next((e for e in ("ed", "ing") if w.endswith(e) and "v" in _shape(w[: -len(e)])), "")
        if end:
            w = w[: -len(end)]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif len(w) > 1 and w[-1] == w[-2] and _shape(w)[-2:] == "cc" and w[-1] not in "lsz":
                w = w[:-1]
            elif _measure(w) == 1 and _short(w):
                w += "e"
    # 1c: -y
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for rules in (_STEP2, _STEP3):
        end = max((e for e in rules if w.endswith(e)), key=len, default="")
        if end and _measure(w[: -len(end)]) > 0:
            w = w[: -len(end)] + rules[end]
    end = max((e for e in _STEP4 if w.endswith(e)), key=len, default="")
    if end and _measure(w[: -len(end)]) > 1 and (end != "ion" or w[-4] in "st"):
        w = w[: -len(end)]
    # 5: final -e and -ll
    if w.endswith("e") and (_measure(w[:-1]) > 1 or _measure(w[:-1]) == 1 and not _short(w[:-1])):
        w = w[:-1]
    if w.endswith("ll") and _measure(w[:-1]) > 1:
        w = w[:-1]
    return w


def fold(word: str) -> str:
    """Lower case without diacritics."""
    if word.isascii():
        return word.lower()
    return unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", word.lower()) if unicodedata.category(c) != "Mn"))


@lru_cache(maxsize=100_000)
def _stemmed(word: str) -> str:
    return porter(fold(word))


@F.udf(StringType())
def _stem_joined(words: str | None) -> str | None:
    return None if words is None else "\x00".join(map(_stemmed, words.split("\x00")))


def stem_tokens(tokens: Column) -> Column:
    """Folded and stemmed tokens, without those of which nothing is left. They go to Python as one text a row, 100 rows at a
    time, and a worker keeps the stems of 100,000 words, so that its memory doesn't grow with the rows."""
    return F.filter(F.split(_stem_joined(F.array_join(tokens, "\x00")), "\x00"), lambda w: w != "")
