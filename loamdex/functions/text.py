"""Text functions as column expressions: normalisation, classification, snippets and compression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters of a word, in Java's and RE2's syntax.
WORD_CHARS = r"\p{L}\p{N}_"

# The particles that may end a Korean word.
PARTICLES = (
    "으로서", "으로써", "에서", "에게", "한테", "까지", "부터", "마다", "조차", "라도", "이나", "처럼", "보다", "같이", "이라", "으로", "이며",
    "을", "를", "은", "는", "이", "가", "의", "에", "와", "과", "도", "만", "로", "나", "라", "및", "께", "요",
)

# States in parentheses after an author's name, and the name of those who can't be told.
AUTHOR_STATES = ("deactivated", "unlicensed", "deleted", "inactive", "disabled", "suspended", "퇴사", "비활성", "탈퇴", "삭제")
ANONYMOUS = "(익명)"

# Document types and the words that tell them, the first match counts.
DOC_TYPES = (
    ("meeting", ("회의록", "회의", "미팅", "weekly", "주간", "daily", "스크럼", "스탠드업")),
    ("retro", ("회고", "retro", "포스트모템", "postmortem", "kpt")),
    ("data_model", ("스키마", "schema", "데이터모델", "ddl", "테이블정의", "erd", "data schema")),
    ("spec", ("명세", "스펙", "spec", "요구사항", "requirement")),
    ("design", ("설계", "디자인", "design", "아키텍처", "architecture")),
    ("issue", ("이슈", "오류", "장애", "버그", "issue", "bug", "트러블", "incident")),
    ("analysis", ("분석", "리포트", "report", "지표", "통계", "metric")),
    ("ops", ("운영", "배포", "ops", "deploy", "인프라", "infra", "런북", "runbook")),
    ("planning", ("기획", "계획", "roadmap", "로드맵", "전략", "planning")),
    ("notice", ("공지", "notice", "안내사항", "announcement")),
    ("glossary", ("용어집", "용어 정리", "용어사전", "약어", "acronym", "glossary", "terminology")),
    ("guide", ("가이드", "매뉴얼", "안내", "사용법", "guide", "manual", "how-to", "튜토리얼")),
)

# The prefixes of Conventional Commits.
COMMIT_TYPES = ("feat", "fix", "docs", "style", "refactor", "perf", "test", "build", "ci", "chore", "revert")

_PARTICLE_PATTERN = "|".join(sorted(PARTICLES, key=len, reverse=True))
#: For a single word; the lazy prefix leaves the longest particle to the end, and at least two characters before it.
WORD_PARTICLE = f"^(.{{2,}}?)({_PARTICLE_PATTERN})$"
#: For words inside of a text.
TEXT_PARTICLE = f"(?<![{WORD_CHARS}])([{WORD_CHARS}]{{2,}}?)({_PARTICLE_PATTERN})(?![{WORD_CHARS}])"


def strip_particle(word: Column) -> Column:
    """One trailing particle goes, if two characters or more remain."""
    return F.regexp_replace(word, WORD_PARTICLE, "$1")


def normalize_words(text: Column) -> Column:
    """Words without punctuation and particles, joined by spaces."""
    parts = F.filter(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), rf"[^{WORD_CHARS}\s]", " "), r"\s+"), lambda w: w != "")
    return F.array_join(F.transform(parts, strip_particle), " ")


def tokens(text: Column) -> Column:
    """Lower-case words for the term index. Particles are looked for only where there is Hangul."""
    low = F.lower(F.coalesce(text, F.lit("")))
    low = F.when(low.rlike("[가-힣]"), F.regexp_replace(low, TEXT_PARTICLE, "$1")).otherwise(low)
    return F.regexp_extract_all(low, F.lit(f"([{WORD_CHARS}]+)"))


def run_starts(words: str) -> Column:
    """Where runs of equal words begin in a sorted array column. It has to be a column of its own, since its elements are looked
    up one by one."""
    first = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: (i == 0) | (F.get(words, i) != F.get(words, i - 1)))
    return F.when(F.size(words) > 0, first).otherwise(F.array().cast("array<int>"))


def query_terms(query: str) -> list[str]:
    """A query's terms as the index holds them: words of two characters or more, without particles, in order."""
    import re

    particle = re.compile(WORD_PARTICLE)
    words = re.sub(r"[^\w\s]", " ", query.lower()).split()
    return [w for w in (particle.sub(r"\1", w) for w in words) if len(w) >= 2]


def parse_iso8601(value: Column) -> Column:
    """A timestamp (UTC where no zone is given), or null. Dates, `Z`, `z`, `+09:00` and `+0900` are read."""
    text = F.trim(value)
    zoned = F.regexp_replace(F.regexp_replace(text, "[zZ]$", "+00:00"), r"([+-]\d{2})(\d{2})$", "$1:$2")
    zoned = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text).otherwise(zoned)
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(zoned))


def normalize_author(value: Column) -> Column:
    states = "|".join(AUTHOR_STATES)
    s = F.trim(F.coalesce(value, F.lit("")))
    clean = F.trim(F.regexp_replace(F.regexp_replace(s, rf"(?i)\s*\(\s*({states})\s*\)", ""), r"\s+", " "))
    return F.when(s.rlike("(?i)^former user") | F.lower(s).isin("anonymous", "unknown"), F.lit(ANONYMOUS)).otherwise(clean)


def normalize_category(value: Column) -> Column:
    s = F.trim(F.coalesce(value, F.lit("")))
    s = F.regexp_replace(F.regexp_replace(s, '^"+|"+$', ""), "^'+|'+$", "")
    return F.regexp_replace(F.trim(F.regexp_replace(s, "^#+", "")), r"\s+", " ")


def normalize_label(value: Column) -> Column:
    """Without decoration in front; a label of decoration alone stays."""
    s = F.trim(F.coalesce(value, F.lit("")))
    clean = F.regexp_replace(F.trim(F.regexp_replace(s, r"^[●·•‣▪◦∙◆▶▷○✱*※ \t]+", "")), r"\s+", " ")
    return F.when(clean == "", s).otherwise(clean)


def doc_type(title: Column, hierarchy: Column, tags: Column, rules: tuple = ()) -> Column:
    """The first type, own `rules` before the built-in ones, of which a word is in title, hierarchy or tags; else null."""
    empty = F.array().cast("array<string>")
    text = F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.array_join(F.coalesce(hierarchy, empty), " "), F.array_join(F.coalesce(tags, empty), " ")))
    found = F.lit(None).cast("string")
    for name, words in reversed((*rules, *DOC_TYPES)):
        hit = F.lit(False)
        for w in words:
            hit = hit | text.contains(w.lower())
        found = F.when(hit, F.lit(name)).otherwise(found)
    return found


def parse_doc_type_rules(setting: str) -> tuple[tuple[str, tuple[str, ...]], ...]:
    """Rules from `type:word|word,type:word`; parts without a colon or words are skipped."""
    out = []
    for part in setting.split(","):
        name, colon, words = part.strip().partition(":")
        kept = tuple(w.strip() for w in words.split("|") if w.strip())
        if colon and name.strip() and kept:
            out.append((name.strip(), kept))
    return tuple(out)


def commit_type(subject: Column) -> Column:
    kinds = "|".join(COMMIT_TYPES)
    return F.nullif(F.lower(F.regexp_extract(F.trim(subject), rf"(?i)^({kinds})(\([^)]*\))?!?:\s", 1)), F.lit(""))


def first_heading(body: Column) -> Column:
    """The first line that begins with #, without the marks; null if there is none or it is empty."""
    lines = F.filter(F.transform(F.split(body, r"\r?\n"), lambda x: F.trim(x)), lambda x: x.startswith("#"))
    return F.nullif(F.trim(F.regexp_replace(F.get(lines, F.lit(0)), "^#+", "")), F.lit(""))


def html_title(html: Column, fallback: Column) -> Column:
    """<title>, else the first h1, else the first h2, else the fallback; whichever isn't blank."""
    inner = lambda tag: F.trim(F.regexp_replace(F.regexp_extract(html, rf"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1), "<[^>]*>", ""))
    return F.coalesce(*[F.nullif(inner(t), F.lit("")) for t in ("title", "h1", "h2")], fallback)


def estimate_tokens(text: Column) -> Column:
    """Hangul counts 1 / 1.6, other characters 1 / 4 of a token."""
    other = F.length(F.regexp_replace(text, "[가-힣]", ""))
    return F.floor((F.length(text) - other) / 1.6 + other / 4).cast("long") + 1


def strip_whitespace(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def heading_outline(text: Column) -> Column:
    """The heading lines; the text itself if there is none."""
    lines = F.filter(F.split(text, r"\n"), lambda x: x.rlike(r"^#{1,6}\s"))
    return F.when(F.size(lines) > 0, F.array_join(lines, "\n")).otherwise(text)


def shorten_urls(text: Column) -> Column:
    """URLs without query; of those over 60 characters the first 40 and the last 15."""
    bare = F.regexp_replace(text, r"(https?://[^\s?]+)\?\S*", "$1")
    return F.regexp_replace(bare, r"(https://\S{32}|http://\S{33})\S{6,}(\S{15})(?!\S)", "$1…$2")


def truncate_at_section(text: Column, most: int) -> Column:
    """Whole blocks (split before blank lines and headings) while the estimate stays within `most` tokens."""
    blocks = F.split(text, r"(?=\n\n)|(?<=\n\n)|(?=\n#{1,6}\s)")
    kept = F.aggregate(
        blocks,
        F.struct(F.lit("").alias("t"), F.lit(True).alias("go")),
        lambda acc, b: F.struct(
            F.when(acc.go & (estimate_tokens(F.concat(acc.t, b)) <= most), F.concat(acc.t, b)).otherwise(acc.t).alias("t"),
            (acc.go & (estimate_tokens(F.concat(acc.t, b)) <= most)).alias("go"),
        ),
        lambda acc: acc.t,
    )
    return F.when(estimate_tokens(text) <= most, text).otherwise(F.concat(F.regexp_replace(kept, r"\s+$", ""), F.lit("\n… (truncated)")))


def _mark(text: Column, terms: list[str]) -> Column:
    import re

    for t in terms:
        text = F.regexp_replace(text, f"(?i){re.escape(t)}", "<b>$0</b>")
    return text


def highlight(text: Column, query: str, before: int = 40, after: int = 80, lead: int = 200) -> Column:
    """A window around the first term that is found, in the order of the query, with all terms marked."""
    import re

    terms = [t for t in re.sub(r"[^\w\s]", " ", query).split() if len(t) >= 2]
    cut = F.length(text) > lead
    plain = _mark(F.substring(text, 1, lead), terms)
    out = F.concat(plain, F.when(cut, F.lit("...")).otherwise(F.lit("")))
    for t in reversed(terms):
        at = F.locate(t.lower(), F.lower(text))  # from 1
        begin = F.greatest(F.lit(1), at - before)
        end = F.least(F.length(text), at + len(t) - 1 + after)
        window = _mark(text.substr(begin, end - begin + 1), terms)
        window = F.concat(F.when(begin > 1, F.lit("...")).otherwise(F.lit("")), window, F.when(end < F.length(text), F.lit("...")).otherwise(F.lit("")))
        out = F.when(at > 0, window).otherwise(out)
    return out


def sigmoid(x: Column) -> Column:
    """1 / (1 + e^x): high for low values, clamped beyond 100."""
    return F.when(x > 100, F.lit(0.0)).when(x < -100, F.lit(1.0)).otherwise(1 / (1 + F.exp(x)))


def recency_decay(at: Column, as_of: Column, half_life_days: float = 30.0) -> Column:
    """0.5 ** (age / half life); 0 without a date, 1 for the future."""
    days = F.greatest(F.lit(0.0), (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(at.cast("timestamp"))) / 86_400_000_000)
    return F.coalesce(F.pow(F.lit(0.5), days / half_life_days), F.lit(0.0))


def passages(text: Column) -> Column:
    """Sentences and lines, trimmed, without empty ones."""
    parts = F.split(text, r"(?<=[.!?。…])\s+|\n+")
    return F.filter(F.transform(parts, lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")


def detect_extract_type(text: Column) -> Column:
    """meeting, spec or unknown, for structured extraction."""
    return (
        F.when(text.rlike(r"(?m)^\d{1,2}:\d{2}:\d{2}\s*$"), "meeting")
        .when(text.rlike(r"(?i)(CREATE TABLE|SELECT .+FROM|public (class|static))"), "spec")
        .when(text.rlike(r"(?i)```(sql|java|python)"), "spec")
        .when(text.rlike(r"\|\s*[-:]+\s*\|") & (F.length(text) > 300), "spec")
        .otherwise("unknown")
    )


def clean_question(q: Column) -> Column:
    q = F.regexp_replace(q, r"\*{1,3}([^*]+)\*{1,3}", "$1")
    return F.trim(F.regexp_replace(F.regexp_replace(q, r"[`_~]{1,3}", ""), r"\s+", " "))


def word_set(text: Column, least: int = 1) -> Column:
    """Distinct lower-case runs of Hangul, Latin letters and digits."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(f"([가-힣A-Za-z0-9]{{{least},}})")))


def doc_id(source: Column, source_id: Column) -> Column:
    return F.sha1(F.concat(source, F.lit(":"), source_id))


def content_hash(title: Column, body: Column, tags: Column, hierarchy: Column) -> Column:
    """SHA-256 over title, body, sorted tags and hierarchy, the lists in JSON with a space after each comma."""
    listed = lambda xs: F.concat(F.lit("["), F.array_join(F.transform(xs, lambda x: F.concat(F.lit('"'), F.regexp_replace(x, r'(["\\])', r"\\$1"), F.lit('"'))), ", "), F.lit("]"))
    return F.sha2(F.concat(title, body, listed(F.array_sort(tags)), listed(hierarchy)), 256)
