"""Mining a corpus for synonyms, term definitions and golden queries."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loamdex.functions.text import clean_question, word_set
from loamdex.session import materialize

# Korean nouns that are no synonyms, common abbreviations, column names that mean something else in each
# table, words of SQL, and audit columns.
STOP_NOUNS = (
    "확인", "요청", "작성", "제목", "구분", "내용", "등록", "수정", "삭제", "목록", "정보", "관리", "설정", "사용", "처리", "이름", "담당", "상태", "추가", "개선",
    "완료", "진행", "생성", "변경", "대상", "기준", "결과", "오류", "문제", "방법", "관련", "필요",
)
COMMON_ABBREVIATIONS = (
    "API", "URL", "SQL", "AWS", "GCP", "S3", "SSH", "UI", "UX", "ID", "DB", "CD", "CI", "HTTP", "HTTPS", "JSON", "YAML", "PR", "OK", "VM", "OS", "IP", "CPU", "RAM", "PDF",
    "CSV", "HTML", "CSS", "JS", "TS", "IT", "PC", "AS", "EC", "PO", "QA", "INFO",
)
GENERIC_COLUMNS = (
    "id", "name", "type", "value", "data", "url", "code", "status", "rank", "level", "description", "count", "date", "time", "created_at", "updated_at", "modified_at",
    "key", "label", "title", "text", "flag", "reason", "note", "memo", "amount", "price", "medium", "source", "target", "result", "message", "content", "comment",
)
SQL_WORDS = (
    "collate", "default", "not", "null", "character", "set", "primary", "key", "unique", "engine", "unsigned", "auto_increment", "timestamp", "varchar", "int", "bigint",
    "decimal", "text", "else", "then", "when", "case", "end", "as", "from", "where", "select", "insert", "update", "delete", "table", "index", "constraint", "references",
    "utf8mb4_unicode_ci", "utf8mb4_general_ci", "utf8_general_ci", "innodb", "float", "double", "datetime", "date", "tinyint", "smallint", "boolean", "bool", "json", "blob",
    "add", "alter", "column", "modify", "change", "drop", "comment",
)
AUDIT_COLUMNS = ("reg_date", "reg_id", "regist_dt", "regdt", "upd_date", "upd_id", "update_dt", "mod_date", "mod_id", "modify_dt", "del_yn", "use_yn", "ins_date", "ins_id")

# What makes a poor query word: more Korean nouns, English words, endings of verbs.
QUERY_STOP_NOUNS = (*STOP_NOUNS, "경우", "위해", "통해", "또는", "그리고", "이후", "이전", "각각", "해당", "아래", "다음", "현재")
QUERY_STOP_WORDS = ("the", "and", "for", "with", "this", "that", "from", "http", "https", "www", "com", "api", "url", "html", "json", "true", "false", "null", "data", "type", "name", "list")
VERB_ENDS = ("하고", "하기", "하는", "해서", "하여", "합니다", "했다", "한다", "됩니다", "되어", "입니다", "이다", "있다", "없다", "였다", "보고", "받고", "되는", "하지", "되고")

# The patterns of bracketed synonyms, abbreviations, column comments and defining sentences, and of what is
# no glossary title, no prose or no definition.
PAREN_LATIN = r"([A-Za-z][A-Za-z0-9 ]{1,18})\s*[(（]([가-힣]{2,12})[)）]"
PAREN_HANGUL = r"([가-힣]{2,12})\s*[(（]([A-Za-z][A-Za-z0-9 ]{1,18})[)）]"
ABBREVIATION = r"(?<![A-Za-z])([A-Z]{2,5})(?![A-Za-z0-9])"
SQL_COMMENT = r"(?im)^\s*[`\"']?([a-z_][a-z0-9_]{2,40})[`\"']?\s+[A-Za-z][^\n']{0,60}?COMMENT\s+'([^']{2,120})'"
SENTENCE = r"(?:^|\n)\s*([A-Za-z0-9_.]{2,24}|[가-힣]{2,12})\s*(?:는|은|이란|:)\s*([^\n]{10,140})"
NO_GLOSSARY = r"(?i)^\d{1,8}[\s.\-_)]|회의록|미팅|주간|일일|daily|weekly|회고|스프린트|sprint|경과|보고서?$|^[A-Z]\.\s|^사본|^Copy of"
PROSE_END = r"(다|음|함|입니다|이다|한다|된다|있다|없다|한다\.)[.\s]*$"
GREETING = r"^(안녕하세요|안녕하십니까|Hi[,\s]|Hello[,\s]|여러분)"
TABLE_OR_PATH = r"^\s*\||^[A-Za-z0-9_\-./\\]+\.[A-Za-z]{2,5}\s*$"

RANKS = {"sql_comment": 0, "title_exact": 1, "definition_sentence": 2}
CONTAINED, CONFLICT = 0.7, 0.10


def _pairs(text: Column, pattern: str, first: int, second: int) -> Column:
    """Structs (a, b) of two groups of all matches."""
    return F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(first)).alias("a"), F.regexp_extract_all(text, F.lit(pattern), F.lit(second)).alias("b"))


def bracket_pairs(docs: DataFrame, chars: int = 400) -> DataFrame:
    """(term, synonym, n): Latin terms with Hangul in brackets and the other way round, in title and first characters."""
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.substring("body", 1, chars))
    both = docs.select(F.explode(F.concat(_pairs(text, PAREN_LATIN, 1, 2), _pairs(text, PAREN_HANGUL, 2, 1))).alias("p"))
    named = both.select(F.trim("p.a").alias("term"), F.col("p.b").alias("synonym"))
    return named.groupBy("term", "synonym").agg(F.count("*").alias("n"))


def abbreviations(docs: DataFrame, chars: int = 400) -> DataFrame:
    """(term, n) of words of 2 to 5 capitals."""
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.substring("body", 1, chars))
    return docs.select(F.explode(F.regexp_extract_all(text, F.lit(ABBREVIATION), F.lit(1))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


def synonym_entries(pairs: DataFrame, abbrs: DataFrame, least: int = 2, deny_terms: tuple = (), deny_synonyms: tuple = ()) -> DataFrame:
    """(term, synonym, domain, n): pairs of two words at most that are no code names or stop nouns, and abbreviations."""
    code = F.col("term").rlike("[a-z][A-Z]|_")
    kept = pairs.filter((F.col("n") >= least) & (F.size(F.split("term", r"\s+")) <= 2) & ~F.col("synonym").isin(*STOP_NOUNS) & ~code)
    kept = kept.filter(~F.col("term").isin(*deny_terms, "") & ~F.col("synonym").isin(*deny_synonyms, ""))
    short = abbrs.filter((F.col("n") >= least) & ~F.col("term").isin(*COMMON_ABBREVIATIONS, *deny_terms))
    return kept.select("term", "synonym", F.lit("auto-paren").alias("domain"), "n").unionByName(short.select("term", F.lit(None).cast("string").alias("synonym"), F.lit("auto-abbr").alias("domain"), "n"))


def merge_entries(existing: DataFrame, entries: DataFrame) -> DataFrame:
    """(term, synonyms, added): the existing dictionary (term, synonyms) with mined synonyms; terms without any don't join."""
    mined = entries.filter("synonym IS NOT NULL").groupBy("term").agg(F.array_sort(F.collect_set("synonym")).alias("mined"))
    none = F.array().cast("array<string>")
    joined = existing.join(mined, "term", "full_outer")
    own = F.coalesce("synonyms", none)
    return joined.select("term", F.array_union(own, F.coalesce("mined", none)).alias("synonyms"), F.size(F.array_except(F.coalesce("mined", none), own)).alias("added"))


def body_lead(body: Column, most: int = 220) -> Column:
    """The first paragraph without headings."""
    text = F.regexp_replace(F.regexp_replace(F.coalesce(body, F.lit("")), r"(?m)^#{1,6}[ \t]*.*$", ""), r"^\s+|\s+$", "")
    return F.substring(F.regexp_replace(F.get(F.split(text, "\n\n", 2), F.lit(0)), r"^\s+|\s+$", ""), 1, most)


def normal_term(term: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(term, r"^\s+|\s+$", ""), r"\s+", " ")


def is_glossary_title(title: Column) -> Column:
    t = F.trim(F.coalesce(title, F.lit("")))
    return (t != "") & (F.length(t) <= 40) & ~t.rlike(NO_GLOSSARY) & (F.size(F.split(t, r"\s+")) <= 5) & ~t.isin(*STOP_NOUNS)


def term_candidates(docs: DataFrame, deny: tuple = (), chars: int = 4000) -> DataFrame:
    """(term, definition, source_type, confidence, doc_id) from SQL comments, glossary titles and defining sentences."""
    found = lambda pairs: docs.select("doc_id", F.explode(pairs).alias("p")).select("doc_id", normal_term(F.col("p.a")).alias("term"), F.trim("p.b").alias("definition"))
    low = F.lower("term")
    sql = found(_pairs(F.col("body"), SQL_COMMENT, 1, 2)).filter(~low.isin(*SQL_WORDS, *GENERIC_COLUMNS, *AUDIT_COLUMNS))
    lead = body_lead(F.col("body"))
    prose = (F.length(lead) >= 12) & ~lead.rlike(TABLE_OR_PATH) & ~lead.rlike(GREETING) & lead.rlike(PROSE_END) & lead.contains(" ")
    titles = docs.filter(is_glossary_title(F.col("title")) & prose).select("doc_id", normal_term(F.col("title")).alias("term"), lead.alias("definition"))
    sentences = found(_pairs(F.substring("body", 1, chars), SENTENCE, 1, 2)).filter(~F.col("term").isin(*STOP_NOUNS) & (F.length("term") >= 2) & ~low.isin(*GENERIC_COLUMNS))
    tag = lambda rows, kind, confidence: rows.select("term", "definition", F.lit(kind).alias("source_type"), F.lit(confidence).alias("confidence"), "doc_id")
    out = tag(sql, "sql_comment", "high").unionByName(tag(titles, "title_exact", "medium")).unionByName(tag(sentences, "definition_sentence", "low"))
    return out.filter(~F.col("term").isin(*deny)) if deny else out


def conflict(a: Column, b: Column, contained: Column | float = CONTAINED, least: Column | float = CONFLICT) -> Column:
    """Whether two definitions differ: the smaller word set isn't mostly within the larger, and few words are common."""
    x, y = word_set(a), word_set(b)
    common = F.size(F.array_intersect(x, y))
    small, union = F.least(F.size(x), F.size(y)), F.size(F.array_union(x, y))
    value = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.when(small == 0, F.lit(False)).otherwise((common / F.greatest(small, F.lit(1)) < value(contained)) & (common / F.greatest(union, F.lit(1)) < value(least)))


def _conflicts(a: str, b: str) -> bool:
    import re

    x, y = (set(re.findall("[가-힣A-Za-z0-9]+", t.lower())) for t in (a, b))
    return bool(x and y) and len(x & y) < CONTAINED * min(len(x), len(y)) and len(x & y) < CONFLICT * len(x | y)


def term_entries(candidates: DataFrame, least: int = 1) -> DataFrame:
    """(term, definition, source_type, n, conflicts): the candidate of the best channel (then doc_id), and definitions of
    an equal channel that conflict with it or with one that was found to conflict before."""
    schema = "term string, definition string, source_type string, n long, conflicts array<string>"

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = sorted(pdf.to_dict("records"), key=lambda r: (RANKS.get(r["source_type"], 9), r["doc_id"], r["definition"]))
        if len(rows) < least:
            return pd.DataFrame(columns=["term", "definition", "source_type", "n", "conflicts"])
        first, seen, out = rows[0], [rows[0]["definition"]], []
        for r in rows[1:]:
            if RANKS.get(r["source_type"], 9) <= RANKS.get(first["source_type"], 9) and any(_conflicts(r["definition"], d) for d in seen):
                out.append(r["definition"])
                seen.append(r["definition"])
        return pd.DataFrame([{"term": first["term"], "definition": first["definition"], "source_type": first["source_type"], "n": len(rows), "conflicts": out}])

    # Equal definitions of a channel fold before the term's rows meet.
    folded = candidates.groupBy("term", "definition", "source_type").agg(F.min("doc_id").alias("doc_id"))
    return folded.groupBy("term").applyInPandas(build, schema)


def ddl_comments(docs: DataFrame) -> DataFrame:
    """(tab, col, comment) of the columns in CREATE TABLE blocks."""
    blocks = F.regexp_extract_all("body", F.lit(r"(?is)(CREATE TABLE\s+.*?)(?=CREATE TABLE\s|\z)"), F.lit(1))
    block = docs.select(F.explode(blocks).alias("block")).select(F.lower(F.regexp_extract("block", r"(?i)CREATE TABLE\s+(?:IF NOT EXISTS\s+)?[`\"']?([A-Za-z0-9_.]+)", 1)).alias("tab"), "block")
    rows = block.select("tab", F.explode(_pairs(F.col("block"), SQL_COMMENT, 1, 2)).alias("p")).select("tab", F.lower("p.a").alias("col"), F.trim("p.b").alias("comment"))
    return rows.filter(~F.col("col").isin(*SQL_WORDS)).distinct()


def definition_pairs(comments: DataFrame) -> DataFrame:
    """(a, b, conflict): comments of one column (no conflict), and of two columns of a table (a conflict), as many of each,
    chosen by hash order."""
    same = comments.alias("x").join(comments.alias("y"), (F.col("x.tab") == F.col("y.tab")) & (F.col("x.col") == F.col("y.col")) & (F.col("x.comment") < F.col("y.comment")))
    same = same.select(F.col("x.comment").alias("a"), F.col("y.comment").alias("b"), F.lit(False).alias("conflict")).distinct()
    first = comments.groupBy("tab", "col").agg(F.min("comment").alias("comment"))
    other = first.alias("x").join(first.alias("y"), (F.col("x.tab") == F.col("y.tab")) & (F.col("x.col") < F.col("y.col")) & (F.col("x.comment") != F.col("y.comment")))
    other = other.select(F.col("x.comment").alias("a"), F.col("y.comment").alias("b"), F.lit(True).alias("conflict")).distinct()
    both = same.unionByName(other)
    sizes = both.groupBy("conflict").agg(F.count("*").alias("n")).agg(F.min("n").alias("most"), F.count("*").alias("kinds"))
    order = F.row_number().over(W.partitionBy("conflict").orderBy(F.md5(F.concat_ws("|", "a", "b")), "a", "b"))
    return both.withColumn("at", order).crossJoin(F.broadcast(sizes)).filter((F.col("kinds") == 2) & (F.col("at") <= F.col("most"))).select("a", "b", "conflict")  # sizes is one row


def calibrate_conflict(pairs: DataFrame, contained: tuple = (0.5, 0.6, 0.7, 0.8, 0.9, 1.0), least: tuple = (0.10, 0.15, 0.20, 0.25, 0.30, 0.40, 0.50)) -> DataFrame:
    """(contained, least, tp, fp, tn, fn, precision, recall, f1, accuracy) over the grid of thresholds."""
    grid = F.explode(F.array(*[F.struct(F.lit(c).alias("contained"), F.lit(j).alias("least")) for c in contained for j in least]))
    rows = pairs.select("*", grid.alias("g")).select("conflict", F.col("g.contained").alias("contained"), F.col("g.least").alias("least"), conflict(F.col("a"), F.col("b"), F.col("g.contained"), F.col("g.least")).alias("said"))
    return confusion(rows, "conflict", "said", ["contained", "least"])


def confusion(rows: DataFrame, truth: str, said: str, by: list[str]) -> DataFrame:
    """Counts and precision, recall, F1 and accuracy of boolean columns."""
    t, s = F.col(truth), F.col(said)
    out = rows.groupBy(*by).agg(F.count_if(t & s).alias("tp"), F.count_if(~t & s).alias("fp"), F.count_if(~t & ~s).alias("tn"), F.count_if(t & ~s).alias("fn"))
    ratio = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    precision, recall = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    out = out.withColumns({"precision": precision, "recall": recall})
    f1 = F.coalesce(2 * F.col("precision") * F.col("recall") / F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0)), F.lit(0.0))
    return out.withColumns({"f1": f1, "accuracy": ratio(F.col("tp") + F.col("tn"), F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn"))})


def document_frequency(docs: DataFrame, column: str = "body") -> DataFrame:
    return docs.select(F.explode(word_set(F.col(column), 2)).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def query_words(text: Column) -> Column:
    """Words that may stand in a query: nouns of two syllables or more without particle, and Latin words that are neither
    common nor, from 8 characters on, mixed with digits."""
    from loamdex.functions.text import strip_particle

    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("([가-힣]{2,}|[A-Za-z][A-Za-z0-9_]+)"))
    latin = lambda t: t.rlike("^[A-Za-z]")
    good = F.filter(found, lambda t: F.when(latin(t), ~F.lower(t).isin(*QUERY_STOP_WORDS) & ~((F.length(t) >= 8) & t.rlike("[0-9]"))).otherwise(~t.rlike(f"({'|'.join(VERB_ENDS)})$")))
    bare = F.transform(good, lambda t: F.when(latin(t), t).otherwise(strip_particle(t)))
    return F.filter(bare, lambda t: latin(t) | ((F.length(t) >= 2) & ~t.isin(*QUERY_STOP_NOUNS)))


def rare_term_queries(docs: DataFrame, terms: int = 3, part: float = 0.05, most_queries: int | None = None) -> DataFrame:
    """(doc_id, title, query): the rarest words of a body that aren't in its title, are in two documents at least and in
    max(5 %, 3) at most; ties by frequency in the body, then by the word. Documents with fewer give none."""
    from loamdex.functions.text import run_starts

    texts = docs.select("doc_id", "title", "body")
    if not docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():  # rows of one document are read as one text
        texts = texts.groupBy("doc_id").agg(*[F.array_join(F.collect_list(c), "\n").alias(c) for c in ("title", "body")])
    words = texts.select("doc_id", F.transform(query_words(F.col("title")), F.lower).alias("lows"), F.sort_array(query_words(F.col("body"))).alias("all"))
    words = words.withColumn("starts", run_starts("all"))

    def run(i: Column, k: Column) -> Column:
        term = F.get("all", i)
        n = F.coalesce(F.get("starts", k + 1), F.size("all")) - i
        return F.struct(term.alias("term"), n.alias("tf"), F.array_contains("lows", F.lower(term)).alias("in_title"))

    # Counted within the rows and written, as frequencies and the words themselves read it; only the latter are shuffled.
    tf = materialize(words.select("doc_id", F.explode(F.transform("starts", run)).alias("w")).select("doc_id", "w.*"), "query-words")
    limit = docs.agg(F.greatest(F.floor(F.count("*") * part), F.lit(3)).alias("most"))
    df = tf.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(limit)).filter("df >= 2 AND df <= most").select("term", "df")  # limit is one row
    rare = tf.filter("NOT in_title").select("doc_id", "term", "tf").join(df, "term")
    first = rare.withColumn("n", F.row_number().over(W.partitionBy("doc_id").orderBy("df", F.desc("tf"), "term"))).filter(F.col("n") <= terms)
    made = first.groupBy("doc_id").agg(F.count("*").alias("c"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "term"))), lambda x: x["term"]), " ").alias("query"))
    out = made.filter(F.col("c") == terms).join(docs.select("doc_id", "title"), "doc_id").select("doc_id", "title", "query")
    return out.orderBy("doc_id").limit(most_queries) if most_queries else out


def validate_questions(rows: DataFrame, anchors: int = 1) -> DataFrame:
    """Adds `verdict` to (question, title, body): ok, length, no tokens, title copy or no anchor."""
    q, t, b = word_set(F.col("q"), 2), word_set(F.col("title"), 2), word_set(F.col("body"), 2)
    cleaned = rows.withColumn("q", clean_question(F.col("question")))
    copied = (F.size(t) > 0) & (F.size(F.array_intersect(q, t)) / F.greatest(F.size(q), F.lit(1)) >= 0.8)
    verdict = (
        F.when(~F.length("q").between(4, 60), "length").when(F.size(q) == 0, "no tokens").when(copied, "title copy").when(F.size(F.array_intersect(q, b)) < anchors, "no anchor").otherwise("ok")
    )
    return cleaned.withColumn("verdict", verdict).drop("q")


def distinct_questions(rows: DataFrame, most: float = 0.6) -> DataFrame:
    """Of each document's questions (doc_id, at, question), in order, those that aren't too like a kept one. A document's rows
    meet as one array, which column expressions walk."""
    rest = [c for c in rows.columns if c not in ("doc_id", "at", "question")]
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("question", F.lit(""))), F.lit("([가-힣A-Za-z0-9]{2,})")))
    asked = rows.select("doc_id", F.struct("at", "question", words.alias("words"), *rest).alias("q")).groupBy("doc_id").agg(F.array_sort(F.collect_list("q")).alias("asked"))

    def alike(x: Column, y: Column) -> Column:
        return F.size(F.array_intersect(x["words"], y["words"])) > most * F.greatest(F.lit(1), F.size(F.array_union(x["words"], y["words"])))

    none = F.filter("asked", lambda x: F.lit(False))
    kept = F.aggregate("asked", none, lambda kept, x: F.when(F.exists(kept, lambda k: alike(k, x)), kept).otherwise(F.concat(kept, F.array(x))))
    return asked.select("doc_id", F.explode(kept).alias("q")).select(*[F.col("doc_id") if c == "doc_id" else F.col("q")[c].alias(c) for c in rows.columns])
