"""Queries of text functions, sources and expansion over the tables. Their inputs are expressions over the tables' columns,
written once in the part of SQL that both engines read; the answers are computed in SQL by other means than the functions.
The literal cases of the same functions are in `text_queries` and `search_queries`, as tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamdex.functions import markdown
from loamdex.functions import text as T
from loamdex.operators import fusion, mining
from loamdex.plans.registry import query
from loamdex.plans.text_queries import _PARTICLES
from loamdex.session import read_table
from loamdex.sources import bronze

NL = "chr(10)"
DAY = "lpad(CAST(doc_id % 31 + 1 AS STRING), 2, '0')"


def given(spark: SparkSession, sf: str, value: str, name: str = "v") -> DataFrame:
    """(id, value) of every document."""
    return read_table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.expr(value).alias(name))


def cases(count: int, *values: str) -> str:
    """One of the values by doc_id % count; the last one for the rest."""
    whens = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values[:-1]))
    return f"CASE doc_id % {count} {whens} ELSE {values[-1]} END"


def answers(**columns: str) -> str:
    return "SELECT doc_id AS id, " + ", ".join(f"{v} AS {k}" for k, v in columns.items()) + " FROM documents"


DATES = cases(8, f"'2023-12-' || {DAY} || 'T10:17:37.790+0900'", f"'2023-12-' || {DAY}", f"'2023-12-' || {DAY} || 'T10:17:37Z'", f"'2023-12-' || {DAY} || 'T10:17:37z'", f"'2023-12-' || {DAY} || 'T10:17:37+09:00'", "'2023-13-45T99:99:99'", "'x' || text", f"'2023-12-' || {DAY} || 'T10:17:37'")
_AT = "TIMESTAMP '2023-12-01 10:17:37' + (doc_id % 31)::INTEGER * INTERVAL 1 DAY"


@query("n3_dates", answers(at=f"strftime({cases(8, f'{_AT} - INTERVAL 9 HOUR + INTERVAL 790 MILLISECOND', f'date_trunc($$day$$, {_AT})', _AT, _AT, f'{_AT} - INTERVAL 9 HOUR', 'NULL', 'NULL', _AT)}, '%Y-%m-%d %H:%M:%S.%g')".replace("$$day$$", "'day'")))
def n3(spark: SparkSession, sf: str) -> DataFrame:
    return given(spark, sf, DATES).select("id", F.date_format(T.parse_iso8601(F.col("v")), "yyyy-MM-dd HH:mm:ss.SSS").alias("at"))


AUTHORS = cases(6, "' ' || source || ' (Unlicensed) '", "source || ' (Dev)  (deactivated)'", "'Former user (' || lang || ')'", "'ANONYMOUS'", "NULL", "source || '   ' || lang")


@query("n4_authors", answers(author=cases(6, "source", "source || ' (Dev)'", "'(익명)'", "'(익명)'", "''", "source || ' ' || lang")))
def n4(spark: SparkSession, sf: str) -> DataFrame:
    return given(spark, sf, AUTHORS).select("id", T.normalize_author(F.col("v")).alias("author"))


CATEGORIES = cases(5, "'\"' || source || '\"'", "'##  ' || source || '   ' || lang", "' ''' || lang || ''' '", "NULL", "source || ' #' || lang")


@query("n5_categories", answers(category=cases(5, "source", "source || ' ' || lang", "lang", "''", "source || ' #' || lang"), dirty=cases(5, "true", "true", "false", "NULL", "false")))
def n5(spark: SparkSession, sf: str) -> DataFrame:
    from loamdex.operators.filters import dirty_category

    return given(spark, sf, CATEGORIES).select("id", T.normalize_category(F.col("v")).alias("category"), dirty_category(F.col("v")).alias("dirty"))


LABELS = cases(5, "'● ▶ ' || source || '  ' || lang", "'***'", "'[' || source || '] x'", "NULL", "source || ' ●'")


@query("n6_labels", answers(label=cases(5, "source || ' ' || lang", "'***'", "'[' || source || '] x'", "''", "source || ' ●'")))
def n6(spark: SparkSession, sf: str) -> DataFrame:
    return given(spark, sf, LABELS).select("id", T.normalize_label(F.col("v")).alias("label"))


TITLES = cases(7, "lang || ' 회의록'", "'API Design ' || source", "source", "lang", "'own thing ' || source", "'배포 회의 ' || lang", "source || lang")


@query("n7_doc_types", answers(doc_type=cases(7, "'meeting'", "'design'", "'ops'", "'guide'", "'mine'", "'meeting'", "NULL")))
def n7(spark: SparkSession, sf: str) -> DataFrame:
    rows = given(spark, sf, TITLES, "title")
    one = lambda i, word: F.when(F.col("id") % 7 == i, F.array(F.lit(word))).otherwise(F.array().cast("array<string>"))
    return rows.select("id", T.doc_type(F.col("title"), one(2, "Runbook"), one(3, "how-to"), T.parse_doc_type_rules("mine:own|Own2, broken, empty:")).alias("doc_type"))


SUBJECTS = cases(7, "'feat: ' || text", "'Fix(' || source || ')!: ' || lang", "'chore(x) : ' || lang", "text", "NULL", "'revert:' || lang", "'  docs(a): ' || source")


@query("n8_commit_types", answers(kind=cases(7, "'feat'", "'fix'", "NULL", "NULL", "NULL", "NULL", "'docs'")))
def n8(spark: SparkSession, sf: str) -> DataFrame:
    return given(spark, sf, SUBJECTS).select("id", T.commit_type(F.col("v")).alias("kind"))


KOREAN = cases(5, "'마트를 갔다, ' || source || ' 휴가는 으로서 학교에서는'", "'가이드로서의 나라 ' || text", "text", "NULL", "lang || ' 사람으로서 서울까지만 ' || source")
_KOREAN = f"(SELECT doc_id AS id, {KOREAN} AS v FROM documents)"


@query("n9_particles", f"""SELECT id, coalesce(string_agg(regexp_replace(w, '^(.{{2,}}?)({_PARTICLES})$', '\\1'), ' ' ORDER BY p), '') AS words FROM
(SELECT id, unnest(ws) AS w, unnest(range(len(ws))) AS p FROM (SELECT id, CASE WHEN len(ws) = 0 THEN [NULL] ELSE ws END AS ws FROM (SELECT id, list_filter(string_split_regex(regexp_replace(coalesce(v, ''), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+'), lambda x: x <> '') AS ws FROM {_KOREAN}))) GROUP BY id""")
def n9(spark: SparkSession, sf: str) -> DataFrame:
    return given(spark, sf, KOREAN).select("id", T.normalize_words(F.col("v")).alias("words"))


@query("n9_index_tokens", f"""SELECT id, list_transform(regexp_extract_all(lower(coalesce(v, '')), '[\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_replace(w, '^(.{{2,}}?)({_PARTICLES})$', '\\1')) AS tokens FROM {_KOREAN}""")
def n9_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return given(spark, sf, KOREAN).select("id", T.tokens(F.col("v")).alias("tokens"))


CODE = f"lang || {NL} || '```' || {NL} || repeat(source || {NL}, CAST(doc_id % 9 + 1 AS INT)) || '```' || {NL} || 'end'"


@query("n20_folded_code", answers(text=f"""lang || {NL} || '```' || {NL} || CASE WHEN doc_id % 9 + 1 > 3 THEN repeat(source || {NL}, 3) || '… (+' || (doc_id % 9 - 2) || ' lines)' || {NL} ELSE repeat(source || {NL}, (doc_id % 9 + 1)::INTEGER) END || '```' || {NL} || 'end'"""))
def n20(spark: SparkSession, sf: str) -> DataFrame:
    return given(spark, sf, CODE).select("id", markdown.fold_codeblocks(F.col("v")).alias("text"))


TABLES = f"lang || {NL} || '|h|' || source || '|' || {NL} || '|-|-|' || {NL} || repeat('|1|2|' || {NL}, CAST(doc_id % 4 AS INT)) || 'end'"


@query("n21_tables", answers(text=f"lang || {NL} || '|h|' || source || '|' || {NL} || '| … ' || (doc_id % 4) || '행 생략 …end'"))
def n21(spark: SparkSession, sf: str) -> DataFrame:
    return given(spark, sf, TABLES).select("id", markdown.summarize_tables(F.col("v")).alias("text"))


QUESTIONS = cases(3, "'**' || lang || '** is  `' || source || '` now'", "'***' || lang || '*** _b_ ~' || source || '~'", "source")


@query("n28_questions", answers(q=cases(3, "lang || ' is ' || source || ' now'", "lang || ' b ' || source", "source"), words=cases(3, "[lang, 'is', source, 'now']", "[lang, source]", "[source]")))
def n28(spark: SparkSession, sf: str) -> DataFrame:
    rows = given(spark, sf, QUESTIONS).select("id", T.clean_question(F.col("v")).alias("q"))
    return rows.select("id", "q", T.word_set(F.col("q"), 2).alias("words"))


BODIES = cases(4, f"'# ' || lang || {NL} || {NL} || source || ' para' || {NL} || lang || {NL} || {NL} || text", "'no heading ' || source", "NULL", f"'## ' || source || {NL} || repeat(lang, 200)")


@query("n29_leads", answers(lead=cases(4, f"source || ' para' || {NL} || lang", "'no heading ' || source", "''", "substr(repeat(lang, 200), 1, 220)")))
def n29(spark: SparkSession, sf: str) -> DataFrame:
    return given(spark, sf, BODIES).select("id", mining.body_lead(F.col("v")).alias("lead"))


KINDS = cases(6, f"'10:20:30' || {NL} || text", "'create table ' || lang || ' (a int)'", f"'```sql' || {NL} || lang || {NL} || '```'", "'| --- |' || repeat(' x', CAST(doc_id % 300 AS INT))", "source || ' 10:20:30'", "'select ' || source || ' from ' || lang")


@query("n30_extract_types", answers(kind=cases(6, "'meeting'", "'spec'", "'spec'", "CASE WHEN 7 + 2 * (doc_id % 300) > 300 THEN 'spec' ELSE 'unknown' END", "'unknown'", "'spec'")))
def n30(spark: SparkSession, sf: str) -> DataFrame:
    return given(spark, sf, KINDS).select("id", T.detect_extract_type(F.col("v")).alias("kind"))


REMOTES = cases(4, "'git@github.com:' || lang || '/' || source || '.git'", "'https://user@gitlab.example.com/' || lang || '/sub/' || source || '.git'", "'https://bitbucket.org/' || lang || '/' || source || '/'", "'ssh://other/' || source")
_BASE = cases(4, "'https://github.com/' || lang || '/' || source", "'https://gitlab.example.com/' || lang || '/sub/' || source", "'https://bitbucket.org/' || lang || '/' || source", "NULL")


@query("s8_remotes", answers(
    host=cases(4, "'github'", "'gitlab'", "'bitbucket'", "'github'"), base=_BASE,
    file_url=f"{_BASE} || {cases(4, repr('/blob/'), repr('/-/blob/'), repr('/src/'), repr('/blob/'))} || 'main/a/b.md'", commit_url=f"{_BASE} || {cases(4, repr('/commit/'), repr('/-/commit/'), repr('/commits/'), repr('/commit/'))} || 'abc'",
))
def s8(spark: SparkSession, sf: str) -> DataFrame:
    rows = given(spark, sf, REMOTES).withColumns({"host": bronze.detect_host(F.col("v")), "base": bronze.web_base(F.col("v"))})
    urls = {"file_url": bronze.file_url(F.col("base"), F.col("host"), F.lit("main"), F.lit("a/b.md")), "commit_url": bronze.commit_url(F.col("base"), F.col("host"), F.lit("abc"))}
    return rows.withColumns(urls).drop("v")


CLONES = cases(4, "'git clone --depth 1 git@host:' || lang || '/' || source || '.git dir'", "'''https://h/' || lang || '/' || source || '.git'''", "'https://h/' || lang || '/' || source", "'git clone ' || source")


@query("s14_pasted_urls", answers(url=cases(4, "'git@host:' || lang || '/' || source || '.git'", "'https://h/' || lang || '/' || source || '.git'", "'https://h/' || lang || '/' || source", "source"), name="source"))
def s14(spark: SparkSession, sf: str) -> DataFrame:
    urls = given(spark, sf, CLONES).select("id", bronze.normalize_remote(F.col("v")).alias("url"))
    return urls.select("id", "url", bronze.repo_name(F.col("url")).alias("name"))


DIFF = cases(5, "'A' || chr(9) || source || '/' || doc_id", "'M' || chr(9) || source || '/' || doc_id", "'D' || chr(9) || source || '/' || doc_id", "'R100' || chr(9) || 'old' || chr(9) || source || '/' || doc_id", "''")


@query("s13_diff_changes", f"SELECT {cases(5, repr('added'), repr('modified'), repr('deleted'), repr('modified'), repr(''))} AS op, source || '/' || doc_id AS path FROM documents WHERE doc_id % 5 <> 4")
def s13(spark: SparkSession, sf: str) -> DataFrame:
    return bronze.name_status(given(spark, sf, DIFF, "line"))


ISSUE = cases(2, """'{"key":"' || lang || '-' || doc_id || '","self":"https://x.test/rest/api/2/issue/1","fields":{"summary":"' || source || ' full","description":"plain","reporter":{"displayName":"' || source || '"},"created":"2024-01-02T03:04:05.000+0900","labels":["' || lang || '","prod"],"project":{"key":"' || lang || '"}}}'""",
              """'{"key":"' || lang || '-' || doc_id || '","self":"https://x.test/wiki/2","fields":{"summary":"Old","description":"b","creator":{"displayName":"Bob"},"created":"2024-02-02","labels":[]}}'""")  # fmt: skip


@query("s4_issues", f"""SELECT lang || '-' || doc_id AS source_id, lang AS space, {cases(2, "source || ' full'", "'Old'")} AS title, {cases(2, "'https://x.test/browse/' || lang || '-' || doc_id", "'https://x.test/wiki/2'")} AS url, {cases(2, "source", "'Bob'")} AS author, {cases(2, "[lang, 'prod']", "[]::VARCHAR[]")} AS tags FROM documents""")
def s4(spark: SparkSession, sf: str) -> DataFrame:
    return bronze.issue_rows(given(spark, sf, ISSUE, "json").select("json")).select("source_id", "space", "title", "url", "author", "tags")


NESTED = cases(3, """'{"type":"doc","content":[{"type":"paragraph","content":[{"type":"text","text":"' || lang || '"},{"type":"hardBreak"},{"type":"text","text":"' || source || '"}]},{"type":"text","text":"three"}]}'""", "'\"' || source || '\"'", "'no json ' || lang")


@query("s5_nested_text", answers(body=cases(3, "lang || ' ' || source || ' three'", "source", "'no json ' || lang")))
def s5(spark: SparkSession, sf: str) -> DataFrame:
    return given(spark, sf, NESTED, "json").select("id", markdown.adf_text(F.col("json")).alias("body"))


_SHA = "lpad(CAST(doc_id AS STRING), 16, 'abcdef')"
COMMITS = f"{_SHA} || chr(31) || source || chr(31) || '2024-01-' || {DAY} || 'T03:04:05+09:00' || chr(31) || 'feat(' || lang || '): add' || chr(31) || 'body' || chr(30) || {NL} || 'f' || {_SHA} || chr(31) || lang || chr(31) || '2024-01-03T00:00:00Z' || chr(31) || 'plain' || chr(31) || chr(30)"


@query("s7_commit_log", f"""SELECT 'r@' || {_SHA}[:12] AS source_id, source AS author, strftime(TIMESTAMP '2023-12-31 18:04:05' + (doc_id % 31)::INTEGER * INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S') AS "at", 'feat(' || lang || '): add' AS subject, 'body' AS body, 'feat' AS doc_type FROM documents
UNION ALL SELECT 'r@' || ('f' || {_SHA})[:12], lang, '2024-01-03 00:00:00', 'plain', '', 'commit' FROM documents""")
def s7(spark: SparkSession, sf: str) -> DataFrame:
    rows = bronze.parse_commit_log(given(spark, sf, COMMITS, "log").select("log"), "r")
    return rows.select("source_id", "author", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("at"), "subject", "body", "doc_type")


HOSTED = """'{"values":[{"full_name":"' || lang || '/' || doc_id || '","links":{"clone":[{"name":"ssh","href":"x"},{"name":"https","href":"https://b/' || source || '/' || doc_id || '.git"}]}},{"full_name":"t/b","links":{"clone":[{"name":"ssh","href":"x"}]}}]}'"""


@query("s15_hosted_repos", "SELECT 'https://b/' || source || '/' || doc_id || '.git' AS url, lang || '/' || doc_id AS name FROM documents")
def s15(spark: SparkSession, sf: str) -> DataFrame:
    return bronze.hosted_repos("bitbucket", given(spark, sf, HOSTED, "json").select("json"))


MANIFEST = """'{"source":"x","last_change":{"since":null,"added":["' || source || doc_id || '","' || lang || doc_id || '"],"modified":["m' || doc_id || '"],"deleted":[]}}'"""


@query("s16_manifest_changes", "SELECT source || doc_id AS source_id, 'added' AS op FROM documents UNION ALL SELECT lang || doc_id, 'added' FROM documents UNION ALL SELECT 'm' || doc_id, 'modified' FROM documents")
def s16(spark: SparkSession, sf: str) -> DataFrame:
    kind = "struct<last_change:struct<added:array<string>,modified:array<string>,deleted:array<string>>>"
    return bronze.changed_ids(given(spark, sf, MANIFEST, "j").select(F.from_json("j", kind).alias("m")).select("m.*"))


EXPANDED = cases(4, "'Ering ' || source", "'heon and ' || source", "source || ' ' || lang", "lang || ' auto THAND'")


@query("r13_query_expansion", "SELECT doc_id AS query_id, " + cases(4, "'Ering ' || source || ' ering hend auto reou shth ing'", "'heon and ' || source || ' heon thand with'", "source || ' ' || lang", "lang || ' auto THAND auto ering reou shth ing heon thand with'") + " AS expanded FROM documents")
def r13(spark: SparkSession, sf: str) -> DataFrame:
    from loamdex.plans.search_queries import ENTRIES

    entries = spark.createDataFrame([(i, e.term, list(e.synonyms)) for i, e in enumerate(ENTRIES)], "priority int, term string, synonyms array<string>")
    return fusion.expand_batch(given(spark, sf, EXPANDED, "query").withColumnRenamed("id", "query_id"), entries)


EXTRACTED = """'{"segments":[{"topic":"a","action_items":[{"task":"' || source || '"},{"task":"' || lang || '"}],"contains_decision":' || CASE WHEN doc_id % 2 = 0 THEN 'true' ELSE 'false' END || '},{"topic":"b","action_items":[],"contains_decision":false}],"sections":[{"title":"s"}]}'"""


@query("a19_extraction_counts", answers(segments="3::INTEGER", tasks="[source, lang]", decisions="doc_id % 2 = 0"))
def a19(spark: SparkSession, sf: str) -> DataFrame:
    kind = "struct<segments:array<struct<topic:string,action_items:array<struct<task:string>>,contains_decision:boolean>>,sections:array<struct<title:string>>>"
    r = given(spark, sf, EXTRACTED, "j").select("id", F.from_json("j", kind).alias("r")).select("id", "r.*")
    tasks = F.flatten(F.transform("segments", lambda s: F.transform(s["action_items"], lambda a: a["task"])))
    return r.select("id", (F.size("segments") + F.size("sections")).alias("segments"), tasks.alias("tasks"), F.exists("segments", lambda s: s["contains_decision"]).alias("decisions"))


GENERATED = cases(5, "lang || ' is the flow of ' || source", "'abc'", "'Overview of ' || source", "'unrelated question here'", "'? ? ? ?'")


@query("m12_question_verdicts", answers(verdict=cases(5, "'ok'", "'length'", "'title copy'", "'no anchor'", "'no tokens'")))
def m12(spark: SparkSession, sf: str) -> DataFrame:
    rows = given(spark, sf, GENERATED, "question").join(given(spark, sf, "'Overview of ' || source", "title"), "id").join(given(spark, sf, "'the flow ' || source || ' is described'", "body"), "id")
    return mining.validate_questions(rows).select("id", "verdict")


ASKED = "array('how does ' || source || ' work today', 'how does ' || source || ' work', 'who owns the ' || lang || ' ledger', CASE WHEN doc_id % 2 = 0 THEN 'who owns the ledger of ' || lang ELSE 'something else entirely' END)"


@query("e5_distinct_questions", 'SELECT doc_id, 0 AS "at" FROM documents UNION ALL SELECT doc_id, 2 FROM documents UNION ALL SELECT doc_id, 3 FROM documents WHERE doc_id % 2 = 1')
def e5(spark: SparkSession, sf: str) -> DataFrame:
    rows = given(spark, sf, ASKED).select(F.col("id").alias("doc_id"), F.posexplode("v").alias("at", "question"))
    return mining.distinct_questions(rows).select("doc_id", "at")


NAMED = cases(5, "'Cloud Run (클라우드런) and 결제 (Payment) ' || text", "'camelCase(확인) KPI ' || source || ' (소스)'", "'결제（Payment） a_b (필드)'", "text", "upper(lang) || ' (언어)'")


@query("a10_bracket_pairs", f"""WITH d AS (SELECT source || ' ' || substr({NAMED}, 1, 400) AS t FROM documents),
p AS (SELECT trim(unnest(regexp_extract_all(t, '{mining.PAREN_LATIN}', 1))) AS term, unnest(regexp_extract_all(t, '{mining.PAREN_LATIN}', 2)) AS synonym FROM d UNION ALL
SELECT trim(unnest(regexp_extract_all(t, '{mining.PAREN_HANGUL}', 2))), unnest(regexp_extract_all(t, '{mining.PAREN_HANGUL}', 1)) FROM d)
SELECT term, synonym, count(*) AS n FROM p GROUP BY ALL""")
def a10(spark: SparkSession, sf: str) -> DataFrame:
    rows = read_table(spark, sf, "documents").select("doc_id", F.col("source").alias("title"), F.expr(NAMED).alias("body"))
    return mining.bracket_pairs(rows)
