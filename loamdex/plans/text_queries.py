"""Queries of sources, text functions and mining. Some cases of typed rows are kept for the tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamdex import corpus
from loamdex.corpus import DOC_SQL
from loamdex.functions import chunking, markdown
from loamdex.functions import text as T
from loamdex.operators import ingest, mining
from loamdex.plans.registry import literal, query
from loamdex.session import read_table
from loamdex.sources import bronze


def _quoted(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, (int, float)):
        return str(value)
    if isinstance(value, (list, tuple)):
        return "[" + ", ".join(map(_quoted, value)) + "]"
    return "'" + value.replace("'", "''").replace("\n", "' || chr(10) || '").replace("\t", "' || chr(9) || '") + "'"


def values(names: str, rows: list[tuple]) -> str:
    """A VALUES table for the oracles."""
    return "(VALUES " + ", ".join("(" + ", ".join(map(_quoted, r)) + ")" for r in rows) + f") t({names})"


def _frame(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, schema)


ISSUES = [
    ('{"key":"OPS-1","self":"https://x.test/rest/api/2/issue/1","fields":{"summary":"Disk full","description":"plain text","reporter":{"displayName":"Ann"},"created":"2024-01-02T03:04:05.000+0900","labels":["disk","prod"],"project":{"key":"OPS"}}}',),
    ('{"key":"OPS-2","self":"https://x.test/wiki/2","fields":{"summary":"Old","description":"b","creator":{"displayName":"Bob"},"created":"2024-02-02","labels":[]}}',),
]


@literal("s4_issues", f"""SELECT j->>'$.key' AS source_id, coalesce(j->>'$.fields.project.key', split_part(j->>'$.key', '-', 1)) AS space, j->>'$.fields.summary' AS title,
CASE WHEN contains(j->>'$.self', '/rest/') THEN split_part(j->>'$.self', '/rest/', 1) || '/browse/' || (j->>'$.key') ELSE j->>'$.self' END AS url, coalesce(j->>'$.fields.reporter.displayName', j->>'$.fields.creator.displayName') AS author,
(j->'$.fields.labels')::VARCHAR[] AS tags FROM (SELECT j::JSON AS j FROM {values("j", ISSUES)})""")
def s4(spark: SparkSession, sf: str) -> DataFrame:
    return bronze.issue_rows(_frame(spark, "json string", ISSUES)).select("source_id", "space", "title", "url", "author", "tags")


@query("s3_html_titles", "SELECT page_id, coalesce(nullif(trim(regexp_extract(html, '<title[^>]*>([^<]*)</title>', 1)), ''), nullif(trim(regexp_extract(html, '<h1[^>]*>([^<]*)</h1>', 1)), ''), page_id::VARCHAR) AS title FROM pages")
def s3(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "pages").select("page_id", T.html_title(F.col("html"), F.col("page_id").cast("string")).alias("title"))


@query("s3_html_titles_h1", "SELECT page_id, coalesce(nullif(trim(regexp_extract(html, '<h1[^>]*>([^<]*)</h1>', 1)), ''), 'none') AS title FROM pages")
def s3_h1(spark: SparkSession, sf: str) -> DataFrame:
    bare = F.regexp_replace("html", "(?s)<title>.*?</title>", "<title> </title>")
    return read_table(spark, sf, "pages").select("page_id", T.html_title(bare, F.lit("none")).alias("title"))


ADF = [(1, '{"type":"doc","content":[{"type":"paragraph","content":[{"type":"text","text":"one"},{"type":"hardBreak"},{"type":"text","text":"two"}]},{"type":"text","text":"three"}]}'), (2, '"plain"'), (3, "no json")]


@literal("s5_nested_text", "SELECT * FROM (VALUES (1, 'one two three'), (2, 'plain'), (3, 'no json')) t(id, body)")
def s5(spark: SparkSession, sf: str) -> DataFrame:
    return _frame(spark, "id int, json string", ADF).select("id", markdown.adf_text(F.col("json")).alias("body"))


REMOTES = [("git@github.com:org/repo.git",), ("https://user@gitlab.example.com/group/sub/repo.git",), ("https://bitbucket.org/team/repo/",), ("ssh://other/x",)]


@literal("s8_remotes", f"""WITH r AS (SELECT remote, regexp_extract(remote, '(?:git@|https?://)(?:[^@/]*@)?([^/:]+)[/:](.+?)(?:\\.git)?/?$', 1) AS h, regexp_extract(remote, '(?:git@|https?://)(?:[^@/]*@)?([^/:]+)[/:](.+?)(?:\\.git)?/?$', 2) AS p,
CASE WHEN contains(remote, 'github.com') THEN 'github' WHEN contains(remote, 'gitlab') THEN 'gitlab' WHEN contains(remote, 'bitbucket') THEN 'bitbucket' ELSE 'github' END AS host FROM {values("remote", REMOTES)}),
b AS (SELECT *, CASE WHEN h <> '' THEN 'https://' || h || '/' || p END AS base FROM r)
SELECT remote, host, base, base || CASE host WHEN 'gitlab' THEN '/-/blob/' WHEN 'bitbucket' THEN '/src/' ELSE '/blob/' END || 'main/a/b.md' AS file_url, base || CASE host WHEN 'gitlab' THEN '/-/commit/' WHEN 'bitbucket' THEN '/commits/' ELSE '/commit/' END || 'abc' AS commit_url FROM b""")
def s8(spark: SparkSession, sf: str) -> DataFrame:
    r = F.col("remote")
    rows = _frame(spark, "remote string", REMOTES).withColumns({"host": bronze.detect_host(r), "base": bronze.web_base(r)})
    urls = {"file_url": bronze.file_url(F.col("base"), F.col("host"), F.lit("main"), F.lit("a/b.md")), "commit_url": bronze.commit_url(F.col("base"), F.col("host"), F.lit("abc"))}
    return rows.withColumns(urls)


@query("s9_first_heading", "SELECT doc_id, trim(ltrim('## ' || lang || ' x', '#')) AS heading FROM documents WHERE lang <> 'en' UNION ALL SELECT doc_id, NULL FROM documents WHERE lang = 'en'")
def s9(spark: SparkSession, sf: str) -> DataFrame:
    body = F.when(F.col("lang") != "en", F.concat(F.lit("\n  ## "), F.col("lang"), F.lit(" x\n# second"))).otherwise(F.lit("#\ntext"))
    return read_table(spark, sf, "documents").select("doc_id", T.first_heading(body).alias("heading"))


@query("s10_last_authors", "SELECT l_suppkey % 50 AS path, arg_max(l_shipmode, ord) AS author FROM (SELECT l_suppkey, l_returnflag || l_linestatus || l_orderkey || '-' || l_linenumber AS l_shipmode, l_orderkey * 10 + l_linenumber AS ord FROM lineitem) GROUP BY ALL")
def s10(spark: SparkSession, sf: str) -> DataFrame:
    rows = read_table(spark, sf, "lineitem").select((F.col("l_suppkey") % 50).alias("path"), F.concat("l_returnflag", "l_linestatus", F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("author"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at"))
    return bronze.last_authors(rows).select("path", "author")


LOG = "abcdef0123456789\x1fAnn\x1f2024-01-02T03:04:05+09:00\x1ffeat(api): add\x1fbody\x1e\nbcdef0123456789a\x1fBob\x1f2024-01-03T00:00:00Z\x1fplain\x1f\x1e"


@literal("s7_commit_log", "SELECT * FROM (VALUES ('r@abcdef012345', 'Ann', '2024-01-01 18:04:05', 'feat(api): add', 'body', 'feat'), ('r@bcdef0123456', 'Bob', '2024-01-03 00:00:00', 'plain', '', 'commit')) t(source_id, author, \"at\", subject, body, doc_type)")
def s7(spark: SparkSession, sf: str) -> DataFrame:
    rows = bronze.parse_commit_log(_frame(spark, "log string", [(LOG,)]), "r")
    return rows.select("source_id", "author", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("at"), "subject", "body", "doc_type")


DIFF = [("A\ta.md",), ("M\tb.md",), ("D\tc.md",), ("R100\told.md\tnew.md",), ("",)]


@literal("s13_diff_changes", "SELECT * FROM (VALUES ('added', 'a.md'), ('modified', 'b.md'), ('deleted', 'c.md'), ('modified', 'new.md')) t(op, path)")
def s13(spark: SparkSession, sf: str) -> DataFrame:
    return bronze.name_status(_frame(spark, "line string", DIFF))


CLONES = [("git clone --depth 1 git@host:org/repo.git dir",), ("'https://h/x/y.git'",), ("https://h/x/y",), ("git clone repo",)]


@literal("s14_pasted_urls", "SELECT * FROM (VALUES ('git@host:org/repo.git', 'repo'), ('https://h/x/y.git', 'y'), ('https://h/x/y', 'y'), ('repo', 'repo')) t(url, name)")
def s14(spark: SparkSession, sf: str) -> DataFrame:
    urls = _frame(spark, "v string", CLONES).select(bronze.normalize_remote(F.col("v")).alias("url"))
    return urls.select("url", bronze.repo_name(F.col("url")).alias("name"))


HOSTED = '{"values":[{"full_name":"t/a","links":{"clone":[{"name":"ssh","href":"git@b:t/a"},{"name":"https","href":"https://b/t/a.git"}]}},{"full_name":"t/b","links":{"clone":[{"name":"ssh","href":"x"}]}}]}'


@literal("s15_hosted_repos", f"""SELECT list_filter(clones, lambda c: c.name = 'https')[1].href AS url, name FROM (SELECT v->>'$.full_name' AS name, from_json(v->'$.links.clone', '[{{"name":"VARCHAR","href":"VARCHAR"}}]') AS clones FROM (SELECT unnest(from_json('{HOSTED}'::JSON->'$.values', '["JSON"]')) AS v)) WHERE len(list_filter(clones, lambda c: c.name = 'https')) > 0""")
def s15(spark: SparkSession, sf: str) -> DataFrame:
    return bronze.hosted_repos("bitbucket", _frame(spark, "json string", [(HOSTED,)]))


CHANGE = '{"source":"confluence","as_of":"2024-05-01","last_change":{"since":null,"added":["a","b"],"modified":["c"],"deleted":["d"]}}'


@literal("s16_manifest_changes", "SELECT * FROM (VALUES ('a', 'added'), ('b', 'added'), ('c', 'modified'), ('d', 'deleted')) t(source_id, op)")
def s16(spark: SparkSession, sf: str) -> DataFrame:
    kind = "struct<last_change:struct<added:array<string>,modified:array<string>,deleted:array<string>>>"
    return bronze.changed_ids(_frame(spark, "j string", [(CHANGE,)]).select(F.from_json("j", kind).alias("m")).select("m.*"))


@query("s11_still_to_fetch", "SELECT o_orderkey AS id, o_custkey AS version FROM orders WHERE o_orderkey % 7 = 0 AND NOT (o_orderkey % 2 = 0)")
def s11(spark: SparkSession, sf: str) -> DataFrame:
    remote = read_table(spark, sf, "orders").filter("o_orderkey % 7 = 0").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("version"))
    return bronze.newer(remote, remote.filter("id % 2 = 0"), ["id", "version"])


MANUAL = "- term: a\n  synonyms: [x]\n  boost: 2\n- term: b\n"
AUTO = "- term: a\n  synonyms: [z]\n- term: c\n  synonyms: [y]\n"


@query("s18_dictionaries", "SELECT * FROM (VALUES ('a', ['x'], 2.0::DOUBLE), ('b', []::VARCHAR[], 1.0), ('c', ['y'], 1.0)) t(term, synonyms, boost)")
def s18(spark: SparkSession, sf: str) -> DataFrame:
    files = {"manual": MANUAL, "auto": AUTO}
    return bronze.dictionary(spark, ["manual", "auto"], files.get).select("term", "synonyms", "boost")


@query("s19_ids_by_source", f"WITH {DOC_SQL} SELECT doc_id FROM doc WHERE source = 'src2'")
def s19(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.documents(spark, sf).filter("source = 'src2'").select("doc_id")


DATES = [(1, "2023-12-11T10:17:37.790+0900"), (2, "2023-12-11"), (3, "2023-12-11T10:17:37Z"), (4, "2023-12-11T10:17:37z"), (5, "2023-12-11T10:17:37"), (6, "garbage"), (7, ""), (8, "2023-13-45T99:99:99"), (9, "2023"), (10, None)]


@literal("n3_dates", "SELECT * FROM (VALUES (1, '2023-12-11 01:17:37.790'), (2, '2023-12-11 00:00:00.000'), (3, '2023-12-11 10:17:37.000'), (4, '2023-12-11 10:17:37.000'), (5, '2023-12-11 10:17:37.000'), (6, NULL), (7, NULL), (8, NULL), (9, NULL), (10, NULL)) t(id, \"at\")")
def n3(spark: SparkSession, sf: str) -> DataFrame:
    return _frame(spark, "id int, v string", DATES).select("id", F.date_format(T.parse_iso8601(F.col("v")), "yyyy-MM-dd HH:mm:ss.SSS").alias("at"))


AUTHORS = [(1, " Kim (Unlicensed) "), (2, "Lee (Dev)  (deactivated)"), (3, "Former user (Deleted)"), (4, "ANONYMOUS"), (5, None), (6, "Park   Ji")]


@literal("n4_authors", "SELECT * FROM (VALUES (1, 'Kim'), (2, 'Lee (Dev)'), (3, '(익명)'), (4, '(익명)'), (5, ''), (6, 'Park Ji')) t(id, author)")
def n4(spark: SparkSession, sf: str) -> DataFrame:
    return _frame(spark, "id int, v string", AUTHORS).select("id", T.normalize_author(F.col("v")).alias("author"))


CATEGORIES = [(1, '"Other"'), (2, "##  2024년  10월"), (3, " 'x' "), (4, None), (5, "a #b")]


@literal("n5_categories", "SELECT * FROM (VALUES (1, 'Other', true), (2, '2024년 10월', true), (3, 'x', false), (4, '', NULL), (5, 'a #b', false)) t(id, category, dirty)")
def n5(spark: SparkSession, sf: str) -> DataFrame:
    from loamdex.operators.filters import dirty_category

    return _frame(spark, "id int, v string", CATEGORIES).select("id", T.normalize_category(F.col("v")).alias("category"), dirty_category(F.col("v")).alias("dirty"))


LABELS = [(1, "● ▶ title  x"), (2, "***"), (3, "[a] b"), (4, None)]


@literal("n6_labels", "SELECT * FROM (VALUES (1, 'title x'), (2, '***'), (3, '[a] b'), (4, '')) t(id, label)")
def n6(spark: SparkSession, sf: str) -> DataFrame:
    return _frame(spark, "id int, v string", LABELS).select("id", T.normalize_label(F.col("v")).alias("label"))


TITLES = [(1, "2024 회의록", ["a"], []), (2, "API Design", [], []), (3, "x", ["Runbook"], []), (4, "plain", [], ["how-to"]), (5, "nothing", [], []), (6, "배포 회의", None, None), (7, "own thing", [], [])]


@literal("n7_doc_types", "SELECT * FROM (VALUES (1, 'meeting'), (2, 'design'), (3, 'ops'), (4, 'guide'), (5, NULL), (6, 'meeting'), (7, 'mine')) t(id, doc_type)")
def n7(spark: SparkSession, sf: str) -> DataFrame:
    rules = T.parse_doc_type_rules("mine:own|Own2, broken, empty:")
    return _frame(spark, "id int, title string, h array<string>, tags array<string>", TITLES).select("id", T.doc_type(F.col("title"), F.col("h"), F.col("tags"), rules).alias("doc_type"))


SUBJECTS = [(1, "feat: x"), (2, "Fix(core)!: y"), (3, "chore(x) : no"), (4, "update"), (5, None), (6, "revert: a")]


@literal("n8_commit_types", f"SELECT id, nullif(lower(regexp_extract(trim(v), '(?i)^({'|'.join(T.COMMIT_TYPES)})(\\([^)]*\\))?!?:\\s', 1)), '') AS kind FROM {values('id, v', SUBJECTS)}")
def n8(spark: SparkSession, sf: str) -> DataFrame:
    return _frame(spark, "id int, v string", SUBJECTS).select("id", T.commit_type(F.col("v")).alias("kind"))


KOREAN = [(1, "마트를 갔다, 휴가는 으로서 학교에서는"), (2, "가이드로서의 나라 나라에 도로"), (3, "hello, world!"), (4, ""), (5, None), (6, "사람으로서 서울까지만")]
_PARTICLES = "|".join(sorted(T.PARTICLES, key=len, reverse=True))


@literal("n9_particles", f"""SELECT id, coalesce(string_agg(regexp_replace(w, '^(.{{2,}}?)({_PARTICLES})$', '\\1'), ' ' ORDER BY p), '') AS words FROM
(SELECT id, unnest(ws) AS w, unnest(range(len(ws))) AS p FROM (SELECT id, CASE WHEN len(ws) = 0 THEN [NULL] ELSE ws END AS ws FROM (SELECT id, list_filter(string_split_regex(regexp_replace(coalesce(v, ''), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+'), lambda x: x <> '') AS ws FROM {values("id, v", KOREAN)}))) GROUP BY id""")
def n9(spark: SparkSession, sf: str) -> DataFrame:
    return _frame(spark, "id int, v string", KOREAN).select("id", T.normalize_words(F.col("v")).alias("words"))


@literal("n9_index_tokens", f"""SELECT id, list_transform(regexp_extract_all(lower(coalesce(v, '')), '[\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_replace(w, '^(.{{2,}}?)({_PARTICLES})$', '\\1')) AS tokens FROM {values("id, v", KOREAN)}""")
def n9_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return _frame(spark, "id int, v string", KOREAN).select("id", T.tokens(F.col("v")).alias("tokens"))


@query("n11_chunks", None)
def n11(spark: SparkSession, sf: str) -> DataFrame:
    docs = corpus.documents(spark, sf).withColumn("body", F.regexp_replace("body", "\n", "\n\n"))
    return chunking.chunks(docs)


@query("n12_summaries", "SELECT doc_id, trim(string_split(replace(text, chr(10), chr(10) || chr(10)), chr(10) || chr(10))[1]) AS summary FROM documents WHERE length(trim(string_split(text, chr(10))[1])) BETWEEN 1 AND 280")
def n12(spark: SparkSession, sf: str) -> DataFrame:
    docs = corpus.documents(spark, sf).withColumn("body", F.regexp_replace("body", "\n", "\n\n"))
    short = docs.filter(F.length(F.trim(F.substring_index("body", "\n", 1))).between(1, 280))
    return short.select("doc_id", chunking.summary(F.col("body")).alias("summary"))


@query("n13_sections", """WITH l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM (SELECT doc_id, string_split('intro' || chr(10) || '# ' || lang || chr(10) || text || chr(10) || '#### deep' || chr(10) || '## end', chr(10)) AS ls FROM documents)),
p AS (SELECT *, regexp_matches(line, '^#{1,3}\\s+') AS h, sum(regexp_matches(line, '^#{1,3}\\s+')::INTEGER) OVER (PARTITION BY doc_id ORDER BY pos) AS part FROM l)
SELECT doc_id, part::INTEGER AS section, max(CASE WHEN h THEN trim(regexp_extract(line, '^#{1,3}\\s+(.*)$', 1)) END) AS title, coalesce(regexp_replace(string_agg(CASE WHEN NOT h THEN line END, chr(10) ORDER BY pos), '^\\s+|\\s+$', '', 'g'), '') AS text FROM p GROUP BY doc_id, part""")
def n13(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_table(spark, sf, "documents").select("doc_id", F.concat(F.lit("intro\n# "), "lang", F.lit("\n"), "text", F.lit("\n#### deep\n## end")).alias("body"))
    return chunking.sections(docs)


@query("n14_passages", """SELECT doc_id, trim(p, ' ' || chr(9) || chr(10) || chr(13)) AS passage FROM (SELECT doc_id, unnest(string_split_regex(regexp_replace(text, '([.!?。…])\\s+', '\\1' || chr(1), 'g'), chr(1) || '|\\n+')) AS p FROM documents) WHERE trim(p, ' ' || chr(9) || chr(10) || chr(13)) <> ''""")
def n14(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.documents(spark, sf).select("doc_id", F.explode(T.passages(F.col("body"))).alias("passage"))


@query("n18_token_estimates", "SELECT doc_id, floor(length(t) * 0 + (length(t) - length(regexp_replace(t, '[가-힣]', '', 'g'))) / 1.6 + length(regexp_replace(t, '[가-힣]', '', 'g')) / 4)::BIGINT + 1 AS tokens FROM (SELECT doc_id, text || '한국어' AS t FROM documents)")
def n18(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "documents").select("doc_id", T.estimate_tokens(F.concat("text", F.lit("한국어"))).alias("tokens"))


@query("n19_white_space", "SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(replace(text, chr(10), '  ' || chr(10) || chr(10) || chr(10)), '[ \\t]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') AS text FROM documents")
def n19(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "documents").select("doc_id", T.strip_whitespace(F.regexp_replace("text", "\n", "  \n\n\n")).alias("text"))


@query("n22_outlines", "SELECT doc_id, CASE WHEN lang = 'en' THEN text ELSE '# ' || lang || chr(10) || '## b' END AS outline FROM documents")
def n22(spark: SparkSession, sf: str) -> DataFrame:
    d = read_table(spark, sf, "documents")
    body = F.when(F.col("lang") == "en", F.col("text")).otherwise(F.concat(F.lit("# "), "lang", F.lit("\n"), "text", F.lit("\n## b\n#no")))
    return d.select("doc_id", T.heading_outline(body).alias("outline"))


@query("n23_short_urls", "SELECT page_id, 'see ' || CASE WHEN length(u) <= 60 THEN u ELSE substr(u, 1, 40) || '…' || right(u, 15) END || ' end' AS text FROM (SELECT page_id, split_part(url || repeat('/x', (page_id % 40)::INTEGER) || '?q=1', '?', 1) AS u FROM pages)")
def n23(spark: SparkSession, sf: str) -> DataFrame:
    p = read_table(spark, sf, "pages")
    url = F.concat("url", F.expr("repeat('/x', CAST(page_id % 40 AS INT))"), F.lit("?q=1"))
    return p.select("page_id", T.shorten_urls(F.concat(F.lit("see "), url, F.lit(" end"))).alias("text"))


@query("n24_truncated", """WITH b AS (SELECT doc_id, ls, list_transform(range(1, len(ls) + 1), lambda i: length(list_aggregate(ls[1:i], 'string_agg', chr(10) || chr(10)))) AS lens FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
k AS (SELECT doc_id, ls, lens[len(lens)] AS total, list_max(list_transform(range(1, len(ls) + 1), lambda i: CASE WHEN floor(lens[i] / 4) + 1 <= 200 THEN i ELSE 0 END)) AS n FROM b)
SELECT doc_id, CASE WHEN floor(total / 4) + 1 <= 200 THEN list_aggregate(ls, 'string_agg', chr(10) || chr(10)) ELSE regexp_replace(CASE WHEN n = 0 THEN '' ELSE list_aggregate(ls[1:n], 'string_agg', chr(10) || chr(10)) END, '\\s+$', '') || chr(10) || '… (truncated)' END AS text FROM k""")
def n24(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "documents").select("doc_id", T.truncate_at_section(F.regexp_replace("text", "\n", "\n\n"), 200).alias("text"))


BODIES = [(1, "a\n```\n1\n2\n3\n4\n5\n```\nb"), (2, "```\n1\n```"), (3, "|h|x|\n|-|-|\n|1|2|\n|3|4|\nend"), (4, "none")]


@literal("n20_folded_code", "SELECT * FROM (VALUES (1, 'a' || chr(10) || '```' || chr(10) || '1' || chr(10) || '2' || chr(10) || '3' || chr(10) || '… (+2 lines)' || chr(10) || '```' || chr(10) || 'b'), (2, '```' || chr(10) || '1' || chr(10) || '```'), (4, 'none')) t(id, text)")
def n20(spark: SparkSession, sf: str) -> DataFrame:
    return _frame(spark, "id int, v string", BODIES).filter("id <> 3").select("id", markdown.fold_codeblocks(F.col("v")).alias("text"))


@literal("n21_tables", "SELECT 3 AS id, '|h|x|' || chr(10) || '| … 2행 생략 …end' AS text")
def n21(spark: SparkSession, sf: str) -> DataFrame:
    return _frame(spark, "id int, v string", BODIES).filter("id = 3").select("id", markdown.summarize_tables(F.col("v")).alias("text"))


@query("n25_compressed", None)
def n25(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.documents(spark, sf).select("doc_id", markdown.compress(F.col("body"), 300).alias("text"))


@query("n2_markdown", None)
def n2(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "pages").select("page_id", markdown.html_to_markdown(F.col("html")).alias("text"))


@query("n26_sigmoid", "SELECT vec_id, round(CASE WHEN x > 100 THEN 0 WHEN x < -100 THEN 1 ELSE 1 / (1 + exp(x)) END, 9) AS y FROM (SELECT vec_id, (vec_id - 250) * 0.7 AS x FROM embeddings)")
def n26(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "embeddings").select("vec_id", F.round(T.sigmoid((F.col("vec_id") - 250) * 0.7), 9).alias("y"))


@query("n27_recency", "SELECT event_id, round(pow(0.5, greatest(0, epoch(TIMESTAMP '2024-01-15') - epoch(ts)) / 86400 / 30), 6) AS decay FROM events")
def n27(spark: SparkSession, sf: str) -> DataFrame:
    decay = T.recency_decay(F.col("ts"), F.to_timestamp(F.lit("2024-01-15")))
    return read_table(spark, sf, "events").select("event_id", F.round(decay, 6).alias("decay"))


QUESTIONS = [(1, "**what** is `x`  now"), (2, "***a*** _b_ ~c~"), (3, "plain")]


@literal("n28_questions", "SELECT * FROM (VALUES (1, 'what is x now', ['what', 'is', 'now']), (2, 'a b c', []::VARCHAR[]), (3, 'plain', ['plain'])) t(id, q, words)")
def n28(spark: SparkSession, sf: str) -> DataFrame:
    rows = _frame(spark, "id int, v string", QUESTIONS).select("id", T.clean_question(F.col("v")).alias("q"))
    return rows.select("id", "q", T.word_set(F.col("q"), 2).alias("words"))


TERM_BODIES = [(1, "# Head\n\nfirst para\nmore\n\nsecond"), (2, "no heading"), (3, None)]


@literal("n29_leads", "SELECT * FROM (VALUES (1, 'first para' || chr(10) || 'more'), (2, 'no heading'), (3, '')) t(id, lead)")
def n29(spark: SparkSession, sf: str) -> DataFrame:
    return _frame(spark, "id int, v string", TERM_BODIES).select("id", mining.body_lead(F.col("v")).alias("lead"))


KINDS = [(1, "10:20:30\nhello"), (2, "create table x (a int)"), (3, "```sql\nx\n```"), (4, "| --- |" + " x" * 200), (5, "| --- |"), (6, "text 10:20:30")]


@literal("n30_extract_types", "SELECT * FROM (VALUES (1, 'meeting'), (2, 'spec'), (3, 'spec'), (4, 'spec'), (5, 'unknown'), (6, 'unknown')) t(id, kind)")
def n30(spark: SparkSession, sf: str) -> DataFrame:
    return _frame(spark, "id int, v string", KINDS).select("id", T.detect_extract_type(F.col("v")).alias("kind"))


@query("n1_normalised", """SELECT sha1('confluence:' || page_id) AS doc_id, page_id::VARCHAR AS source_id, coalesce(nullif(trim(regexp_extract(html, '<title[^>]*>([^<]*)</title>', 1)), ''), 'x') AS title,
sha256(coalesce(nullif(trim(regexp_extract(html, '<title[^>]*>([^<]*)</title>', 1)), ''), 'x') || html || '["a", "b"]' || '["s", "' || page_id || '"]') AS content_hash, ['s', page_id::VARCHAR] AS category, '(익명)' AS author FROM pages""")
def n1(spark: SparkSession, sf: str) -> DataFrame:
    p = read_table(spark, sf, "pages")
    null = lambda kind: F.lit(None).cast(kind)
    raw = p.select(
        F.lit("confluence").alias("source"), F.col("page_id").cast("string").alias("source_id"), F.col("html").alias("raw_body"), T.html_title(F.col("html"), F.lit("x")).alias("title"), "url", F.lit("s").alias("space"),
        F.lit("Former user (Deleted)").alias("author"), F.lit("2024-01-01").alias("created_at"), F.lit("2024-01-02T00:00:00Z").alias("updated_at"), F.array(F.lit("b"), F.lit("a"), F.lit("b")).alias("tags"),
        F.array(F.lit("s"), F.col("page_id").cast("string")).alias("hierarchy"), null("array<string>").alias("category"), null("string").alias("doc_type"),
    )
    return ingest.normalize(raw).select("doc_id", "source_id", "title", "content_hash", "category", "author")


@query("j_json_lists", "SELECT event_id, (props->>'$.k')::BIGINT AS k, '{\"k\":' || (props->>'$.k') || '}' AS again FROM events")
def json_lists(spark: SparkSession, sf: str) -> DataFrame:
    e = read_table(spark, sf, "events").select("event_id", F.from_json("props", "struct<k:long>").alias("p"))
    return e.select("event_id", F.col("p.k").alias("k"), F.to_json("p").alias("again"))


MINED = [
    (1, "제목", "Cloud Run (클라우드런) and 결제 (Payment) API KPI KPI"), (2, "제목", "Cloud Run (클라우드런) camelCase(확인) KPI"), (3, "x", "결제（Payment） a_b (필드) KPI SLA"),
    (4, "결제", "결제는 돈을 내는 일이다. 모두 안다.\n\nx"), (5, "2024 회의록", "회의는 모두가 모여서 하는 일이다"), (6, "ddl", "CREATE TABLE orders (\n  order_no varchar(10) COMMENT '주문 번호',\n  name varchar(10) COMMENT '이름',\n  pay_cd int COMMENT '결제 코드'\n)"),
    (7, "ddl2", "CREATE TABLE orders (\n  order_no varchar(20) COMMENT '주문을 찾는 번호 값',\n  pay_cd int COMMENT '결제 수단 코드'\n)\nSLA: service level agreement text"),
]


def _mined(spark: SparkSession) -> DataFrame:
    return _frame(spark, "doc_id int, title string, body string", MINED)


@literal("a10_bracket_pairs", f"""WITH d AS (SELECT title || ' ' || substr(body, 1, 400) AS t FROM {values("doc_id, title, body", MINED)}),
p AS (SELECT trim(unnest(regexp_extract_all(t, '{mining.PAREN_LATIN}', 1))) AS term, unnest(regexp_extract_all(t, '{mining.PAREN_LATIN}', 2)) AS synonym FROM d UNION ALL
SELECT trim(unnest(regexp_extract_all(t, '{mining.PAREN_HANGUL}', 2))), unnest(regexp_extract_all(t, '{mining.PAREN_HANGUL}', 1)) FROM d)
SELECT term, synonym, count(*) AS n FROM p GROUP BY ALL""")
def a10(spark: SparkSession, sf: str) -> DataFrame:
    return mining.bracket_pairs(_mined(spark))


@query("m6_synonym_entries", "SELECT * FROM (VALUES ('Cloud Run', '클라우드런', 'auto-paren', 2::BIGINT), ('Payment', '결제', 'auto-paren', 2), ('KPI', NULL, 'auto-abbr', 4), ('SLA', NULL, 'auto-abbr', 2), ('TABLE', NULL, 'auto-abbr', 2)) t(term, synonym, domain, n)")
def m6(spark: SparkSession, sf: str) -> DataFrame:
    return mining.synonym_entries(mining.bracket_pairs(_mined(spark)), mining.abbreviations(_mined(spark)))


@query("m6_merged_dictionary", "SELECT * FROM (VALUES ('Payment', ['pay', '결제'], 1::INTEGER), ('Cloud Run', ['클라우드런'], 1), ('other', ['o'], 0)) t(term, synonyms, added)")
def m6_merged(spark: SparkSession, sf: str) -> DataFrame:
    existing = _frame(spark, "term string, synonyms array<string>", [("Payment", ["pay"]), ("other", ["o"])])
    return mining.merge_entries(existing, mining.synonym_entries(mining.bracket_pairs(_mined(spark)), mining.abbreviations(_mined(spark))))


@query("m7_term_candidates", """SELECT * FROM (VALUES ('order_no', '주문 번호', 'sql_comment', 6), ('pay_cd', '결제 코드', 'sql_comment', 6), ('order_no', '주문을 찾는 번호 값', 'sql_comment', 7), ('pay_cd', '결제 수단 코드', 'sql_comment', 7),
('결제', '결제는 돈을 내는 일이다. 모두 안다.', 'title_exact', 4), ('결제', '돈을 내는 일이다. 모두 안다.', 'definition_sentence', 4), ('회의', '모두가 모여서 하는 일이다', 'definition_sentence', 5), ('SLA', 'service level agreement text', 'definition_sentence', 7)) t(term, definition, source_type, doc_id)""")
def m7(spark: SparkSession, sf: str) -> DataFrame:
    return mining.term_candidates(_mined(spark)).select("term", "definition", "source_type", "doc_id")


@query("m8_conflicts", """WITH w AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[가-힣A-Za-z0-9]+')) AS s FROM benchmark)
SELECT a.item_id AS a, b.item_id AS b, CASE WHEN least(len(a.s), len(b.s)) = 0 THEN false ELSE len(list_intersect(a.s, b.s)) / least(len(a.s), len(b.s)) < 0.7 AND len(list_intersect(a.s, b.s)) / len(list_distinct(a.s || b.s)) < 0.1 END AS conflict FROM w a JOIN w b ON b.item_id = a.item_id + 1 OR b.item_id = a.item_id + 7""")
def m8(spark: SparkSession, sf: str) -> DataFrame:
    b = read_table(spark, sf, "benchmark")
    next_ = b.select(F.col("item_id").alias("b"), F.col("text").alias("other"))
    pairs = b.select(F.col("item_id").alias("a"), "text", F.explode(F.array(F.col("item_id") + 1, F.col("item_id") + 7)).alias("b")).join(next_, "b")
    return pairs.select("a", "b", mining.conflict(F.col("text"), F.col("other")).alias("conflict"))


@query("m9_term_entries", "SELECT * FROM (VALUES ('order_no', '주문 번호', 2::BIGINT, []::VARCHAR[]), ('pay_cd', '결제 코드', 2, []), ('결제', '결제는 돈을 내는 일이다. 모두 안다.', 2, []), ('회의', '모두가 모여서 하는 일이다', 1, []), ('SLA', 'service level agreement text', 1, [])) t(term, definition, n, conflicts)")
def m9(spark: SparkSession, sf: str) -> DataFrame:
    return mining.term_entries(mining.term_candidates(_mined(spark))).select("term", "definition", "n", "conflicts")


@query("j16_definition_pairs", "SELECT * FROM (VALUES ('주문 번호', '주문을 찾는 번호 값', false), ('결제 수단 코드', '결제 코드', false), ('주문 번호', '결제 수단 코드', true)) t(a, b, conflict) WHERE NOT conflict OR true")
def j16(spark: SparkSession, sf: str) -> DataFrame:
    comments = mining.ddl_comments(_mined(spark)).filter("col <> 'name'")
    same = comments.alias("x").join(comments.alias("y"), F.expr("x.tab = y.tab AND x.col = y.col AND x.comment < y.comment")).select(F.col("x.comment").alias("a"), F.col("y.comment").alias("b"), F.lit(False).alias("conflict"))
    return same.unionByName(mining.definition_pairs(comments).filter("conflict"))


@query("m10_conflict_calibration", """WITH w AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[가-힣A-Za-z0-9]+')) AS s FROM benchmark),
p AS (SELECT len(list_intersect(a.s, b.s)) / least(len(a.s), len(b.s)) AS c, len(list_intersect(a.s, b.s)) / len(list_distinct(a.s || b.s)) AS j, a.item_id % 3 = 0 AS truth FROM w a JOIN w b ON b.item_id = a.item_id + 1),
g AS (SELECT contained, least_, truth, c < contained AND j < least_ AS said FROM p, (SELECT unnest([0.5, 0.6, 0.7, 0.8, 0.9, 1.0]::DOUBLE[]) AS contained), (SELECT unnest([0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5]::DOUBLE[]) AS least_)),
k AS (SELECT contained, least_ AS least, count(*) FILTER (truth AND said) AS tp, count(*) FILTER (NOT truth AND said) AS fp, count(*) FILTER (NOT truth AND NOT said) AS tn, count(*) FILTER (truth AND NOT said) AS fn FROM g GROUP BY ALL)
SELECT contained, least, tp, fp, tn, fn, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy FROM k""")
def m10(spark: SparkSession, sf: str) -> DataFrame:
    b = read_table(spark, sf, "benchmark")
    pairs = b.join(b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("other")), "item_id")
    rows = mining.calibrate_conflict(pairs.select(F.col("text").alias("a"), F.col("other").alias("b"), (F.col("item_id") % 3 == 0).alias("conflict")))
    return rows.select("contained", "least", "tp", "fp", "tn", "fn", F.round("f1", 6).alias("f1"), F.round("accuracy", 6).alias("accuracy"))


@query("a9_document_frequency", "SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(regexp_extract_all(lower(text), '[가-힣A-Za-z0-9]{2,}'))) AS term FROM documents) GROUP BY term")
def a9(spark: SparkSession, sf: str) -> DataFrame:
    return mining.document_frequency(corpus.documents(spark, sf))


_STOP = ", ".join(f"'{w}'" for w in mining.QUERY_STOP_WORDS)


@query("m11_rare_term_queries", f"""WITH {DOC_SQL}, t AS (SELECT doc_id, unnest(regexp_extract_all(body, '[A-Za-z][A-Za-z0-9_]+')) AS term FROM doc),
g AS (SELECT doc_id, term, count(*) AS tf FROM t WHERE lower(term) NOT IN ({_STOP}) AND NOT (length(term) >= 8 AND regexp_matches(term, '[0-9]')) GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM g GROUP BY term HAVING count(*) >= 2 AND count(*) <= (SELECT greatest(floor(count(*) * 0.05), 3) FROM doc)),
ti AS (SELECT DISTINCT doc_id, lower(unnest(regexp_extract_all(title, '[A-Za-z][A-Za-z0-9_]+'))) AS low FROM doc),
r AS (SELECT doc_id, term, row_number() OVER (PARTITION BY doc_id ORDER BY df, tf DESC, term) AS n FROM g JOIN f USING (term) WHERE NOT EXISTS (SELECT 1 FROM ti WHERE ti.doc_id = g.doc_id AND low = lower(term)))
SELECT doc_id, any_value(title) AS title, string_agg(term, ' ' ORDER BY n) AS query FROM r JOIN doc USING (doc_id) WHERE n <= 3 GROUP BY doc_id HAVING count(*) = 3""")
def m11(spark: SparkSession, sf: str) -> DataFrame:
    return mining.rare_term_queries(corpus.documents(spark, sf))


GENERATED = [(1, "What is the payment flow?", "Overview", "the payment flow is described"), (2, "abc", "t", "b"), (3, "Overview of payments", "Overview of payments", "x payments"), (4, "unrelated question here", "t", "body"), (5, "? ? ? ?", "t", "b")]


@literal("m12_question_verdicts", "SELECT * FROM (VALUES (1, 'ok'), (2, 'length'), (3, 'title copy'), (4, 'no anchor'), (5, 'no tokens')) t(id, verdict)")
def m12(spark: SparkSession, sf: str) -> DataFrame:
    return mining.validate_questions(_frame(spark, "id int, question string, title string, body string", GENERATED)).select("id", "verdict")


@literal("e5_distinct_questions", "SELECT * FROM (VALUES (1, 0), (1, 2), (2, 0)) t(doc_id, \"at\")")
def e5(spark: SparkSession, sf: str) -> DataFrame:
    rows = [(1, 0, "how does payment work today"), (1, 1, "how does payment work"), (1, 2, "who owns the ledger"), (2, 0, "how does payment work")]
    return mining.distinct_questions(_frame(spark, "doc_id int, at int, question string", rows)).select("doc_id", "at")
