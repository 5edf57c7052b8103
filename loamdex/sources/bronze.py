"""Readers of raw files: page folders, issue JSON, repositories' files and commit logs, manifests and rule files."""

from __future__ import annotations

import base64
import json
import subprocess
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from loamdex.functions import text as T

# Extensions of documents and of code, and folders that are skipped.
DOC_EXTENSIONS = (".md", ".markdown", ".rst", ".txt", ".adoc")
CODE_EXTENSIONS = (
    ".py", ".sql", ".yaml", ".yml", ".json", ".sh", ".tpl", ".toml", ".ini", ".cfg", ".js", ".ts", ".tsx", ".jsx", ".java", ".kt", ".go", ".rb", ".php", ".rs", ".scala",
    ".c", ".cpp", ".cc", ".h", ".hpp", ".cs", ".swift", ".r", ".pl", ".lua", ".tf",
)
SKIPPED_FOLDERS = (".git", "node_modules", ".venv", "venv", "vendor", "dist", "build", "__pycache__", ".mypy_cache", ".pytest_cache", "target", ".idea")
MOST_CHARS = 100_000
RECORD, FIELD = "\x1e", "\x1f"


def _files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """(path, text) of whole files below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path).select("path", F.col("content").cast("string").alias("text"), "modificationTime")


#: Files that were attached to a page, whatever their names.
ATTACHED = r"/attachments/[^/]*$"


def pages(spark: SparkSession, path: str) -> DataFrame:
    """Raw records of page folders `{space}/{page}/` with content.html and, if it is there, meta.json. Without meta the
    title is taken from the HTML, and else is the page's id."""
    parts = F.split("path", "/")
    at = lambda n: F.element_at(parts, n)
    own = ~F.col("path").rlike(ATTACHED)
    html = _files(spark, path, "content.html").filter(own).select(at(-3).alias("folder"), at(-2).alias("page"), F.col("text").alias("raw_body"))
    meta = _files(spark, path, "meta.json").filter(own).select(at(-3).alias("folder"), at(-2).alias("page"), F.col("text").alias("meta"))
    strings = "array<string>"
    get = lambda name: F.get_json_object("meta", f"$.{name}")
    listed = lambda name: F.from_json(F.coalesce(get(name), F.lit("[]")), strings)
    return html.join(meta, ["folder", "page"], "left").select(
        F.lit("confluence").alias("source"), F.coalesce(get("source_id"), "page").alias("source_id"), "raw_body", F.coalesce(get("space_or_repo"), "folder").alias("space"),
        F.coalesce(get("title"), T.html_title(F.col("raw_body"), F.col("page"))).alias("title"), get("url").alias("url"), get("author").alias("author"),
        get("created_at").alias("created_at"), get("updated_at").alias("updated_at"), listed("tags").alias("tags"), listed("hierarchy").alias("hierarchy"),
        listed("category").alias("category"), get("doc_type").alias("doc_type"), F.col("meta").alias("raw_meta"),
    )


def issues(spark: SparkSession, path: str) -> DataFrame:
    """Raw records of issue files; a description may be text or a nested document."""
    from loamdex.functions.markdown import adf_text

    return issue_rows(_files(spark, path, "*.json").filter(~F.col("path").endswith("manifest.json")).select(F.col("text").alias("json")), adf_text)


def issue_rows(rows: DataFrame, read_description=lambda c: c) -> DataFrame:
    """Raw records from a column `json`."""
    get = lambda p: F.get_json_object("json", f"$.{p}")
    own = F.when(get("self").contains("/rest/"), F.concat(F.get(F.split(get("self"), "/rest/"), F.lit(0)), F.lit("/browse/"), get("key"))).otherwise(get("self"))
    none = F.array().cast("array<string>")
    return rows.select(
        F.lit("jira").alias("source"), get("key").alias("source_id"), read_description(get("fields.description")).alias("raw_body"),
        F.coalesce(get("fields.project.key"), F.get(F.split(get("key"), "-"), F.lit(0))).alias("space"), get("fields.summary").alias("title"),
        own.alias("url"), F.coalesce(get("fields.reporter.displayName"), get("fields.creator.displayName")).alias("author"),
        get("fields.created").alias("created_at"), get("fields.updated").alias("updated_at"),
        F.from_json(F.coalesce(get("fields.labels"), F.lit("[]")), "array<string>").alias("tags"),
        none.alias("hierarchy"), none.alias("category"), F.lit("issue").alias("doc_type"), F.col("json").alias("raw_meta"),
    )


def detect_host(remote: Column) -> Column:
    return F.when(remote.contains("github.com"), "github").when(remote.contains("gitlab"), "gitlab").when(remote.contains("bitbucket"), "bitbucket").otherwise("github")


def web_base(remote: Column) -> Column:
    """https://host/owner/repo of a remote in any form, or null."""
    pattern = r"(?:git@|https?://)(?:[^@/]*@)?([^/:]+)[/:](.+?)(?:\.git)?/?$"
    host = F.regexp_extract(remote, pattern, 1)
    return F.when(host != "", F.concat(F.lit("https://"), host, F.lit("/"), F.regexp_extract(remote, pattern, 2)))


def file_url(base: Column, host: Column, branch: Column, path: Column) -> Column:
    middle = F.when(host == "gitlab", "/-/blob/").when(host == "bitbucket", "/src/").otherwise("/blob/")
    return F.concat(base, middle, branch, F.lit("/"), path)


def commit_url(base: Column, host: Column, commit: Column) -> Column:
    middle = F.when(host == "gitlab", "/-/commit/").when(host == "bitbucket", "/commits/").otherwise("/commit/")
    return F.concat(base, middle, commit)


def normalize_remote(value: Column) -> Column:
    """The URL of a pasted `git clone ...` command or a URL with quotes."""
    s = F.regexp_replace(F.trim(F.coalesce(value, F.lit(""))), "^[\"']+|[\"']+$", "")
    words = F.filter(F.split(s, r"\s+"), lambda w: (w != "git") & (w != "clone") & ~w.startswith("-"))
    url = F.get(F.filter(words, lambda w: w.contains("://") | w.contains("@") | w.endswith(".git")), F.lit(0))
    return F.when(s.rlike(r"^git\s"), F.coalesce(url, F.get(words, F.lit(0)), s)).otherwise(s)


def repo_name(url: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(F.regexp_replace(url, "/+$", ""), "/"), -1), r"\.git$", "")


def with_credentials(url: str, token: str | None, user: str | None = None) -> str:
    """The https URL with a token, unless it has credentials already; other URLs as they are."""
    if not token or not url.startswith("https://") or "@" in url.removeprefix("https://").split("/")[0]:
        return url
    return f"https://{user + ':' if user else ''}{token}@{url.removeprefix('https://')}"


def hosted_repos(host: str, answer: DataFrame, column: str = "json") -> DataFrame:
    """(url, name) from a host's list of repositories as JSON."""
    json_ = F.col(column)
    if host == "bitbucket":
        kind = "struct<values:array<struct<full_name:string,links:struct<clone:array<struct<name:string,href:string>>>>>>"
        r = answer.select(F.explode(F.from_json(json_, kind).values).alias("r"))
        url = F.get(F.filter("r.links.clone", lambda c: c["name"] == "https"), F.lit(0))["href"]
        return r.select(url.alias("url"), F.coalesce("r.full_name", F.lit("")).alias("name")).filter("url IS NOT NULL")
    u, n = {"github": ("clone_url", "full_name"), "gitlab": ("http_url_to_repo", "path_with_namespace")}[host]
    r = answer.select(F.explode(F.from_json(json_, f"array<struct<{u}:string,{n}:string>>")).alias("r"))
    return r.select(F.col(f"r.{u}").alias("url"), F.coalesce(f"r.{n}", F.lit("")).alias("name")).filter("url IS NOT NULL")


def repo_files(spark: SparkSession, path: str, repo: str, base: str | None = None, branch: str = "main", code: bool = True, rules: tuple = ()) -> DataFrame:
    """Raw records of a repository's documents and code, cut to so many characters; blank files are left out."""
    root = path.rstrip("/").split("://")[-1].rstrip("/") + "/"
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    rel = F.substring_index("path", root, -1)
    extension = F.lower(F.regexp_extract(name, r"(?<=.)(\.[^.]+)$", 1))
    folders = F.slice(F.split(rel, "/"), 1, F.size(F.split(rel, "/")) - 1)
    wanted = [*DOC_EXTENSIONS, *(CODE_EXTENSIONS if code else ())]
    rows = _files(spark, path, "*").filter(extension.isin(*wanted) & ~F.arrays_overlap(folders, F.array(*map(F.lit, SKIPPED_FOLDERS))) & (F.trim("text") != ""))
    is_doc = extension.isin(*DOC_EXTENSIONS)
    hierarchy = F.concat(F.array(F.lit(repo)), folders)
    title = F.coalesce(F.when(is_doc, T.first_heading(F.col("text"))), rel)
    host = detect_host(F.lit(base or ""))
    none = F.array().cast("array<string>")
    return rows.select(
        host.alias("source"), F.concat(F.lit(f"{repo}:"), rel).alias("source_id"), F.substring("text", 1, MOST_CHARS).alias("raw_body"), F.lit(repo).alias("space"), title.alias("title"),
        file_url(F.lit(base), host, F.lit(branch), rel).alias("url"), F.lit(None).cast("string").alias("author"), F.lit(None).cast("string").alias("created_at"),
        F.date_format("modificationTime", "yyyy-MM-dd'T'HH:mm:ssXXX").alias("updated_at"), none.alias("tags"), hierarchy.alias("hierarchy"), none.alias("category"),
        F.when(is_doc, F.coalesce(T.doc_type(title, hierarchy, none, rules), F.lit("doc"))).otherwise("code").alias("doc_type"),
    )


def parse_commit_log(log: DataFrame, repo: str, column: str = "log") -> DataFrame:
    """(source_id, commit, author, at, subject, body, doc_type) of a log with separators: hash, author, date, subject, body."""
    records = log.select(F.explode(F.split(column, RECORD)).alias("r")).select(F.split("r", FIELD).alias("f")).filter(F.size("f") >= 4)
    get = lambda i: F.regexp_replace(F.get("f", F.lit(i)), r"^\s+|\s+$", "")
    kind = F.coalesce(T.commit_type(get(3)), F.lit("commit"))
    return records.select(F.concat(F.lit(f"{repo}@"), F.substring(get(0), 1, 12)).alias("source_id"), get(0).alias("commit"), get(1).alias("author"), T.parse_iso8601(get(2)).alias("at"), get(3).alias("subject"), F.coalesce(get(4), F.lit("")).alias("body"), kind.alias("doc_type"))


def last_authors(commits: DataFrame) -> DataFrame:
    """(path, author, at): who last changed each file, of (path, author, at)."""
    return commits.groupBy("path").agg(F.max_by("author", "at").alias("author"), F.max("at").alias("at"))


def name_status(diff: DataFrame, column: str = "line") -> DataFrame:
    """(op, path) from lines of `git diff --name-status`: added, deleted or modified; a rename counts by its new path."""
    parts = F.split(column, "\t")
    op = F.when(F.col(column).startswith("A"), "added").when(F.col(column).startswith("D"), "deleted").otherwise("modified")
    return diff.filter(F.size(parts) >= 2).select(op.alias("op"), F.element_at(parts, -1).alias("path"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    kind = "source string, as_of string, stats map<string,string>, last_change struct<since:string,added:array<string>,modified:array<string>,deleted:array<string>>"
    return spark.read.schema(kind).option("multiLine", True).json(path)


def changed_ids(manifest: DataFrame) -> DataFrame:
    """(source_id, op) of the manifests' changes."""
    part = lambda op: manifest.select(F.explode(f"last_change.{op}").alias("source_id"), F.lit(op).alias("op"))
    return part("added").unionByName(part("modified")).unionByName(part("deleted"))


def dictionary(spark: SparkSession, files: list[str], read=None) -> DataFrame:
    """(term, synonyms, domain, scope, boost) of YAML files; of entries with one term the first file's counts."""
    import yaml

    rows, seen = [], set()
    for name in files:
        text = read(name) if read else "\n".join(r.value for r in spark.read.text(name, wholetext=True).collect())
        for item in yaml.safe_load(text) or []:
            if isinstance(item, dict) and item.get("term") and item["term"] not in seen:
                seen.add(item["term"])
                rows.append((item["term"], list(item.get("synonyms") or []), item.get("domain") or "", item.get("scope") or "global", float(item.get("boost") or 1.0)))
    return spark.createDataFrame(rows, "term string, synonyms array<string>, domain string, scope string, boost double")


class _LogPart(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _CommitReader(DataSourceReader):
    def __init__(self, options):
        self.paths = [p for p in options.get("paths", options.get("path", "")).split(",") if p]
        self.most = int(options.get("most", 2000))

    def partitions(self):
        return [_LogPart(p) for p in self.paths]

    def read(self, partition) -> Iterator[tuple]:
        form = FIELD.join(("%H", "%an", "%aI", "%s", "%b")) + RECORD
        out = subprocess.run(["git", "-C", partition.path, "log", f"-{self.most}", f"--format={form}"], capture_output=True, text=True, timeout=600).stdout
        repo = PurePosixPath(partition.path).name
        for record in out.split(RECORD):
            parts = record.strip("\n").split(FIELD)
            if len(parts) == 5:
                yield (f"{repo}@{parts[0][:12]}", *parts)


class CommitSource(DataSource):
    """`spark.read.format("git_commits").option("paths", "/a,/b")`: a partition for each repository that executors see."""

    @classmethod
    def name(cls) -> str:
        return "git_commits"

    def schema(self) -> str:
        return "source_id string, commit string, author string, at string, subject string, body string"

    def reader(self, schema) -> DataSourceReader:
        return _CommitReader(self.options)


class _RestReader(DataSourceReader):
    def __init__(self, options):
        self.options = dict(options)

    def partitions(self):
        return [_LogPart(u) for u in self.options["urls"].split()]

    def read(self, partition) -> Iterator[tuple]:
        start = url = partition.path
        headers = {"Accept": "application/json"} | authorization(self.options.get("user"), self.options.get("token"))
        while url:
            data = fetch_json(url, headers, float(self.options.get("timeout", 60)))
            items = data.get(self.options.get("items", "results"), [])
            for item in items:
                yield (json.dumps(item, ensure_ascii=False),)
            url = following_page(start, url, data) if items else None


def authorization(user: str | None, token: str | None) -> dict[str, str]:
    """The header of a user with a token, or of a token alone."""
    if not token:
        return {}
    return {"Authorization": "Basic " + base64.b64encode(f"{user}:{token}".encode()).decode() if user else f"Bearer {token}"}


def fetch_json(url: str, headers: dict[str, str], timeout: float = 60.0, tries: int = 2) -> dict:
    """The JSON of an answer. Failures of the network and of the server are tried again; refusals (4xx) aren't."""
    while True:
        tries -= 1
        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=timeout) as answer:
                return json.loads(answer.read())
        except urllib.error.HTTPError as e:
            if e.code < 500 or not tries:
                raise
        except (urllib.error.URLError, TimeoutError):
            if not tries:
                raise


def following_page(start: str, url: str, data: dict) -> str | None:
    """The next page by a link or by a token. A link to another host isn't followed, since it would get the token."""
    if data.get("nextPageToken"):
        parts = urllib.parse.urlsplit(start)
        query = urllib.parse.parse_qsl(parts.query) + [("nextPageToken", data["nextPageToken"])]
        return urllib.parse.urlunsplit(parts._replace(query=urllib.parse.urlencode(query)))
    links = data.get("_links") or {}
    link = links.get("next") or data.get("nextPage")
    if not link:
        return None
    # A link that begins with a slash is one below the context path, which the answer names where there is one.
    context = links.get("context") or ""
    out = urllib.parse.urljoin(url, context + link if link.startswith("/") and not link.startswith(f"{context}/") else link)
    if urllib.parse.urlsplit(out)[:2] != urllib.parse.urlsplit(start)[:2]:
        raise ValueError(f"the next page is on another host: {out}")
    return out


class RestSource(DataSource):
    """`spark.read.format("rest_pages").option("urls", ...)`: items of paged JSON answers, one partition for each of the URLs
    (between spaces)."""

    @classmethod
    def name(cls) -> str:
        return "rest_pages"

    def schema(self) -> str:
        return "json string"

    def reader(self, schema) -> DataSourceReader:
        return _RestReader(self.options)


def date_window(since: str | None = None, until: str | None = None, days: int | None = None) -> str:
    """The CQL condition of an acquisition: explicit dates before a number of days before everything."""
    if since or until:
        return " AND ".join(f'lastmodified {op} "{d}"' for op, d in ((">=", since), ("<=", until)) if d)
    return f'lastmodified >= now("-{days}d")' if days else ""


def newer(remote: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Remote rows whose id and version (or update time) aren't stored: what an acquisition still has to fetch."""
    return remote.join(stored.select(*keys), keys, "left_anti")


def attachments_wanted(rows: DataFrame, extensions: tuple[str, ...], most_bytes: int) -> DataFrame:
    """Attachments (filename, size) of wanted extensions that aren't too large."""
    return rows.filter(F.lower(F.regexp_extract("filename", r"(\.[^.]+)$", 1)).isin(*extensions) & (F.col("size") <= most_bytes))


CONNECTORS = {"confluence": pages, "jira": issues, "git": repo_files}
