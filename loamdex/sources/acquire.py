"""Acquisition: what a server or a remote repository has that isn't stored yet, written as the raw files that
`loamdex.sources.bronze` reads. Spaces and projects are fetched by different tasks. A run that was cut off is continued by
the next one, which skips what is stored."""

from __future__ import annotations

import os
import subprocess
import urllib.parse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamdex.session import materialize
from loamdex.sources import attachments as files_of_pages
from loamdex.sources import bronze, sinks

# What is asked for with each page and issue.
PAGE_PARTS = "space,version,history,ancestors,metadata.labels,body.storage"
ISSUE_FIELDS = "summary,description,reporter,creator,created,updated,labels,issuetype,status,project"


def _quoted(value: str) -> str:
    return '"' + value.replace("\\", "\\\\").replace('"', '\\"') + '"'


def page_urls(base: str, spaces: list[str] = (), since: str | None = None, until: str | None = None, days: int | None = None, size: int = 25) -> list[str]:
    """First pages of the content searches: one for each space, or one for all."""
    window = bronze.date_window(since, until, days)
    out = []
    for space in spaces or [None]:
        parts = ["type = page", *([f"space = {_quoted(space)}"] if space else []), *([window] if window else [])]
        query = {"cql": " AND ".join(parts) + " ORDER BY lastmodified DESC", "limit": size, "expand": PAGE_PARTS}
        out.append(f"{base.rstrip('/')}/rest/api/content/search?{urllib.parse.urlencode(query)}")
    return out


def issue_urls(base: str, projects: list[str], days: int | None = None, size: int = 50, since: str | None = None) -> list[str]:
    """First pages of the issue searches, one for each project; a date goes before a number of days."""
    recent = f' AND updated >= "{since}"' if since else f' AND updated >= "-{days}d"' if days is not None else ""
    queries = ({"jql": f"project = {_quoted(p)}{recent} ORDER BY updated DESC", "maxResults": size, "fields": ISSUE_FIELDS} for p in projects)
    return [f"{base.rstrip('/')}/rest/api/3/search/jql?{urllib.parse.urlencode(q)}" for q in queries]


def fetched(spark: SparkSession, urls: list[str], items: str, user: str | None, token: str | None) -> DataFrame:
    """(json) of the items of all pages, fetched once."""
    spark.dataSource.register(bronze.RestSource)
    options = {"urls": " ".join(urls), "items": items} | ({"user": user} if user else {}) | ({"token": token} if token else {})
    return materialize(spark.read.format("rest_pages").options(**options).load(), "fetched")


def safe_name(name: Column) -> Column:
    """Whether a name that a server has sent can be that of a file."""
    return F.coalesce(name.rlike(r"^[\w~-][\w.~-]*$"), F.lit(False))


def page_rows(answers: DataFrame, base: str) -> DataFrame:
    """(space, source_id, version, raw_body, meta) of pages as JSON; of repeated ones the latest version."""
    get = lambda p: F.get_json_object("json", f"$.{p}")
    names = lambda p, field: F.transform(F.from_json(F.coalesce(get(p), F.lit("[]")), f"array<struct<{field}:string>>"), lambda r: r[field])
    meta = F.to_json(F.struct(
        F.lit("confluence").alias("source"), get("id").alias("source_id"), get("space.key").alias("space_or_repo"), get("title").alias("title"),
        F.concat(F.lit(base.rstrip("/")), get("_links.webui")).alias("url"), get("history.createdBy.displayName").alias("author"), get("history.createdDate").alias("created_at"),
        get("version.when").alias("updated_at"), names("metadata.labels.results", "name").alias("tags"), names("ancestors", "title").alias("hierarchy"),
        get("version.number").cast("long").alias("version"),
    ))
    rows = answers.select(get("space.key").alias("space"), get("id").alias("source_id"), get("version.number").cast("long").alias("version"), get("body.storage.value").alias("raw_body"), meta.alias("meta"))
    rows = rows.filter(safe_name(F.col("space")) & safe_name(F.col("source_id")))
    return rows.groupBy("source_id").agg(F.max_by(F.struct("space", "version", "raw_body", "meta"), F.coalesce("version", F.lit(0))).alias("r")).select("r.space", "source_id", "r.version", "r.raw_body", "r.meta")


def issue_files(answers: DataFrame) -> DataFrame:
    """(folder, name, text, updated) of issues as JSON; of repeated ones the latest."""
    get = lambda p: F.get_json_object("json", f"$.{p}")
    folder = F.coalesce(get("fields.project.key"), F.substring_index(get("key"), "-", 1))
    rows = answers.select(folder.alias("folder"), F.concat(get("key"), F.lit(".json")).alias("name"), F.col("json").alias("text"), get("fields.updated").alias("updated"))
    rows = rows.filter(safe_name(F.col("folder")) & safe_name(F.col("name")))
    return rows.groupBy("folder", "name").agg(F.max_by(F.struct("text", "updated"), F.coalesce("updated", F.lit(""))).alias("r")).select("folder", "name", "r.text", "r.updated")


def _stored(spark: SparkSession, path: str, glob: str) -> DataFrame | None:
    try:
        return bronze._files(spark, path, glob)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None


def _finish(rows: DataFrame, key: str, stored: DataFrame | None, keys: list[str], force: bool) -> tuple[DataFrame, dict[str, int]]:
    """Rows still to write, and numbers of added, modified and skipped ones."""
    if stored is None:
        return rows, {"added": rows.count(), "modified": 0, "skipped": 0}
    wanted = materialize(rows if force else bronze.newer(rows, stored, keys), "wanted")
    n, modified = wanted.count(), wanted.join(stored.select(key), key, "left_semi").count()
    return wanted, {"added": n - modified, "modified": modified, "skipped": rows.count() - n}


def acquire_pages(spark: SparkSession, base: str, path: str, spaces: list[str] = (), user: str | None = None, token: str | None = None, force: bool = False, dry_run: bool = False, attachments: bool = False, **window) -> dict[str, int]:
    """Writes pages whose version isn't stored as page folders; with `attachments` their files as well, which the pages' meta
    names."""
    rows = materialize(page_rows(fetched(spark, page_urls(base, spaces, **window), "results", user, token), base), "pages")
    files = _stored(spark, path, "meta.json")
    if files is not None:
        files = files.filter(~F.col("path").rlike(bronze.ATTACHED))
    get = lambda p: F.get_json_object("text", f"$.{p}")
    stored = None if files is None else materialize(files.select(get("source_id").alias("source_id"), get("version").cast("long").alias("version")), "stored")
    wanted, stats = _finish(rows, "source_id", stored, ["source_id", "version"], force)
    if not dry_run:
        spark.dataSource.register(sinks.PageFolders)
        folders = wanted.select("space", "source_id", "raw_body", "meta")
        if attachments:
            done = files_of_pages.fetch(folders, base, path, user, token, force)
            folders = files_of_pages.with_attachments(folders, done)
            stats |= {f"attachments_{r.status}": r.n for r in done.groupBy("status").agg(F.count("*").alias("n")).collect()}
        folders.write.format("page_folders").mode("append").option("path", path).save()
    return stats


def acquire_issues(spark: SparkSession, base: str, path: str, projects: list[str], user: str | None = None, token: str | None = None, days: int | None = None, force: bool = False, dry_run: bool = False) -> dict[str, int]:
    """Writes issues whose time of update isn't stored, one file each."""
    if not projects:
        raise ValueError("name the projects")
    rows = materialize(issue_files(fetched(spark, issue_urls(base, projects, days), "issues", user, token)), "issues")
    files = _stored(spark, path, "*.json")
    name = F.element_at(F.split("path", "/"), -1).alias("name")
    stored = None if files is None else materialize(files.select(name, F.get_json_object("text", "$.fields.updated").alias("updated")), "stored")
    wanted, stats = _finish(rows, "name", stored, ["name", "updated"], force)
    if not dry_run:
        spark.dataSource.register(sinks.TextFiles)
        wanted.select("folder", "name", "text").write.format("text_files").mode("append").option("path", path).save()
    return stats


def acquire_repo(url: str, path: str, branch: str | None = None, depth: int | None = None, token: str | None = None, user: str | None = None) -> dict[str, str]:
    """Clones a repository to `path`, or brings the clone there to the remote state. The token isn't left in the clone."""

    def git(*args: str) -> str:
        out = subprocess.run(["git", *args], capture_output=True, text=True, env=os.environ | {"GIT_TERMINAL_PROMPT": "0"})
        if out.returncode:
            message = out.stderr.replace(token, "***") if token else out.stderr
            raise RuntimeError(f"git {args[0] if args[0] != '-C' else args[2]} failed: {message.strip()[-300:]}")
        return out.stdout.strip()

    remote = bronze.with_credentials(url, token, user)
    shallow = ["--depth", str(depth)] if depth else []
    existed = os.path.isdir(os.path.join(path, ".git"))
    if existed:
        wanted = branch or git("-C", path, "rev-parse", "--abbrev-ref", "HEAD")
        git("-C", path, "fetch", *shallow, "--", remote, f"refs/heads/{wanted}")
        git("-C", path, "checkout", "-q", "-B", wanted, "FETCH_HEAD", "--force")
    else:
        git("clone", "-q", *shallow, *(["--branch", branch] if branch else []), "--", remote, path)
        git("-C", path, "remote", "set-url", "origin", url)
    return {"status": "updated" if existed else "cloned", "commit": git("-C", path, "rev-parse", "HEAD")}
