"""Attachments of pages: listed by the tasks that hold the pages, then fetched by tasks that the files are dealt to, so that a
page with many of them is no task of its own. Files are streamed into the page's folder, in a file system that all executors mount;
a file takes its name when it is whole, so a task that is run again, or a run that was cut off, leaves no part of one."""

from __future__ import annotations

import os
import urllib.error
import urllib.parse
import urllib.request
import uuid
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamdex.session import materialize
from loamdex.sources import bronze

# Extensions that aren't fetched (archives, films, sound, images of disks and programs), and the largest size.
SKIPPED = ("zip", "7z", "rar", "tar", "gz", "tgz", "bz2", "xz", "mp4", "mov", "avi", "mkv", "wmv", "flv", "webm", "mp3", "wav", "flac", "m4a", "aac", "iso", "dmg", "exe", "msi", "dll", "bin", "apk")
MOST_BYTES = 50 << 20

LISTED = "space string, source_id string, filename string, media_type string, size long, link string"
DONE = LISTED + ", local_path string, status string"


class _SameHost(urllib.request.HTTPRedirectHandler):
    """Follows to storage on another host, which doesn't get the token."""

    def redirect_request(self, req, fp, code, msg, headers, newurl):
        new = super().redirect_request(req, fp, code, msg, headers, newurl)
        if new is not None and urllib.parse.urlsplit(newurl)[:2] != urllib.parse.urlsplit(req.full_url)[:2]:
            new.remove_header("Authorization")
        return new


def address(base: str, link: str) -> str:
    """Where a file is: links without a host are below the base. One to another host is refused, since it would get the token."""
    base, parts = base.rstrip("/"), urllib.parse.urlsplit(base)
    if not urllib.parse.urlsplit(link).scheme and not link.startswith("//"):
        below = parts.path.rstrip("/")
        return f"{parts.scheme}://{parts.netloc}{link}" if below and link.startswith(f"{below}/") else f"{base}/{link.lstrip('/')}"
    if urllib.parse.urlsplit(link)[:2] != parts[:2]:
        raise ValueError(f"the file is on another host: {link}")
    return link


def plain_name(name: str | None) -> bool:
    """Whether a name that a server has sent can be that of a file in the page's folder."""
    return bool(name) and not name.startswith(".") and not any(c in "/\\" or ord(c) < 32 for c in name) and len(name.encode()) <= 200


def listed(pages: DataFrame, base: str, headers: dict[str, str], size: int = 50) -> DataFrame:
    """The attachments of pages (space, source_id). Where the list is refused, a row with no name stands for it."""

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in LISTED.split(", ")]
        for frame in frames:
            for page in frame.itertuples():
                start = url = f"{base.rstrip('/')}/rest/api/content/{urllib.parse.quote(page.source_id, safe='')}/child/attachment?limit={size}&expand=metadata,extensions"
                while url:
                    try:
                        data = bronze.fetch_json(url, {"Accept": "application/json"} | headers)
                    except (urllib.error.URLError, TimeoutError, ValueError):
                        yield pd.DataFrame([(page.space, page.source_id, None, None, None, None)], columns=columns)
                        break
                    items = data.get("results", [])
                    more = [(a.get("extensions") or {}, a) for a in items]
                    found = [(page.space, page.source_id, a.get("title"), e.get("mediaType"), e.get("fileSize"), (a.get("_links") or {}).get("download")) for e, a in more]
                    if found:
                        out = pd.DataFrame(found, columns=columns)
                        yield out.assign(size=pd.to_numeric(out["size"], errors="coerce").astype("Int64"))
                    url = bronze.following_page(start, url, data) if items else None

    return pages.select("space", "source_id").mapInPandas(ask, LISTED)


def save(link: str, to: Path, headers: dict[str, str], most_bytes: int) -> bool:
    """Streams a file to its place; False if it is larger than is wanted."""
    opener = urllib.request.build_opener(_SameHost)
    part = to.with_name(f".part-{uuid.uuid4().hex}")
    to.parent.mkdir(parents=True, exist_ok=True)
    try:
        with opener.open(urllib.request.Request(link, headers=headers), timeout=60) as answer, open(part, "wb") as f:
            told = answer.headers.get("Content-Length")
            if told and told.isdigit() and int(told) > most_bytes:
                return False
            while block := answer.read(1 << 20):
                if f.tell() + len(block) > most_bytes:
                    return False
                f.write(block)
            if told and told.isdigit() and f.tell() != int(told):
                raise urllib.error.URLError("the answer was cut off")
        os.replace(part, to)
        return True
    finally:
        part.unlink(missing_ok=True)


def fetch(pages: DataFrame, base: str, path: str, user: str | None = None, token: str | None = None, force: bool = False, most_bytes: int = MOST_BYTES, skip: tuple[str, ...] = SKIPPED) -> DataFrame:
    """Fetches the attachments of pages (space, source_id) into `path/{space}/{source_id}/attachments`, and returns a row for
    each: fetched, present (a file of its size is there, unless `force`), skipped (extension, size, no link, or a name that can't
    be a file's) or failed (refused by the server; the others are fetched all the same)."""
    headers = bronze.authorization(user, token)
    files = materialize(listed(pages, base, headers), "attachments").dropDuplicates(["space", "source_id", "filename"])

    def get(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                name = row.filename if isinstance(row.filename, str) else None
                size = None if pd.isna(row.size_) else int(row.size_)
                local, status = None, "failed" if name is None else "skipped"
                if plain_name(name) and isinstance(row.link, str) and Path(name).suffix.lstrip(".").lower() not in skip and (size is None or size <= most_bytes):
                    to = Path(path, row.space, row.source_id, "attachments", name)
                    try:
                        if not force and to.is_file() and size is not None and to.stat().st_size == size:
                            local, status = f"attachments/{name}", "present"
                        elif save(address(base, row.link), to, headers, most_bytes):
                            local, status = f"attachments/{name}", "fetched"
                    except (urllib.error.URLError, TimeoutError, ConnectionError, ValueError):
                        status = "failed"
                out = frame.iloc[:0].rename(columns={"size_": "size"}).assign(local_path=None, status=None)
                out.loc[0] = [row.space, row.source_id, name, row.media_type, size, row.link, local, status]
                yield out.assign(size=out["size"].astype("Int64"))

    cores = pages.sparkSession.sparkContext.defaultParallelism
    # `size` is an attribute of every frame, so the rows carry it under another name.
    return materialize(files.repartition(4 * cores, "source_id", "filename").withColumnRenamed("size", "size_").mapInPandas(get, DONE), "fetched-attachments")


def with_attachments(pages: DataFrame, done: DataFrame) -> DataFrame:
    """Pages (space, source_id, raw_body, meta) whose meta names their attachments, by name."""
    one = F.struct("filename", "media_type", F.col("size").alias("file_size"), "local_path", F.col("link").alias("url"))
    names = done.filter("filename IS NOT NULL").groupBy("space", "source_id").agg(F.to_json(F.sort_array(F.collect_list(one)), {"ignoreNullFields": "false"}).alias("names"))
    named = F.concat(F.expr("left(meta, length(meta) - 1)"), F.lit(',"attachments":'), F.coalesce("names", F.lit("[]")), F.lit("}"))
    return pages.join(names, ["space", "source_id"], "left").withColumn("meta", named).drop("names")

