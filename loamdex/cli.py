"""Command line: `python -m loamdex.cli acquire|sync|watch|init|search|advanced|related|document|browse|sources|status|health|publish|serve|demo ...`"""

from __future__ import annotations

import argparse
import json
import os
import time

from loamdex.server import HOST, PORT, Server
from loamdex.service import Service, Settings, build, places, sync
from loamdex.session import get_spark
from loamdex.sources import acquire, sinks
from loamdex.streaming import follow


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="loamdex")
    p.add_argument("--data", default="loamdex-data", help="folder of the tables")
    p.add_argument("--settings", default=".env")
    sub = p.add_subparsers(dest="command", required=True)
    s = sub.add_parser("search")
    s.add_argument("query")
    s.add_argument("-k", type=int, default=10)
    s.add_argument("--offset", type=int, default=0)
    s.add_argument("--user")
    for name in ("sources", "spaces", "tags", "authors"):
        s.add_argument(f"--{name}", nargs="*")
    a = sub.add_parser("advanced")
    for name in ("title", "body", "author", "space"):
        a.add_argument(f"--{name}")
    for name, what in (("related", "doc_id"), ("document", "doc_id")):
        sub.add_parser(name).add_argument(what)
    b = sub.add_parser("browse")
    for name in ("source", "space", "prefix"):
        b.add_argument(f"--{name}")
    for name in ("sources", "status", "health", "reindex", "demo"):
        sub.add_parser(name)
    v = sub.add_parser("serve", help="answers on standard input and output, or by HTTP; LOAMDEX_HTTP_TOKEN, or its setting, is asked of clients")
    v.add_argument("--transport", choices=("stdio", "http"), default="stdio")
    v.add_argument("--host", default=HOST, help="other machines are served with a token only")
    v.add_argument("--port", type=int, default=PORT)
    sub.add_parser("publish").add_argument("target", help="folder that takes the tables")
    i = sub.add_parser("init", help="adds NAME=value lines to the settings file")
    i.add_argument("values", nargs="+", metavar="NAME=value")
    q = sub.add_parser("acquire", help="fetches raw files; the token is read from LOAMDEX_TOKEN, the user from LOAMDEX_USER")
    q.add_argument("kind", choices=("confluence", "jira", "git"))
    q.add_argument("url")
    q.add_argument("target", help="folder of the raw files")
    q.add_argument("--only", nargs="*", default=[], help="spaces or projects")
    q.add_argument("--days", type=int)
    for name in ("since", "until", "branch"):
        q.add_argument(f"--{name}")
    q.add_argument("--depth", type=int)
    q.add_argument("--checkpoint", help="folder of a stream: what changed since its last run is fetched, without reading what is stored")
    q.add_argument("--every", type=float, help="seconds between runs of the stream")
    for name in ("force", "dry-run", "attachments"):
        q.add_argument(f"--{name}", action="store_true")
    for name in ("sync", "watch"):
        y = sub.add_parser(name)
        y.add_argument("kind", choices=("confluence", "jira", "git"))
        y.add_argument("source")
        y.add_argument("--full", action="store_true")
        if name == "watch":
            y.add_argument("--every", type=int, default=300)
    return p


def demo(spark, path: str) -> None:
    """A small corpus to try the commands on."""
    from pyspark.sql import functions as F

    texts = [("Payment guide", "How a payment is made and refunded."), ("Deployment runbook", "Steps to deploy the service and to roll back."), ("Ledger design", "The ledger keeps every payment.")]
    rows = [(f"d{i}", "web", "demo", t, b, ["demo"], ["demo"], ["demo", t], "Ann") for i, (t, b) in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id string, source string, space string, title string, body string, tags array<string>, categories array<string>, hierarchy array<string>, author string")
    build(docs.withColumns({"created_at": F.current_timestamp(), "updated_at": F.current_timestamp()}), path)


def fetch(spark, a) -> dict:
    user, token = os.environ.get("LOAMDEX_USER"), os.environ.get("LOAMDEX_TOKEN")
    if a.kind == "git":
        return acquire.acquire_repo(a.url, a.target, a.branch, a.depth, token, user)
    if a.checkpoint:
        if a.days is not None or a.until or a.force or a.dry_run or a.attachments:
            raise SystemExit("a stream takes --since only")
        changes = follow.rest_changes(spark, a.kind, a.url, a.only, user, token, start=a.since)
        return {"fetched": sum(follow.follow(changes, follow.raw_files(a.kind, a.url, a.target), a.checkpoint, a.every))}
    common = {"user": user, "token": token, "days": a.days, "force": a.force, "dry_run": a.dry_run}
    if a.kind == "jira":
        return acquire.acquire_issues(spark, a.url, a.target, a.only, **common)
    return acquire.acquire_pages(spark, a.url, a.target, a.only, since=a.since, until=a.until, attachments=a.attachments, **common)


def init(path: str, values: list[str]) -> None:
    """Sets NAME=value lines of a settings file, which only its owner may read; other lines stay."""
    new = dict(v.split("=", 1) for v in values)
    lines = []
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            lines = [line for line in f.read().splitlines() if line.partition("=")[0].strip() not in new]
    with open(os.open(path, os.O_WRONLY | os.O_CREAT | os.O_TRUNC, 0o600), "w", encoding="utf-8") as f:
        f.write("\n".join([*lines, *(f"{n}={v}" for n, v in new.items())]) + "\n")


def health(spark, path: str) -> dict[str, bool]:
    """Which of the tables that a service reads can be read."""
    found, place = {}, places(spark, path)
    for name in ("documents", "index/blocks", "links", "chunks"):
        try:
            table, _, below = name.partition("/")
            spark.read.parquet(f"{place(table)}/{below}" if below else place(table)).take(1)
            found[name] = True
        except Exception:  # noqa: BLE001  (missing and broken tables alike)
            found[name] = False
    return found


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)
    if a.command == "init":
        if not all("=" in v for v in a.values):
            raise SystemExit("NAME=value is expected")
        init(a.settings, a.values)
        return 0
    spark = get_spark()
    if a.command == "acquire":
        print(json.dumps(fetch(spark, a)))
        return 0
    if a.command == "demo":
        demo(spark, a.data)
        return 0
    if a.command == "health":
        found = health(spark, a.data)
        print(json.dumps(found))
        return 0 if found["documents"] and found["index/blocks"] else 1
    if a.command == "publish":
        sinks.publish(spark, a.data, a.target)
        return 0
    if a.command in ("sync", "watch"):
        while True:
            print(json.dumps(sync(spark, a.kind, a.source, a.data, a.full)))
            if a.command == "sync":
                return 0
            time.sleep(max(5, a.every))
    service = Service.open(spark, a.data, settings=Settings.load(a.settings))
    if a.command == "serve":
        server = Server(service, a.data)
        if a.transport == "stdio":
            server.serve()
            return 0
        with server.http(a.host, a.port, service.settings.http_token) as found:
            found.serve_forever()
        return 0
    if a.command == "search":
        hits, facets = service.search(a.query, a.k, a.offset, a.user, sources=a.sources, spaces=a.spaces, tags=a.tags, authors=a.authors)
        print(json.dumps({"hits": [r.asDict() for r in hits.collect()], "facets": [r.asDict() for r in facets.collect()]}, ensure_ascii=False, default=str))
        return 0
    found = {
        "advanced": lambda: service.advanced_search(a.title, a.body, author=a.author, space=a.space), "related": lambda: service.get_related(a.doc_id), "document": lambda: service.get_document(a.doc_id),
        "browse": lambda: service.browse(source=a.source, space=a.space, prefix=a.prefix), "sources": service.list_sources, "status": service.status, "reindex": lambda: service.reindex(a.data),
    }[a.command]()
    for row in found.toLocalIterator() if found is not None else ():
        print(json.dumps(row.asDict(), ensure_ascii=False, default=str))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
