"""Acquisition as a stream over a growing server and a growing clone."""

import json
import subprocess
import threading
import urllib.parse
from datetime import UTC, datetime
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from loamdex import cli
from loamdex.operators import snapshots
from loamdex.sources import bronze
from loamdex.streaming import follow, logs


def page(id_, version, when, space="ENG"):
    return {"id": id_, "title": f"Page {id_}", "space": {"key": space}, "version": {"number": version, "when": when}, "body": {"storage": {"value": f"<p>{id_} v{version}</p>"}}}


@pytest.fixture
def server():
    """Newest first, two to a page, by offset."""
    state = {"items": [], "asked": []}

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            q = dict(urllib.parse.parse_qsl(urllib.parse.urlsplit(self.path).query))
            state["asked"].append(q)
            jira = "jql" in q
            words = q["jql"] if jira else q["cql"]
            time_of = (lambda i: i["fields"]["updated"]) if jira else (lambda i: i["version"]["when"])
            own = (lambda i: i["fields"]["project"]["key"]) if jira else (lambda i: i["space"]["key"])
            found = sorted((i for i in state["items"] if f'"{own(i)}"' in words), key=lambda i: str(time_of(i)), reverse=True)
            at = int(q.get("nextPageToken" if jira else "start", "0"))
            size = min(2, int(q.get("maxResults" if jira else "limit", "2")))
            more = at + size < len(found)
            if jira:
                out = {"issues": found[at : at + size]} | ({"nextPageToken": str(at + size)} if more else {})
            else:
                query = urllib.parse.urlencode({"cql": words, "start": at + size})
                out = {"results": found[at : at + size], "_links": {"next": f"/rest/api/content/search?{query}"} if more else {}}
            body = json.dumps(out).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    http = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    state["base"] = f"http://127.0.0.1:{http.server_port}"
    yield state
    http.shutdown()


def test_each_change_of_pages_is_read_once(spark, server, tmp_path):
    path, checkpoint = str(tmp_path / "pages"), str(tmp_path / "check")

    def run():
        server["asked"].clear()
        changes = follow.rest_changes(spark, "confluence", server["base"], ["ENG", "OPS", "NONE"])
        return sum(follow.follow(changes, follow.raw_files("confluence", server["base"], path), checkpoint))

    # Zones differ; equal times; one without a time has no place in the order.
    server["items"] = [page("1", 1, "2024-02-01T00:00:00Z"), page("2", 1, "2024-02-01T09:30:00.000+0900"), page("3", 1, "2024-02-01T00:00:00Z", "OPS"), page("4", 1, None), page("5", 1, "2024-01-05T00:00:00Z"), page("6", 1, "2024-01-04T00:00:00Z"), page("7", 1, "2024-01-03T00:00:00Z")]
    assert run() == 6
    bodies = lambda: {r.source_id: r.raw_body for r in bronze.pages(spark, path).collect()}
    assert bodies() == {i: f"<p>{i} v1</p>" for i in "123567"}
    assert run() == 0 and {q["limit"] for q in server["asked"] if "limit" in q} == {"1"}
    server["items"].pop(3)
    server["items"][4] = page("6", 2, "2024-03-01T00:00:00Z")
    server["items"].append(page("8", 1, "2024-02-20T00:00:00Z"))
    server["items"].append(page("9", 1, "2099-01-01T00:00:00Z", "OPS"))  # not settled yet
    assert run() == 2
    assert bodies() == {i: f"<p>{i} v{2 if i == '6' else 1}</p>" for i in "1235678"}
    # Newest first and no further than the watermark: two answers of two items, not all three.
    reads = [q for q in server["asked"] if q.get("limit") != "1" and '"ENG"' in q["cql"]]
    assert len(reads) == 2 and all('lastmodified >= "2024-01-30"' in q["cql"] for q in reads)
    assert run() == 0


def test_a_batch_that_failed_is_read_again(spark, server, tmp_path):
    path, checkpoint = str(tmp_path / "issues"), str(tmp_path / "check")
    issue = lambda key, at: {"key": key, "fields": {"summary": key, "updated": at, "project": {"key": key.split("-")[0]}}}
    server["items"] = [issue("AB-1", "2024-01-01T00:00:00.000+0000"), issue("AB-2", "2024-01-02T00:00:00.000+0000")]
    changes = follow.rest_changes(spark, "jira", server["base"], ["AB"], start="2023-06-01")

    def fails(batch, number):
        raise ValueError("stopped")

    with pytest.raises(Exception, match="stopped"):
        follow.follow(changes, fails, checkpoint)
    server["items"].append(issue("AB-3", "2024-01-03T00:00:00.000+0000"))
    assert sum(follow.follow(changes, follow.raw_files("jira", server["base"], path), checkpoint)) == 3
    assert sorted(r.title for r in bronze.issues(spark, path).collect()) == ["AB-1", "AB-2", "AB-3"]
    assert cli.main(["acquire", "jira", server["base"], path, "--only", "AB", "--checkpoint", checkpoint]) == 0
    with pytest.raises(SystemExit):
        cli.main(["acquire", "jira", server["base"], path, "--only", "AB", "--checkpoint", checkpoint, "--force"])
    with pytest.raises(Exception, match="name the spaces"):
        follow.follow(follow.rest_changes(spark, "jira", server["base"], []), fails, str(tmp_path / "other"))


def test_commits_go_into_a_table_by_buckets(spark, tmp_path):
    clone, path = tmp_path / "clone", str(tmp_path / "table")

    def git(*args):
        return subprocess.run(["git", "-C", str(clone), "-c", "user.name=a", "-c", "user.email=a@b", *args], check=True, capture_output=True, text=True).stdout.strip()

    def commit(text):
        git("commit", "-q", "--allow-empty", "-m", text)

    clone.mkdir()
    git("init", "-q", "-b", "main")
    schema = follow.GitChanges({}).schema() + ", content_hash string"
    change = snapshots.Change(spark, path)
    change.put("commits", spark.createDataFrame([], schema), ["source_id"], 8)
    change.commit()

    def run():
        merge = logs.merge_into_buckets(path, "commits", ("at",))
        return sum(follow.follow(follow.git_changes(spark, [str(clone)]), lambda batch, n: merge(follow.commit_rows(batch), n), str(tmp_path / "check")))

    subjects = lambda: sorted(r.subject for r in snapshots.latest(spark, path).table("commits").collect())
    assert run() == 0  # a clone without commits
    commit("one")
    commit("two\n\nwith a body")
    assert run() == 2 and subjects() == ["one", "two"]
    commit("three")
    assert run() == 1 and run() == 0 and subjects() == ["one", "three", "two"]
    # History that was rewritten: the place is unknown, so all is read, and what is stored stays as it is.
    git("checkout", "-q", "--orphan", "new")
    commit("four")
    git("branch", "-q", "-D", "main")
    git("reflog", "expire", "--expire=now", "--all")
    git("gc", "-q", "--prune=now")
    assert run() == 1 and subjects() == ["four", "one", "three", "two"]


def test_times():
    utc = lambda *parts: datetime(*parts, tzinfo=UTC)
    assert follow.moment("2024-02-01T09:30:00.000+0900") == utc(2024, 2, 1, 0, 30) == follow.moment("2024-02-01T00:30:00Z") == follow.moment("2024-02-01T00:30:00")
    assert follow.moment("2024-02-01") == utc(2024, 2, 1) and follow.moment("soon") is follow.moment(None) is follow.moment("") is None
