"""Acquisition from a server and from a repository."""

import json
import subprocess
import threading
import urllib.parse
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from loamdex import cli
from loamdex.service import Settings
from loamdex.sources import acquire, bronze


def page(id_, version, space="ENG"):
    return {
        "id": id_, "title": f"Page {id_}", "space": {"key": space}, "version": {"number": version, "when": "2024-02-01T00:00:00Z"}, "ancestors": [{"title": "Home"}], "_links": {"webui": f"/pages/{id_}"},
        "history": {"createdDate": "2024-01-01T00:00:00Z", "createdBy": {"displayName": "Ann"}}, "metadata": {"labels": {"results": [{"name": "guide"}]}}, "body": {"storage": {"value": f"<p>Text of {id_}</p>"}},
    }


def issue(key, updated):
    return {"key": key, "self": f"http://x/rest/api/3/issue/{key}", "fields": {"summary": f"Issue {key}", "updated": updated, "project": {"key": key.split("-")[0]}}}


@pytest.fixture
def remote():
    state = {"pages": [page("1", 1), page("2", 1), page("../3", 1)], "issues": [issue("AB-1", "2024-01-01"), issue("AB-2", "2024-01-02")], "asked": []}

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            url = urllib.parse.urlsplit(self.path)
            q = dict(urllib.parse.parse_qsl(url.query))
            state["asked"].append((url.path, q, self.headers.get("Authorization")))
            if "jql" in q:
                n = int(q.get("nextPageToken", "0"))
                out = {"issues": state["issues"][n : n + 1]} | ({"nextPageToken": str(n + 1)} if n + 1 < len(state["issues"]) else {})
            else:
                n = int(q.get("start", "0"))
                out = {"results": state["pages"][n : n + 2], "_links": {"context": "/wiki"} | ({"next": f"/rest/api/content/search?start={n + 2}"} if n + 2 < len(state["pages"]) else {})}
            body = json.dumps(out).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    state["base"] = f"http://127.0.0.1:{server.server_port}"
    yield state
    server.shutdown()


def test_pages(spark, remote, tmp_path):
    base, path = remote["base"] + "/wiki", str(tmp_path / "pages")
    again = lambda **more: acquire.acquire_pages(spark, base, path, ["ENG"], user="ann", token="secret", **more)
    assert again(dry_run=True) == again() == {"added": 2, "modified": 0, "skipped": 0}
    assert 'space = "ENG"' in remote["asked"][0][1]["cql"] and remote["asked"][0][2].startswith("Basic ")
    assert {a[0] for a in remote["asked"]} == {"/wiki/rest/api/content/search"}
    found = {r.source_id: r for r in bronze.pages(spark, path).collect()}
    assert set(found) == {"1", "2"} and not (tmp_path / "3").exists()
    assert (found["1"].title, found["1"].author, found["1"].tags, found["1"].hierarchy, found["1"].raw_body) == ("Page 1", "Ann", ["guide"], ["Home"], "<p>Text of 1</p>")
    remote["pages"] = [page("1", 2), page("2", 1), page("4", 1)]
    assert again() == {"added": 1, "modified": 1, "skipped": 1}
    assert again(force=True) == {"added": 0, "modified": 3, "skipped": 0}


def test_issues(spark, remote, tmp_path, capsys):
    path = str(tmp_path / "issues")
    again = lambda: acquire.acquire_issues(spark, remote["base"], path, ["AB"], token="secret", days=3)
    assert again() == {"added": 2, "modified": 0, "skipped": 0}
    assert remote["asked"][0][1]["jql"] == 'project = "AB" AND updated >= "-3d" ORDER BY updated DESC' and remote["asked"][1][1]["nextPageToken"] == "1"
    assert cli.main(["acquire", "jira", remote["base"], path, "--only", "AB", "--dry-run"]) == 0
    assert json.loads(capsys.readouterr().out) == {"added": 0, "modified": 0, "skipped": 2}
    remote["issues"][0] = issue("AB-1", "2024-03-01")
    assert again() == {"added": 0, "modified": 1, "skipped": 1}
    assert sorted(r.title for r in bronze.issues(spark, path).collect()) == ["Issue AB-1", "Issue AB-2"]


def test_next_page_stays_on_the_host():
    follow = lambda link: bronze.following_page("https://a/x", "https://a/x", {"_links": {"next": link}})
    assert follow("/y?start=2") == "https://a/y?start=2" and follow("") is None
    with pytest.raises(ValueError, match="another host"):
        follow("https://b/y")


def test_repository(tmp_path):
    def git(*args):
        subprocess.run(["git", "-C", str(tmp_path / "remote"), "-c", "user.name=a", "-c", "user.email=a@b", *args], check=True, capture_output=True)

    (tmp_path / "remote").mkdir()
    git("init", "-q", "-b", "main")
    for n, text in enumerate(("one", "two")):
        (tmp_path / "remote" / "a.md").write_text(text)
        git("add", "-A")
        git("commit", "-qm", text)
        got = acquire.acquire_repo(str(tmp_path / "remote"), str(tmp_path / "clone"))
        assert got["status"] == ("updated" if n else "cloned") and (tmp_path / "clone" / "a.md").read_text() == text
        (tmp_path / "clone" / "a.md").write_text("changed by hand")
    with pytest.raises(RuntimeError, match="clone"):
        acquire.acquire_repo(str(tmp_path / "none"), str(tmp_path / "other"), token="secret")


def test_init_keeps_other_lines(tmp_path):
    file = tmp_path / "settings"
    file.write_text("# note\nLOAMDEX_RERANK=1\nOTHER=x=y\n")
    assert cli.main(["--settings", str(file), "init", "LOAMDEX_RERANK=0", "LOAMDEX_RERANK_POOL=7"]) == 0
    assert file.read_text() == "# note\nOTHER=x=y\nLOAMDEX_RERANK=0\nLOAMDEX_RERANK_POOL=7\n"
    assert (Settings.load(str(file)).rerank, Settings.load(str(file)).rerank_pool) == (False, 7)
