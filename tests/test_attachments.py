"""Attachments of pages."""

import json
import threading
import urllib.parse
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path

import pytest

from loamdex.sources import acquire, attachments, bronze


@pytest.fixture
def hosts():
    """A server below /wiki, and a storage that it redirects to."""
    state = {"files": {}, "told": {}, "got": [], "storage": []}

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            url = urllib.parse.urlsplit(self.path)
            q = dict(urllib.parse.parse_qsl(url.query))
            parts = url.path.split("/")
            if self.server is state["second"]:
                state["storage"].append(self.headers.get("Authorization"))
                return self.reply(b"stored")
            if url.path.endswith("/content/search"):
                page = lambda i, v: {"id": i, "title": i, "space": {"key": "ENG"}, "version": {"number": v}, "body": {"storage": {"value": "<p>x</p>"}}}
                return self.reply(json.dumps({"results": [page(i, state.get("version", 1)) for i in ("1", "2", "3")]}).encode())
            if url.path.endswith("/child/attachment"):
                if parts[-3] == "3":
                    return self.reply(b"{}", 403)
                names, at = sorted(state["files"].get(parts[-3], {})), int(q.get("start", 0))
                item = lambda n: {"title": n, "extensions": {"mediaType": "text/plain", "fileSize": state["told"].get(n, len(state["files"][parts[-3]][n]))}, "_links": {"download": f"/download/attachments/{parts[-3]}/{urllib.parse.quote(n, safe='')}"}}
                more = {"next": f"{url.path}?start={at + 2}"} if at + 2 < len(names) else {}
                return self.reply(json.dumps({"results": [item(n) for n in names[at : at + 2]], "_links": more}).encode())
            name = urllib.parse.unquote(parts[-1])
            state["got"].append((url.path, self.headers.get("Authorization")))
            if name == "moved.txt":
                self.send_response(302)
                self.send_header("Location", f"http://127.0.0.1:{state['second'].server_port}/x")
                self.end_headers()
                return None
            return self.reply(state["files"][parts[-2]][name], 404 if name == "gone.txt" else 200)

        def reply(self, body, code=200):
            self.send_response(code)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    for name in ("first", "second"):
        state[name] = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=state[name].serve_forever, daemon=True).start()
    state["base"] = f"http://127.0.0.1:{state['first'].server_port}/wiki"
    yield state
    state["first"].shutdown()
    state["second"].shutdown()


def test_files_of_pages(spark, hosts, tmp_path):
    path = str(tmp_path)
    # Names of raw files, names that can't be files', extensions and sizes that aren't wanted, one that is gone, one elsewhere.
    hosts["files"] = {"1": {"a b.txt": b"one", "c.ZIP": b"z", "huge.txt": b"h", "content.html": b"<p>no page</p>", "meta.json": b'{"source_id": "2", "version": 9}'}, "2": {"../../x": b"e", ".hidden": b"e", "gone.txt": b"", "moved.txt": b"stored", "big.bin2": b"12345"}}
    hosts["told"] = {"huge.txt": attachments.MOST_BYTES + 1}
    run = lambda **more: acquire.acquire_pages(spark, hosts["base"], path, ["ENG"], user="ann", token="secret", attachments=True, **more)
    stats = run()
    # Page 3's list is refused: the page is written, and counted as one failure.
    assert stats == {"added": 3, "modified": 0, "skipped": 0, "attachments_fetched": 5, "attachments_skipped": 4, "attachments_failed": 2}
    assert (tmp_path / "ENG/1/attachments/a b.txt").read_bytes() == b"one" and (tmp_path / "ENG/2/attachments/moved.txt").read_bytes() == b"stored"
    names = sorted(str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*") if p.is_file() and "attachments" in p.parts)
    assert names == ["ENG/1/attachments/a b.txt", "ENG/1/attachments/content.html", "ENG/1/attachments/meta.json", "ENG/2/attachments/big.bin2", "ENG/2/attachments/moved.txt"]
    assert {p for p, _ in hosts["got"]} == {f"/wiki/download/attachments/{n}" for n in ("1/a%20b.txt", "1/content.html", "1/meta.json", "2/gone.txt", "2/moved.txt", "2/big.bin2")}
    assert all(a.startswith("Basic ") for _, a in hosts["got"]) and hosts["storage"] == [None]  # the token stays with the server
    found = {r.source_id: json.loads(r.raw_meta) for r in bronze.pages(spark, path).collect()}
    assert set(found) == {"1", "2", "3"} and found["3"]["attachments"] == []
    assert found["1"]["attachments"][0] == {"filename": "a b.txt", "media_type": "text/plain", "file_size": 3, "local_path": "attachments/a b.txt", "url": "/download/attachments/1/a%20b.txt"}
    assert [a["local_path"] for a in found["1"]["attachments"]][1:3] == [None, "attachments/content.html"]
    # Nothing is newer; then pages are, but not their files.
    assert run() == {"added": 0, "modified": 0, "skipped": 3}
    hosts["version"], before = 2, len(hosts["got"])
    hosts["files"]["1"]["a b.txt"] = b"longer"
    stats = run()
    assert (stats["modified"], stats["attachments_present"], stats["attachments_fetched"]) == (3, 4, 1) and len(hosts["got"]) == before + 2
    assert (tmp_path / "ENG/1/attachments/a b.txt").read_bytes() == b"longer"
    assert run(force=True)["attachments_fetched"] == 5


def test_a_file_larger_than_told_is_left(hosts, tmp_path):
    hosts["files"] = {"1": {"a.txt": b"x" * 100}}
    to = tmp_path / "f" / "a.txt"
    assert not attachments.save(f"{hosts['base']}/download/attachments/1/a.txt", to, {}, 99) and list(Path(to.parent).iterdir()) == []
    assert attachments.save(f"{hosts['base']}/download/attachments/1/a.txt", to, {}, 100) and to.stat().st_size == 100


def test_addresses():
    at = lambda link: attachments.address("https://h/wiki/", link)
    assert at("/download/a") == at("/wiki/download/a") == at("download/a") == at("https://h/wiki/download/a") == "https://h/wiki/download/a"
    for link in ("https://other/a", "//other/a", "http://h/wiki/a"):
        with pytest.raises(ValueError, match="another host"):
            at(link)
