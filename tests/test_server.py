"""The server of the tools."""

import io
import json

import pytest

from loamdex import server, service


@pytest.fixture(scope="module")
def served(spark, tmp_path_factory):
    from loamdex.cli import demo

    path = str(tmp_path_factory.mktemp("served"))
    demo(spark, path)
    log = f"{path}/log.jsonl"
    return server.Server(service.Service.open(spark, path, settings=service.Settings(search_log=log)), path), log


def ask(s, method, **params):
    return s.handle({"jsonrpc": "2.0", "id": 1, "method": method, "params": params})


def call(s, name, **arguments):
    out = ask(s, "tools/call", name=name, arguments=arguments)["result"]
    return json.loads(out["content"][0]["text"]) if not out["isError"] else out["content"][0]["text"]


def test_protocol(served):
    s, _ = served
    assert ask(s, "initialize")["result"]["capabilities"].keys() == {"tools", "resources", "prompts"}
    tools = {t["name"]: t["inputSchema"] for t in ask(s, "tools/list")["result"]["tools"]}
    assert set(tools) == set(service.TOOLS) - {"reindex"}
    assert tools["search"]["required"] == ["query"] and tools["search"]["properties"]["tags"] == {"type": "array", "items": {"type": "string"}}
    for method, params, code in (("nothing", {}, -32601), ("tools/call", {"name": "reindex"}, -32602), ("tools/call", {"name": "search"}, -32602), ("resources/read", {"uri": "file:///etc/x"}, -32602)):
        assert ask(s, method, **params)["error"]["code"] == code
    assert ask(s, "tools/call", name="search", arguments={"query": 5})["error"]["code"] == -32602
    assert ask(s, "tools/call", name="search", arguments={"query": "a", "k": True})["error"]["code"] == -32602
    assert s.handle({"jsonrpc": "2.0", "method": "notifications/initialized"}) is None
    assert s.handle([1])["error"]["code"] == -32600
    out = io.StringIO()
    s.serve(["\n", "{\n", json.dumps({"jsonrpc": "2.0", "id": 7, "method": "ping"})], out)
    answers = [json.loads(a) for a in out.getvalue().splitlines()]
    assert answers[0]["error"]["code"] == -32700 and answers[1] == {"jsonrpc": "2.0", "id": 7, "result": {}}


def test_tools(served):
    s, log = served
    hits = call(s, "search", query="payment")["hits"]
    assert {h["doc_id"] for h in hits} == {"d0", "d2"}
    assert call(s, "search", query="payment", k=0).startswith("a number of rows")
    assert [h["doc_id"] for h in call(s, "advanced_search", title="ledger")["hits"]] == ["d2"]
    assert call(s, "get_document", doc_id="d1")["title"] == "Deployment runbook"
    assert call(s, "get_document", doc_id="none").startswith("not_found")
    assert call(s, "get_related", doc_id="none").startswith("not_found")
    assert isinstance(call(s, "get_related", doc_id="d0"), list)
    assert [r["doc_id"] for r in call(s, "browse", prefix="pay")] == ["d0"]
    assert call(s, "list_sources") == [{"source": "web", "space": "demo", "n": 3}]
    assert call(s, "status")["documents"] == 3
    with open(log) as f:
        events = [json.loads(line) for line in f]
    assert [e["event"] for e in events] == ["search", "selection"] and events[0]["n_results"] == 2


def test_resource_and_prompts(served):
    s, _ = served
    assert ask(s, "resources/read", uri="loamdex://documents/d2")["result"]["contents"][0]["text"] == "The ledger keeps every payment."
    assert ask(s, "resources/read", uri="loamdex://documents/none")["error"]["code"] == -32002
    assert [p["name"] for p in ask(s, "prompts/list")["result"]["prompts"]] == ["document_qa", "summarizer"]
    text = ask(s, "prompts/get", name="document_qa", arguments={"query": "Who? {x}", "document_text": "Ann {y}"})["result"]["messages"][0]["content"]["text"]
    assert "Who? {x}" in text and "Ann {y}" in text
    assert ask(s, "prompts/get", name="document_qa", arguments={"query": "Who?"})["error"]["code"] == -32602


def test_commands(spark, tmp_path, capsys, monkeypatch):
    from loamdex import cli

    data, other = str(tmp_path / "data"), str(tmp_path / "other")
    assert cli.main(["--data", data, "health"]) == 1
    assert cli.main(["--data", data, "demo"]) == cli.main(["--data", data, "publish", other]) == cli.main(["--data", other, "health"]) == 0
    monkeypatch.setattr("sys.stdin", io.StringIO(json.dumps({"jsonrpc": "2.0", "id": 1, "method": "tools/call", "params": {"name": "status"}})))
    capsys.readouterr()
    assert cli.main(["--data", other, "serve"]) == 0
    answer = json.loads(capsys.readouterr().out)
    assert json.loads(answer["result"]["content"][0]["text"])["documents"] == 3


def test_http(served):
    import http.client
    import threading
    from concurrent.futures import ThreadPoolExecutor

    s, _ = served
    with pytest.raises(ValueError, match="token"):
        s.http("0.0.0.0", 0)

    def post(port, message, method="POST", path="/mcp", **headers):
        c = http.client.HTTPConnection("127.0.0.1", port, timeout=60)
        c.request(method, path, message if isinstance(message, bytes) else json.dumps(message).encode(), {"Content-Type": "application/json"} | {k.replace("_", "-"): v for k, v in headers.items()})
        r = c.getresponse()
        body = r.read()
        c.close()
        return r.status, json.loads(body) if body else None

    request = lambda method, **p: {"jsonrpc": "2.0", "id": 7, "method": method, "params": p}
    with s.http(port=0) as open_, s.http("0.0.0.0", 0, "secret") as closed:
        for server_ in (open_, closed):
            threading.Thread(target=server_.serve_forever, daemon=True).start()
        port, other = open_.server_port, closed.server_port
        assert post(port, request("ping")) == (200, {"jsonrpc": "2.0", "id": 7, "result": {}})
        assert post(port, {"jsonrpc": "2.0", "method": "notifications/initialized"}) == (202, None)
        assert post(port, b"{")[1]["error"]["code"] == -32700 and post(port, b"\xff")[0] == 400
        assert post(port, [request("ping")])[1]["error"]["code"] == -32600
        assert post(port, request("nothing"))[1]["error"]["code"] == -32601
        assert [post(port, b"", m)[0] for m in ("GET", "DELETE", "PUT")] == [405] * 3 and post(port, request("ping"), path="/other")[0] == 404
        assert post(port, request("ping"), Content_Type="text/plain")[0] == 415
        # Pages of the browser: a foreign origin, and a foreign name for this machine.
        assert post(port, request("ping"), Origin="http://localhost:3000")[0] == 200
        assert post(port, request("ping"), Origin="https://evil.example")[0] == post(port, request("ping"), Origin="null")[0] == 403
        assert post(port, request("ping"), Host="evil.example", Origin="http://evil.example")[0] == 403
        c = http.client.HTTPConnection("127.0.0.1", port, timeout=60)
        c.putrequest("POST", "/mcp")
        c.putheader("Content-Length", str(server.MOST_BYTES + 1))
        c.endheaders()
        assert c.getresponse().status == 413
        # One connection, several requests; several clients at once.
        c = http.client.HTTPConnection("127.0.0.1", port, timeout=60)
        for _ in range(2):
            c.request("POST", "/mcp", json.dumps(request("ping")).encode(), {"Content-Type": "application/json"})
            assert json.loads(c.getresponse().read())["result"] == {}
        c.close()
        find = lambda q: json.loads(post(port, request("tools/call", name="search", arguments={"query": q}))[1]["result"]["content"][0]["text"])
        with ThreadPoolExecutor(4) as pool:
            found = [[h["title"] for h in r["hits"]] for r in pool.map(find, ["payments", "deploying", "ledger", "nothing"])]
        assert sorted(found[0]) == ["Ledger design", "Payment guide"] and found[1:] == [["Deployment runbook"], ["Ledger design"], []]
        assert post(other, request("ping"))[0] == post(other, request("ping"), Authorization="Bearer wrong")[0] == 401
        assert post(other, request("ping"), Authorization="Bearer secret")[0] == 200
        for server_ in (open_, closed):
            server_.shutdown()
