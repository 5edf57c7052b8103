"""Serves the tools to assistants by the Model Context Protocol: JSON-RPC 2.0, one message a line, on standard input and
output, or by HTTP, where one process serves many clients. Tools are the typed methods of `Tools`; their input schemas are derived
from the signatures."""

from __future__ import annotations

import hmac
import inspect
import json
import sys
import threading
import time
import typing
import urllib.parse
from collections.abc import Callable, Iterable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import TextIO

from pyspark.sql import DataFrame

from loamdex.service import VERSION, Service

PROTOCOL = "2024-11-05"
SCHEME = "loamdex://documents/"
#: Where the HTTP transport listens, and the largest message that it takes.
HOST, PORT, ENDPOINT, MOST_BYTES = "127.0.0.1", 8765, "/mcp", 4 << 20
LOCAL = ("127.0.0.1", "localhost", "::1")
_JSON_TYPES = {str: "string", int: "integer", float: "number", bool: "boolean"}

PROMPTS: dict[str, tuple[str, tuple[str, ...], str]] = {
    "document_qa": (
        "Answers a question from a document",
        ("query", "document_text"),
        "Answer the question from the document below alone. If the document doesn't have the answer, say that it doesn't.\n\nDocument:\n{document_text}\n\nQuestion: {query}\n",
    ),
    "summarizer": ("Sums up a document", ("document_text",), "Sum up the document below in a few clear sentences: its main points, and what follows from them.\n\nDocument:\n{document_text}\n"),
}


class NotFound(ValueError):
    pass


class BadParameters(ValueError):
    pass


def rows(df: DataFrame) -> list[dict]:
    """Pages of results, which k or limit bounds, and aggregates by source."""
    return [r.asDict(recursive=True) for r in df.collect()]


class Tools:
    """What an assistant can call. A search, and the opening of a document, are logged if the settings name a log."""

    def __init__(self, service: Service, path: str):
        self._service, self._path, self._writing = service, path, threading.Lock()

    def _log(self, **what) -> None:
        name = self._service.settings.search_log
        if name:
            with self._writing, open(name, "a", encoding="utf-8") as f:
                f.write(json.dumps({"ts": time.time(), **what}, ensure_ascii=False) + "\n")

    def _document(self, doc_id: str, compress: bool = False, max_tokens: int | None = None) -> dict:
        found = rows(self._service.get_document(doc_id, compress or max_tokens is not None, max_tokens).limit(1))
        if not found:
            raise NotFound("not_found: no such document")
        return found[0]

    def search(
        self, query: str, k: int = 10, offset: int = 0, sources: list[str] | None = None, spaces: list[str] | None = None, tags: list[str] | None = None,
        categories: list[str] | None = None, authors: list[str] | None = None, date_from: str | None = None, date_to: str | None = None, user_id: str | None = None,
    ) -> dict:
        """Searches all documents; filters narrow the hits. Gives hits with snippets, and facets."""
        began = time.perf_counter()
        where = {"sources": sources, "spaces": spaces, "tags": tags, "categories": categories, "authors": authors, "date_from": date_from, "date_to": date_to}
        hits, facets = self._service.search(query, _page(k), _page(offset, 0), user_id, **where)
        out = {"hits": rows(hits), "facets": rows(facets)}
        self._log(event="search", query=query, k=k, n_results=len(out["hits"]), top_doc_ids=[h["doc_id"] for h in out["hits"]], latency_ms=(time.perf_counter() - began) * 1000)
        return out

    def advanced_search(
        self, title: str | None = None, body: str | None = None, author: str | None = None, space: str | None = None, doc_type: str | None = None, tags: list[str] | None = None,
        categories: list[str] | None = None, date_from: str | None = None, date_to: str | None = None, k: int = 10, offset: int = 0,
    ) -> dict:
        """Searches by fields, of which all that are given must match: by relevance with title or body, else the newest first."""
        fields = {"author": author, "space": space, "doc_type": doc_type, "tags": tags, "categories": categories, "date_from": date_from, "date_to": date_to}
        return {"hits": rows(self._service.advanced_search(title, body, _page(k), _page(offset, 0), **fields))}

    def get_related(self, doc_id: str, k: int = 10) -> list:
        """Documents that are linked with this one or share its place."""
        self._document(doc_id)
        return rows(self._service.get_related(doc_id, _page(k)))

    def get_document(self, doc_id: str, compress: bool = False, max_tokens: int | None = None) -> dict:
        """A whole document; its body can be compressed, also to a number of tokens."""
        out = self._document(doc_id, compress, max_tokens)
        self._log(event="selection", doc_id=doc_id)
        return out

    def browse(self, source: str | None = None, space: str | None = None, prefix: str | None = None, limit: int = 50, offset: int = 0) -> list:
        """Titles of a source, a space or with a prefix, by id."""
        page = self._service.browse(source=source, space=space, prefix=prefix, k=_page(limit), offset=_page(offset, 0))
        return rows(page.select("title", "doc_id", "source", "space"))

    def list_sources(self) -> list:
        """Numbers of documents by source and space."""
        return rows(self._service.list_sources())

    def status(self) -> dict:
        """Numbers of documents and sources, and the version."""
        return rows(self._service.status())[0]

    def reindex(self) -> dict:
        """Builds the term index anew. Offered only where the settings allow it."""
        self._service.reindex(self._path)
        return {"status": "done"}


def _page(n: int, least: int = 1) -> int:
    if n < least:
        raise BadParameters(f"a number of rows below {least}")
    return n


def _kind(hint) -> dict:
    options = [a for a in typing.get_args(hint) if a is not type(None)]
    if typing.get_origin(hint) is list:
        return {"type": "array", "items": _kind(options[0])}
    return _kind(options[0]) if options else {"type": _JSON_TYPES[hint]}


def schema(tool: Callable) -> dict:
    """The JSON schema of a tool's parameters."""
    hints, parameters = typing.get_type_hints(tool), inspect.signature(tool).parameters
    needed = [n for n, p in parameters.items() if p.default is p.empty]
    return {"type": "object", "properties": {n: _kind(hints[n]) for n in parameters}, "required": needed, "additionalProperties": False}


def _fits(value, kind: dict) -> bool:
    if kind["type"] == "array":
        return isinstance(value, list) and all(_fits(v, kind["items"]) for v in value)
    if isinstance(value, bool):
        return kind["type"] == "boolean"
    return isinstance(value, {"string": str, "integer": int, "number": (int, float), "boolean": bool}[kind["type"]])


class Server:
    def __init__(self, service: Service, path: str):
        self.tools = Tools(service, path)
        offered = {n: getattr(self.tools, n) for n in dir(self.tools) if not n.startswith("_")}
        if not service.settings.allow_reindex:
            del offered["reindex"]
        self.offered: dict[str, Callable] = offered
        self.methods: dict[str, Callable[[dict], dict]] = {
            "initialize": self._initialize, "ping": lambda p: {}, "tools/list": self._list, "tools/call": self._call, "resources/list": lambda p: {"resources": []},
            "resources/templates/list": self._templates, "resources/read": self._read, "prompts/list": self._prompts, "prompts/get": self._prompt,
        }

    def _initialize(self, p: dict) -> dict:
        return {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}, "resources": {}, "prompts": {}}, "serverInfo": {"name": "loamdex", "version": VERSION}}

    def _list(self, p: dict) -> dict:
        return {"tools": [{"name": n, "description": inspect.getdoc(t), "inputSchema": schema(t)} for n, t in self.offered.items()]}

    def _call(self, p: dict) -> dict:
        tool = self.offered.get(p.get("name", ""))
        if tool is None:
            raise BadParameters(f"no tool {p.get('name')!r}")
        given, kinds = {n: v for n, v in (p.get("arguments") or {}).items() if v is not None}, schema(tool)
        wrong = [n for n, v in given.items() if n not in kinds["properties"] or not _fits(v, kinds["properties"][n])] + [n for n in kinds["required"] if n not in given]
        if wrong:
            raise BadParameters(f"missing, unknown or of another type: {', '.join(wrong)}")
        try:
            text, failed = json.dumps(tool(**given), ensure_ascii=False, default=str), False
        except Exception as e:  # noqa: BLE001  (a tool's failure is its result)
            text, failed = str(e).split("\n")[0], True
        return {"content": [{"type": "text", "text": text}], "isError": failed}

    def _templates(self, p: dict) -> dict:
        return {"resourceTemplates": [{"uriTemplate": SCHEME + "{doc_id}", "name": "document", "description": "A document's text", "mimeType": "text/markdown"}]}

    def _read(self, p: dict) -> dict:
        uri = str(p.get("uri", ""))
        if not uri.startswith(SCHEME):
            raise BadParameters(f"no resource {uri!r}")
        text = self.tools._document(uri.removeprefix(SCHEME))["body"]
        return {"contents": [{"uri": uri, "mimeType": "text/markdown", "text": text or ""}]}

    def _prompts(self, p: dict) -> dict:
        return {"prompts": [{"name": n, "description": d, "arguments": [{"name": a, "required": True} for a in args]} for n, (d, args, _) in PROMPTS.items()]}

    def _prompt(self, p: dict) -> dict:
        description, names, text = PROMPTS.get(p.get("name", ""), ("", (), ""))
        given = p.get("arguments") or {}
        if not names or any(n not in given for n in names):
            raise BadParameters(f"no prompt {p.get('name')!r}, or an argument of {', '.join(names)} is missing")
        return {"description": description, "messages": [{"role": "user", "content": {"type": "text", "text": text.format(**{n: given[n] for n in names})}}]}

    def handle(self, message) -> dict | None:
        """The answer to a message; none to a notification."""
        if not isinstance(message, dict) or message.get("jsonrpc") != "2.0" or not isinstance(message.get("method"), str):
            return _failure(message.get("id") if isinstance(message, dict) else None, -32600, "no JSON-RPC 2.0 request")
        if "id" not in message:
            return None
        method = self.methods.get(message["method"])
        if method is None:
            return _failure(message["id"], -32601, f"no method {message['method']!r}")
        parameters = message.get("params") or {}
        if not isinstance(parameters, dict):
            return _failure(message["id"], -32602, "parameters by name are expected")
        try:
            return {"jsonrpc": "2.0", "id": message["id"], "result": method(parameters)}
        except NotFound as e:
            return _failure(message["id"], -32002, str(e))
        except BadParameters as e:
            return _failure(message["id"], -32602, str(e))
        except Exception as e:  # noqa: BLE001
            return _failure(message["id"], -32603, str(e).split("\n")[0])

    def serve(self, lines: Iterable[str] | None = None, out: TextIO | None = None) -> None:
        """Answers until the input ends."""
        out = out or sys.stdout
        for line in lines if lines is not None else sys.stdin:
            if not line.strip():
                continue
            try:
                answer = self.handle(json.loads(line))
            except json.JSONDecodeError as e:
                answer = _failure(None, -32700, str(e))
            if answer is not None:
                out.write(json.dumps(answer, ensure_ascii=False, default=str) + "\n")
                out.flush()

    def http(self, host: str = HOST, port: int = PORT, token: str = "") -> ThreadingHTTPServer:
        """A server of HTTP, bound to its port, whose `serve_forever` answers. A message is posted to `ENDPOINT`, and its answer
        is the reply; requests run beside each other. Without a token, only this machine can be served."""
        if not token and host not in LOCAL:
            raise ValueError("a token is needed to serve other machines")
        found = ThreadingHTTPServer((host, port), type("Endpoint", (_Endpoint,), {"handled": self, "token": token, "own": host}))
        found.daemon_threads = True
        return found


class _Endpoint(BaseHTTPRequestHandler):
    handled: Server
    token, own = "", HOST
    protocol_version, timeout = "HTTP/1.1", 60

    def _refused(self) -> int | None:
        """The status of a request that isn't served. A web page that a browser has open must not reach the tools: neither by a
        foreign origin, nor by a name of its own that it has pointed at this machine."""
        if urllib.parse.urlsplit(self.path).path.rstrip("/") != ENDPOINT:
            return 404
        origin, asked = self.headers.get("Origin"), _host(f"//{self.headers.get('Host', '')}")
        if self.own in LOCAL and asked not in LOCAL:
            return 403
        if origin is not None and _host(origin) != asked and not (_host(origin) in LOCAL and asked in LOCAL):
            return 403
        if self.token and not hmac.compare_digest(self.headers.get("Authorization", "").encode(), f"Bearer {self.token}".encode()):
            return 401
        return None

    def _reply(self, status: int, answer: dict | None = None, **headers: str) -> None:
        body = b"" if answer is None else json.dumps(answer, ensure_ascii=False, default=str).encode()
        self.send_response(status)
        for name, value in headers.items():
            self.send_header(name, value)
        if answer is not None:
            self.send_header("Content-Type", "application/json")
        if status >= 400:  # the body of what is refused isn't read, so the connection can't be used again
            self.send_header("Connection", "close")
            self.close_connection = True
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)

    def do_POST(self) -> None:  # noqa: N802
        refused = self._refused()
        length = self.headers.get("Content-Length", "")
        if refused is None and not (length.isascii() and length.isdigit()):
            refused = 411
        elif refused is None and int(length) > MOST_BYTES:
            refused = 413
        elif refused is None and self.headers.get_content_type() != "application/json":
            refused = 415
        if refused is not None:
            return self._reply(refused, **({"WWW-Authenticate": "Bearer"} if refused == 401 else {}))
        try:
            message = json.loads(self.rfile.read(int(length)))
        except (UnicodeDecodeError, json.JSONDecodeError, RecursionError) as e:
            return self._reply(400, _failure(None, -32700, str(e)))
        answer = self.handled.handle(message)
        return self._reply(202) if answer is None else self._reply(200, answer)

    def _other(self) -> None:
        """There are no streams to open and no sessions to end."""
        refused = self._refused()
        self._reply(refused or 405, **({} if refused else {"Allow": "POST"}))

    do_GET = do_DELETE = do_PUT = do_OPTIONS = _other  # noqa: N815

    def log_message(self, *args) -> None:
        pass


def _host(url: str) -> str | None:
    try:
        return urllib.parse.urlsplit(url).hostname
    except ValueError:
        return None


def _failure(id_, code: int, text: str) -> dict:
    return {"jsonrpc": "2.0", "id": id_, "error": {"code": code, "message": text}}
