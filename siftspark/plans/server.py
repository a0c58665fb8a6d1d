"""The tools of an archive over HTTP and as a tool server on standard input and output.

Both map JSON to ``plans.ask.tools``; a request that is wrong gets an error, never a stack trace. Spark runs the queries
of several requests at once, so the HTTP server has a thread for each.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import BinaryIO
from urllib.parse import parse_qs, urlsplit

from .ask import call

Tools = dict[str, Callable[[dict], dict]]
_TEXT, _NUMBER, _FLAG = {"type": "string"}, {"type": "integer"}, {"type": "boolean"}
_SEARCH = {"query": _TEXT, "k": _NUMBER, "lane": _TEXT, "after": _TEXT, "before": _TEXT}
#: What each tool takes: description, properties, required ones. Fixed names.
SCHEMAS = {
    "ask": ("Search the archive and, where a generator runs, answer from the hits.", _SEARCH | {"hits_only": _FLAG}, ["query"]),
    "hybrid_search": ("Search the archive.", _SEARCH | {"fts_only": _FLAG}, ["query"]),
    "get_thread": ("The messages of a thread, or one message.", {"thread_id": _TEXT, "message_id": _TEXT}, []),
    "get_message": ("One message with its text.", {"message_id": _TEXT}, ["message_id"]),
    "draft_reply": ("Keep a draft of a reply; nothing is sent.", {"message_id": _TEXT, "text": _TEXT, "send": _FLAG}, ["message_id"]),
}
#: Largest body of a request.
MOST_BYTES = 1 << 20


def schemas(found: Tools) -> list[dict]:
    """Name, description and JSON schema of each tool there is."""
    return [
        {"name": name, "description": said, "inputSchema": {"type": "object", "properties": properties, "required": required}}
        for name, (said, properties, required) in SCHEMAS.items()
        if name in found
    ]


def missing(name: str, arguments: dict) -> str | None:
    lacking = [x for x in SCHEMAS[name][2] if not str(arguments.get(x) or "").strip()] if name in SCHEMAS else []
    return f"{', '.join(lacking)} is needed" if lacking else None


def dispatch(found: Tools, name: str, arguments: object) -> dict:
    """The tool's result, or ``{"error": ...}``."""
    if not isinstance(arguments, dict):
        return {"error": "arguments are an object"}
    lack = missing(name, arguments)
    return {"error": lack} if lack else call(found, name, arguments)


# --- HTTP -----------------------------------------------------------------------------------------


def respond(found: Tools, method: str, target: str, body: bytes = b"") -> tuple[int, dict]:
    """Status and answer: GET ``/health``, ``/ask?q=``, ``/message?id=``, and ``/ui`` for a page; POST of a tool's arguments to ``/<tool>``."""
    parts = urlsplit(target)
    if method == "GET":
        first = {k: v[0] for k, v in parse_qs(parts.query).items()}
        if parts.path == "/ui":
            return 200, {"page": PAGE}
        if parts.path in ("/", "/health"):
            return 200, {"ok": True, "tools": [s["name"] for s in schemas(found)]}
        gets = {"/ask": ("ask", {"query": first.get("q") or first.get("query")}), "/message": ("get_message", {"message_id": first.get("id") or first.get("message_id")})}
        name, arguments = gets.get(parts.path, (None, None))
    elif method == "POST":
        try:
            arguments = json.loads(body or b"{}")
        except ValueError:
            return 400, {"error": "the body is not JSON"}
        name = parts.path.strip("/")
        if isinstance(arguments, dict) and "q" in arguments:
            arguments.setdefault("query", arguments.pop("q"))
    else:
        return 405, {"error": f"no method {method}"}
    if name not in found:
        return 404, {"error": "not found"}
    answer = dispatch(found, name, arguments)
    failed = answer.pop("failed", False)
    return (500 if failed else 400 if "error" in answer else 200), answer


#: A page that asks and shows the citations; it loads nothing from elsewhere.
PAGE = """<!doctype html><meta charset="utf-8"><title>siftspark</title>
<form id="f"><input id="q" size="60" placeholder="Ask the archive" autofocus><button>Ask</button></form><pre id="a"></pre>
<script>
document.getElementById("f").onsubmit = async (e) => {
  e.preventDefault();
  const out = document.getElementById("a");
  out.textContent = "...";
  const said = await (await fetch("/ask?q=" + encodeURIComponent(document.getElementById("q").value))).json();
  out.textContent = said.error || [said.answer, ...(said.citations || []).map((c) => "- " + c)].filter(Boolean).join("\\n");
};
</script>"""


def http_server(found: Tools, host: str = "127.0.0.1", port: int = 8765) -> ThreadingHTTPServer:
    """A server that is ready for ``serve_forever``."""

    class Handler(BaseHTTPRequestHandler):
        def _answer(self) -> None:
            size = int(self.headers.get("Content-Length") or 0)
            if size > MOST_BYTES:
                status, said = 413, {"error": "the body is too large"}
            else:
                status, said = respond(found, self.command, self.path, self.rfile.read(size))
            page = said.get("page") if self.path.split("?")[0] == "/ui" else None
            raw = page.encode() if page else json.dumps(said, default=str, ensure_ascii=False).encode()
            self.send_response(status)
            self.send_header("Content-Type", f"{'text/html' if page else 'application/json'}; charset=utf-8")
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        do_GET = do_POST = do_PUT = do_DELETE = _answer

        def log_message(self, *_: object) -> None:
            """Requests hold what people ask; they are not logged."""

    return ThreadingHTTPServer((host, port), Handler)


# --- tool server ----------------------------------------------------------------------------------


def tool_answer(found: Tools, request: dict) -> dict | None:
    """The JSON-RPC answer to one request; none to a notification."""
    method, params = request.get("method"), request.get("params") or {}
    said: dict = {"jsonrpc": "2.0", "id": request.get("id")}
    if method in ("initialized", "notifications/initialized"):
        return None if request.get("id") is None else said | {"result": {}}
    if method == "initialize":
        about = {"protocolVersion": "2024-11-05", "capabilities": {"tools": {}}, "serverInfo": {"name": "siftspark", "version": "1"}}
        return said | {"result": about}
    if method == "tools/list":
        return said | {"result": {"tools": schemas(found)}}
    if method != "tools/call":
        return said | {"error": {"code": -32601, "message": "method not found"}}
    got = dispatch(found, params.get("name"), params.get("arguments") or {})
    if "error" in got:
        return said | {"error": {"code": -32000, "message": got["error"]}}
    text = json.dumps(got, default=str, ensure_ascii=False)
    return said | {"result": {"content": [{"type": "text", "text": text}]}}


def read_request(source: BinaryIO) -> dict | None:
    """The next request: a line of JSON, or a header with its length and then so many bytes. None at the end."""
    line = source.readline()
    while line and not line.strip():
        line = source.readline()
    if not line:
        return None
    name, _, value = line.partition(b":")
    if name.strip().lower() != b"content-length":
        return json.loads(line)
    while line.strip():
        line = source.readline()
    return json.loads(source.read(int(value)))


def serve_tools(found: Tools, source: BinaryIO, target: BinaryIO) -> int:
    """Answers requests until the source ends."""
    while True:
        try:
            request = read_request(source)
        except ValueError:
            answer = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "not JSON"}}
        else:
            if request is None:
                return 0
            answer = tool_answer(found, request)
        if answer is not None:
            raw = json.dumps(answer, ensure_ascii=False).encode()
            target.write(b"Content-Length: %d\r\n\r\n" % len(raw) + raw)
            target.flush()
