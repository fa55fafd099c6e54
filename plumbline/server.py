"""Thin shells over search: an HTTP server and the tool protocol over standard streams."""

from __future__ import annotations

import json
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import IO

from plumbline import sinks
from plumbline.catalog import Catalog
from plumbline.operators.filters import FilterError, parse
from plumbline.operators.search import SearchOptions

META = ("source",)


def options_of(body: dict) -> SearchOptions:
    """top_k 5, filter, hybrid false, hybrid_alpha 0.7. A filter that cannot be understood is left out."""
    condition = body.get("filter")
    if isinstance(condition, str):
        try:
            condition = parse(condition, strict=False)
        except FilterError:
            condition = None
    return SearchOptions(int(body.get("top_k", 5)), filter=condition, hybrid=bool(body.get("hybrid", False)), hybrid_alpha=float(body.get("hybrid_alpha", 0.7)), query_text=body["query"])


def answer(catalog: Catalog, index: str, method: str, path: str, body: dict) -> tuple[int, dict | list]:
    if method == "GET" and path == "/":
        return 200, {"name": "plumbline", "index": index, "endpoints": ["/health", "/indexes", "/info", "/search"]}
    if method == "GET" and path == "/health":
        return 200, {"status": "ok"}
    if method == "GET" and path == "/indexes":
        return 200, catalog.list()
    if method == "GET" and path == "/info":
        return 200, next((x for x in catalog.list() if x["name"] == index), {})
    if method == "POST" and path == "/search":
        if not isinstance(body.get("query"), str):
            return 400, {"error": "query is missing"}
        began = time.monotonic()
        rows = sinks.to_dicts(catalog.search(index, body["query"], options_of(body)), META)
        return 200, {"results": rows, "query": body["query"], "took_ms": int((time.monotonic() - began) * 1000)}
    return 404, {"error": "not found"}


def serve(catalog: Catalog, index: str, host: str = "127.0.0.1", port: int = 8080, cors: bool = False) -> None:
    class Handler(BaseHTTPRequestHandler):
        def _run(self) -> None:
            try:
                size = int(self.headers.get("Content-Length") or 0)
                status, data = answer(catalog, index, self.command, self.path.split("?")[0], json.loads(self.rfile.read(size) or b"{}"))
            except ValueError as e:
                status, data = 400, {"error": str(e)}
            raw = json.dumps(data, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(raw)))
            if cors:
                self.send_header("Access-Control-Allow-Origin", "*")
            self.end_headers()
            self.wfile.write(raw)

        do_GET = do_POST = _run

    ThreadingHTTPServer((host, port), Handler).serve_forever()


_TOOLS = [
    {"name": "search", "description": "Search an index", "inputSchema": {"type": "object", "required": ["index", "query"], "properties": {"index": {"type": "string"}, "query": {"type": "string"}, "top_k": {"type": "integer"}, "filter": {"type": "string"}, "hybrid": {"type": "boolean"}}}},
    {"name": "list_indexes", "description": "List all indexes", "inputSchema": {"type": "object", "properties": {}}},
]


def mcp_reply(catalog: Catalog, request: dict) -> dict | None:
    """The reply to one JSON-RPC request; None for notifications."""
    method, params = request.get("method"), request.get("params") or {}
    if "id" not in request:
        return None
    reply = {"jsonrpc": "2.0", "id": request["id"]}
    if method == "initialize":
        return reply | {"result": {"protocolVersion": "2024-11-05", "capabilities": {"tools": {}}, "serverInfo": {"name": "plumbline", "version": "0.1.0"}}}
    if method == "tools/list":
        return reply | {"result": {"tools": _TOOLS}}
    if method == "tools/call":
        own = params.get("arguments") or {}
        try:
            if params.get("name") == "list_indexes":
                text = "\n".join(f"- {x['name']} ({x['status']}, {x['passage_count']} passages)" for x in catalog.list()) or "No indexes."
            elif params.get("name") == "search":
                text = sinks.to_markdown(catalog.search(own["index"], own["query"], options_of(own)), META)
            else:
                return reply | {"error": {"code": -32602, "message": "unknown tool"}}
        except (KeyError, FileNotFoundError) as e:
            return reply | {"result": {"content": [{"type": "text", "text": f"Error: {e}"}], "isError": True}}
        return reply | {"result": {"content": [{"type": "text", "text": text}]}}
    return reply | {"error": {"code": -32601, "message": f"unknown method: {method}"}}


def mcp(catalog: Catalog, source: IO[str], sink: IO[str]) -> None:
    for line in source:
        if line.strip():
            try:
                reply = mcp_reply(catalog, json.loads(line))
            except ValueError:
                reply = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "parse error"}}
            if reply is not None:
                print(json.dumps(reply, default=str), file=sink, flush=True)
