"""POST /search with {"query": text} gives {"answer": text}; a bad body gives status 400."""

from __future__ import annotations

import json
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer


def respond(body: bytes, answer: Callable[[str], str]) -> tuple[int, dict]:
    try:
        query = json.loads(body)["query"]
    except (ValueError, KeyError, TypeError):
        return 400, {"error": "send a JSON object with a query"}
    if not isinstance(query, str) or not query.strip():
        return 400, {"error": "the query is empty"}
    return 200, {"answer": answer(query)}


def make_server(answer: Callable[[str], str], host: str = "127.0.0.1", port: int = 8080) -> ThreadingHTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def do_POST(self) -> None:
            status, found = (404, {"error": "no such path"}) if self.path != "/search" else respond(self.rfile.read(int(self.headers.get("Content-Length") or 0)), answer)
            data = json.dumps(found, ensure_ascii=False).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *_) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
