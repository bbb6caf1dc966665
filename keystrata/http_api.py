"""The store's verbs over HTTP: a pure request function, and a small server around it."""

from __future__ import annotations

import json
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any
from urllib.parse import parse_qs, urlsplit

from keystrata.plans.store import Store

MAX_BODY = 10 << 20
LINE_TIMEOUT_S, BODY_TIMEOUT_S = 5, 30


class Request:
    """Parameters of a request: the query string's come before those of a JSON body."""

    def __init__(self, query: dict[str, str], body: bytes | str = b""):
        self.query = query
        try:
            parsed = json.loads(body) if body else {}
        except ValueError:
            parsed = {}
        self.fields = parsed if isinstance(parsed, dict) else {}

    def get(self, name: str) -> Any:
        return self.query[name] if name in self.query else self.fields.get(name)


Answer = tuple[int, dict]


def _bad(message: str) -> Answer:
    return 400, {"error": message}


def _put(store: Store, request: Request) -> Answer:
    key, value = request.get("key"), request.get("value")
    if not key or value is None:
        return _bad("to set a key, give a key that is not empty and a value")
    return 200, {"success": store.put(key, value)}


def _get(store: Store, request: Request) -> Answer:
    key = request.get("key")
    return (200, {"key": key, "value": store.get(key)}) if key else _bad("give the key that is meant")


def _range(store: Store, request: Request) -> Answer:
    start, end = request.get("start_key"), request.get("end_key")
    if not start or not end:
        return _bad("a range has both a start_key and an end_key")
    return 200, {"results": [{"key": k, "value": v} for k, v in store.get_range(start, end)]}


def _batch(store: Store, request: Request) -> Answer:
    keys, values = request.get("keys"), request.get("values")
    if not keys or not values:
        return _bad("a batch has keys and values, at least one of each")
    if not (isinstance(keys, list) and isinstance(values, list)):
        return _bad("in a batch, keys is one array and values another")
    if len(keys) != len(values):
        return _bad(f"a batch of {len(keys)} keys and {len(values)} values differs in length")
    return 200, {"success": True, "count": len(store.batch_put(list(zip(keys, values, strict=True))))}


def _delete(store: Store, request: Request) -> Answer:
    key = request.get("key")
    return (200, {"success": store.delete(key)}) if key else _bad("give the key that is meant")


ROUTES: dict[tuple[str, str], Callable[[Store, Request], Answer]] = {
    ("PUT", "/keys"): _put, ("GET", "/keys"): _get, ("DELETE", "/keys"): _delete, ("GET", "/keys/range"): _range, ("POST", "/keys/batch"): _batch,
}


def handle(store: Store, method: str, target: str, body: bytes | str = b"") -> Answer:
    """Status and JSON of a request. A path or method that is not routed is 404, an exception 500."""
    url = urlsplit(target)
    route = ROUTES.get((method, url.path))
    if route is None:
        return 404, {"error": f"nothing answers {method} {url.path}"}
    try:
        return route(store, Request({k: v[0] for k, v in parse_qs(url.query, keep_blank_values=True).items()}, body))
    except Exception as error:
        return 500, {"error": f"failed: {error}"}


def server(store: Store, host: str = "127.0.0.1", port: int = 0) -> ThreadingHTTPServer:
    """A server with keep-alive; ``serve_forever`` runs it, ``shutdown`` ends it."""

    class Handler(BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"
        timeout = LINE_TIMEOUT_S

        def _answer(self) -> None:
            length = (self.headers.get("Content-Length") or "0").strip()
            size = int(length) if length.isascii() and length.isdigit() else -1
            if not 0 <= size <= MAX_BODY:  # what follows can't be told from another request
                self.close_connection = True
                self._send(413 if size > MAX_BODY else 400, {"error": f"Content-Length {length!r}, where 0 to {MAX_BODY} will do"})
                return
            self.connection.settimeout(BODY_TIMEOUT_S)
            body = self.rfile.read(size)
            self.connection.settimeout(LINE_TIMEOUT_S)
            self._send(*handle(store, self.command, self.path, body))

        def _send(self, status: int, answer: dict) -> None:
            data = json.dumps(answer).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.send_header("Connection", "close" if self.close_connection else "keep-alive")
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_PUT = do_POST = do_DELETE = do_PATCH = _answer

        def log_message(self, format: str, *args: Any) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
