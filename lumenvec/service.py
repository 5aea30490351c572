"""HTTP: POST /query, POST /insert, GET /health, /health/liveness, /health/readiness, /metrics, /openapi.json, /docs. A thin adapter for trials, on the standard library.

Answers are one JSON object, or with Accept: application/x-ndjson a line for each row as it is fetched, without deadline; keys and rate limits are checked before anything else. Errors are {"success": false, "error": ...} with 400,
401, 404 or 429.
"""

from __future__ import annotations

import base64
import hashlib
import hmac
import html
import itertools
import json
import threading
import time
from collections.abc import Callable, Iterator
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import Row

from .session import Engine


class RateLimit:
    """At most n requests from one address in a window that starts with its first."""

    def __init__(self, n: int = 100, window_s: float = 60.0, clock: Callable[[], float] = time.monotonic) -> None:
        self.n, self.window_s, self.clock, self.seen, self.swept, self.lock = n, window_s, clock, {}, clock(), threading.Lock()

    def allows(self, address: str) -> bool:
        with self.lock:
            now = self.clock()
            if now >= self.swept + self.window_s:  # addresses whose window is over are forgotten
                self.seen, self.swept = {a: x for a, x in self.seen.items() if now - x[0] < self.window_s}, now
            start, used = self.seen.get(address, (now, 0))
            if now - start >= self.window_s:
                start, used = now, 0
            self.seen[address] = (start, used + 1)
            return used < self.n


def token(claims: dict, secret: str) -> str:
    part = lambda x: base64.urlsafe_b64encode(json.dumps(x).encode()).rstrip(b"=").decode()
    body = f"{part({'alg': 'HS256', 'typ': 'JWT'})}.{part(claims)}"
    return f"{body}.{base64.urlsafe_b64encode(hmac.digest(secret.encode(), body.encode(), hashlib.sha256)).rstrip(b'=').decode()}"


def claims_of(jwt: str, secret: str) -> dict | None:
    """Of a valid, unexpired HS256 token."""
    try:
        head, body, sign = jwt.split(".")
        read = lambda x: base64.urlsafe_b64decode(x + "=" * (-len(x) % 4))
        if json.loads(read(head))["alg"] != "HS256" or not hmac.compare_digest(read(sign), hmac.digest(secret.encode(), f"{head}.{body}".encode(), hashlib.sha256)):
            return None
        claims = json.loads(read(body))
        return claims if claims.get("exp", float("inf")) > time.time() else None
    except (ValueError, KeyError, TypeError):
        return None


class Access:
    """No check, API keys, tokens, or either."""

    def __init__(self, keys: frozenset[str] = frozenset(), secret: str | None = None) -> None:
        self.keys, self.secret = keys, secret

    def allows(self, headers) -> bool:
        if not self.keys and not self.secret:
            return True
        if any(hmac.compare_digest(headers.get("X-API-Key", ""), k) for k in self.keys):
            return True
        kind, _, jwt = headers.get("Authorization", "").partition(" ")
        return bool(self.secret and kind == "Bearer" and claims_of(jwt, self.secret))


def openapi() -> dict:
    """What the service offers, in the OpenAPI form."""

    def operation(summary: str, answers: dict[str, str], required: dict | None = None, other: dict | None = None) -> dict:
        out = {"summary": summary, "responses": {code: {"description": what} for code, what in answers.items()}}
        if required:
            out["requestBody"] = {"required": True, "content": {"application/json": {"schema": {"type": "object", "properties": required | (other or {}), "required": list(required)}}}}
        return out

    refusals = {"400": "an error", "401": "unauthorized", "429": "too many requests"}
    reads = {"/health": "Whether the service runs", "/health/liveness": "Whether the service runs", "/health/readiness": "Whether its tables are there", "/metrics": "Counters", "/openapi.json": "This description", "/docs": "This description as a page"}
    record = {"id": {"type": "integer"}, "vector": {"type": "array", "items": {"type": "number"}}}
    paths = {
        "/query": {"post": operation("Run a query text", {"200": "rows, total, partial and timings", **refusals}, {"query": {"type": "string"}}, {"user_id": {}})},
        "/insert": {"post": operation("Insert a record", {"201": "inserted", **refusals}, record, {"metadata": {"type": "object"}})},
        **{path: {"get": operation(what, {"200": "ok"})} for path, what in reads.items()},
    }
    return {"openapi": "3.0.3", "info": {"title": "lumenvec", "version": "1"}, "paths": paths}


def _page(said: dict) -> str:
    lines = [f"<li><code>{method.upper()} {path}</code> {html.escape(x['summary'])}</li>" for path, methods in said["paths"].items() for method, x in methods.items()]
    return f"<!doctype html><title>{said['info']['title']}</title><h1>{said['info']['title']}</h1><ul>{''.join(lines)}</ul>"


def server(engine: Engine, insert: Callable[[dict], None] | None = None, port: int = 0, access: Access | None = None, limit: RateLimit | None = None, ready: Callable[[], dict[str, bool]] | None = None) -> ThreadingHTTPServer:
    access, limit, counts = access or Access(), limit or RateLimit(), {"queries": 0, "inserts": 0, "errors": 0}

    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *a) -> None: ...

        def answer(self, code: int, body: object, **headers: str) -> None:
            data = body.encode() if isinstance(body, str) else json.dumps(body, default=str).encode()
            self.send_response(code)
            for k, v in {"Content-Type": "text/plain" if isinstance(body, str) else "application/json", "Content-Length": str(len(data)), **headers}.items():
                self.send_header(k.replace("_", "-"), v)
            self.end_headers()
            self.wfile.write(data)

        def lines(self, rows: Iterator[Row]) -> None:
            first = next(rows, None)  # errors of the query come before the head
            self.send_response(200)
            self.send_header("Content-Type", "application/x-ndjson")
            self.end_headers()
            for r in itertools.chain([] if first is None else [first], rows):
                self.wfile.write(json.dumps(r.asDict(recursive=True), default=str).encode() + b"\n")

        def refused(self) -> bool:
            if not limit.allows(self.client_address[0]):
                self.answer(429, {"success": False, "error": "too many requests"}, Retry_After=str(int(limit.window_s)))
            elif not access.allows(self.headers):
                self.answer(401, {"success": False, "error": "unauthorized"})
            else:
                return False
            return True

        def do_GET(self) -> None:
            state = ready() if ready else {"spark": engine.spark is not None}
            if self.path in ("/health", "/health/liveness"):
                self.answer(200, {"status": "ok"})
            elif self.path == "/health/readiness":
                self.answer(200 if all(state.values()) else 503, state)
            elif self.path == "/openapi.json":
                self.answer(200, openapi())
            elif self.path == "/docs":
                self.answer(200, _page(openapi()), **{"Content-Type": "text/html"})
            elif self.path == "/metrics":
                self.answer(200, "".join(f"lumenvec_{k}_total {v}\n" for k, v in counts.items()))
            else:
                self.answer(404, {"success": False, "error": "not found"})

        def do_POST(self) -> None:
            if self.refused():
                return
            try:
                body = json.loads(self.rfile.read(int(self.headers.get("Content-Length", 0))))
                if self.path == "/query" and "application/x-ndjson" in self.headers.get("Accept", ""):
                    self.lines(engine.stream(body["query"], body.get("user_id")))
                    counts["queries"] += 1
                elif self.path == "/query":
                    result = engine.find(body["query"], body.get("user_id"))
                    counts["queries"] += 1
                    self.answer(200, {"success": True, "results": [r.asDict(recursive=True) for r in result.rows], "total": result.total, "partial": result.partial, "timings": result.timings_ms})
                elif self.path == "/insert" and insert:
                    insert({"id": int(body["id"]), "vector": [float(x) for x in body["vector"]], "metadata": json.dumps(body.get("metadata", {}))})
                    counts["inserts"] += 1
                    self.answer(201, {"success": True, "id": int(body["id"])})
                else:
                    self.answer(404, {"success": False, "error": "not found"})
            except Exception as e:
                counts["errors"] += 1
                self.answer(400, {"success": False, "error": str(e)})

    return ThreadingHTTPServer(("127.0.0.1", port), Handler)
