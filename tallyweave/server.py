"""A thin HTTP layer: ``GET /health``, ``POST /v1/parse``, ``POST /v1/match`` with JSON bodies.

Invoices come as content only: a request never names a file of the server."""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

from pyspark.sql import SparkSession

from .plans import service
from .schemas import MatcherOptions
from .sources.invoices import parse_invoices
from .sources.statements import ParseOptions


def answer(spark: SparkSession, method: str, target: str, body: bytes = b"") -> tuple[int, dict]:
    """Status and reply; the format is that of the body, else of its options, else of the query string."""
    url = urlparse(target)
    if (method, url.path) == ("GET", "/health"):
        return 200, {"status": "ok"}
    if method != "POST" or url.path not in ("/v1/parse", "/v1/match"):
        return 404, {"error": "Not found"}
    try:
        request = json.loads(body)
        options = request.get("options") or {}
        query = {k: v[0] for k, v in parse_qs(url.query).items()}
        chosen = request.get("format") or options.get("format") or query.get("format")
        how = ParseOptions(chosen, options.get("columnMapping") or {}, options.get("defaultCurrency"))
        content = request.get("content") if url.path == "/v1/parse" else request.get("statementContent")
        if not content:
            raise ValueError("Statement content is missing")
        name, statement = service.parse_text(spark, content, how)
        if url.path == "/v1/parse":
            return 200, service.parsed_report(name, statement, True)
        given = request.get("invoices")
        invoices = parse_invoices(spark, given if isinstance(given, str) else json.dumps(given))
        matching = MatcherOptions(options.get("dateToleranceDays"), options.get("feeToleranceCents", 2500), options.get("feeTolerancePercentage"))
        return 200, service.full_report(service.match_statement(statement, invoices, matching))
    except Exception as e:  # every fault of a request is the client's to read
        return 400, {"error": str(e)}


def serve(spark: SparkSession, port: int = 3000, strict: bool = False, attempts: int = 30) -> int:
    class Handler(BaseHTTPRequestHandler):
        def _reply(self) -> None:
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            status, value = answer(spark, self.command, self.path, body)
            raw = service.dumps(value).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        do_GET = do_POST = _reply

    for at in range(port, port + (1 if strict else attempts)):
        try:
            server = ThreadingHTTPServer(("127.0.0.1", at), Handler)
        except OSError:
            continue
        print(f"http://127.0.0.1:{at}", flush=True)
        server.serve_forever()
        return 0
    return 1
