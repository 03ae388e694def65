"""The searches over HTTP, as JSON: ``serve(spark, index)``."""

from __future__ import annotations

import json
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import SparkSession

from .__main__ import find, parser, run

#: Path, command, and which of the parameters it has to have.
ROUTES = {
    "/api/stats": ("stats", ()),
    "/api/info": ("info", ()),
    "/api/search": ("search", ("q",)),
    "/api/authors": ("authors", ("q",)),
    "/api/authors/similar": ("similar-authors", ("author",)),
    "/api/references": ("references", ("q",)),
    "/api/document": ("document", ("repo", "id")),
    "/api/document/references": ("document-references", ("repo", "id")),
    "/api/document/similar_refs": ("similar-references", ("repo", "id")),
}


def whole(value: str | None, default: int | None = None) -> int | None:
    """A number, or the default where there is none or it can't be read."""
    try:
        return int(value) if value is not None and value.strip() else default
    except ValueError:
        return default


def text(value: str | None) -> str | None:
    """Trimmed; none for blank and for the words that clear a filter."""
    value = (value or "").strip()
    return value if value.lower() not in ("", "all", "todos", "none", "*") else None


def answer(spark: SparkSession, index: str, target: str) -> tuple[int, dict]:
    """(status, body) of a request for ``target``: path and query."""
    parts = urlsplit(target)
    if parts.path not in ROUTES:
        return 404, {"error": "no such path"}
    command, needed = ROUTES[parts.path]
    given = {k: v[-1] for k, v in parse_qs(parts.query).items()}
    if missing := [k for k in needed if not text(given.get(k))]:
        return 400, {"error": f"missing: {', '.join(missing)}"}
    top, offset = max(1, whole(given.get("top"), 10)), max(0, whole(given.get("offset"), 0))
    began = time.time()
    try:
        if command in ("search", "info"):
            args = ["--index", index, command]
            if command == "search":
                args += [given["q"], "-k", str(top), "--offset", str(offset)]
                args += [x for flag, key in (("--repo", "repo"), ("--type", "type"), ("--keyword", "keyword")) if text(given.get(key)) for x in (flag, text(given[key]))]
                args += [x for flag, key in (("--year-min", "year_min"), ("--year-max", "year_max")) if whole(given.get(key)) is not None for x in (flag, str(whole(given[key])))]
            rows = run(spark, parser().parse_args(args))
        else:
            key = f"{text(given.get('repo'))}:{text(given.get('id'))}" if "id" in needed else None
            rows = find(spark, command, index, q=given.get("q"), author=given.get("author"), key=key, top=top, offset=offset, repo=None if key else text(given.get("repo")))
        found = [json.loads(x) for x in rows.toJSON().collect()]
    except Exception as e:  # noqa: BLE001  a table that isn't built, for one
        return 500, {"error": str(e).splitlines()[0]}
    return 200, {"offset": offset, "total_hits": len(found), "has_more": any(r.get("has_more") for r in found), "hits": found, "time_ms": round((time.time() - began) * 1000, 2)}


def serve(spark: SparkSession, index: str, port: int = 8000, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    """A server, not yet running: call ``serve_forever``."""

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802  the base class's name
            status, body = answer(spark, index, self.path)
            data = json.dumps(body, ensure_ascii=False).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *_):
            pass

    return ThreadingHTTPServer((host, port), Handler)
