"""The graph service: routes over a triple table, as a function and as a small HTTP server.

Every answer is a query; rows reach the driver only as the page that is asked for, at most MAX_ROWS of them. Repeated
questions are answered from a bounded cache of their JSON; concurrent equal questions wait for one computation. Downloads
of the whole graph are sent line by line, as the driver gets them, and not kept.
"""

from __future__ import annotations

import json
import threading
from collections import OrderedDict
from collections.abc import Iterator
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, unquote, urlsplit

from pyspark.sql import DataFrame

from .functions import vocabulary as V
from .plans import graph_query as Q
from .plans.sparql import sparql
from .sources.writers import jsonld, ntriples

CATALOGUE = {name: V.CLASSES[name] for name in ("peptide", "complex", "cargo", "gene", "inhibitor", "cell_line", "subcellular", "mechanism", "experiment", "document")}
BY_SUBCLASS = [V.CLASSES["mechanism"], V.CLASSES["subcellular"]]
MAX_CACHE = 500
MAX_ROWS = 10_000


class Service:
    def __init__(self, triples: DataFrame, namespace: str = V.DATASET_NS):
        self.triples, self.namespace = triples, namespace
        self.cache: OrderedDict[str, object] = OrderedDict()
        self.lock, self.running = threading.Lock(), {}

    @staticmethod
    def rows(df: DataFrame) -> dict:
        """columns and rows as text; missing values are empty. more: there are other rows than these MAX_ROWS."""
        found = df.limit(MAX_ROWS + 1).collect()
        more = {"more": True} if len(found) > MAX_ROWS else {}
        found = found[:MAX_ROWS]
        return more | {"columns": df.columns, "rows": [["" if v is None else v if isinstance(v, (int, float, list)) else str(v) for v in r] for r in found]}

    def cached(self, key: str, compute):
        with self.lock:
            if key in self.cache:
                self.cache.move_to_end(key)
                return self.cache[key]
            done = self.running.get(key)
            mine = done is None
            if mine:
                done = self.running[key] = threading.Event()
        if not mine:
            done.wait()
            return self.cached(key, compute)
        try:
            value = compute()
            with self.lock:
                self.cache[key] = value
                while len(self.cache) > MAX_CACHE:
                    self.cache.popitem(last=False)
            return value
        finally:
            with self.lock:
                self.running.pop(key, None)
            done.set()

    def answer(self, path: str, args: dict[str, str] | None = None, body: dict | None = None):
        """The answer to a route: a JSON value, or text for the text routes."""
        args, body = args or {}, body or {}
        if path.startswith("/api/download/"):
            return self._answer(path, args, body)
        key = json.dumps([path, args, body], sort_keys=True)
        return self.cached(key, lambda: self._answer(path, args, body))

    def _answer(self, path: str, args: dict, body: dict):
        t = self.triples
        parts = [unquote(x) for x in path.strip("/").split("/")]
        match parts:
            case ["api", "status"]:
                return {"ready": True}
            case ["api", "metrics"]:
                return self.rows(Q.graph_metrics(t))
            case ["api", "classes"]:
                return self.rows(Q.class_counts(t, CATALOGUE, BY_SUBCLASS).orderBy("n", ascending=False))
            case ["api", "associations"]:
                return self.rows(Q.association_counts(t))
            case ["api", "search"]:
                return self.rows(Q.faceted_search(t, body.get("filters", {})))
            case ["api", "search", "preview"]:
                return {"plan": Q.preview(Q.faceted_search(t, body.get("filters", {})))}
            case ["api", "autocomplete", field]:
                if field not in CATALOGUE:
                    raise KeyError(field)
                return self.rows(Q.autocomplete(t, CATALOGUE[field], args.get("q", ""), MAX_ROWS if field in ("cell_line", "cargo") else 250))
            case ["api", "browse"]:
                page, counts = Q.browse(t, args["class"], args.get("q", ""), int(args.get("page", 1)), int(args.get("per_page", 50)), args["class"] in BY_SUBCLASS)
                return self.rows(page) | dict(zip(counts.columns, counts.first(), strict=True))
            case ["api", "sparql"]:
                return self.rows(sparql(t, body["query"]))
            case ["api", "entity", *name]:
                iri, known = Q.resolve_entity(t, "/".join(name), self.namespace).first()
                if not known:
                    raise KeyError(iri)
                return {"iri": iri, "properties": self.rows(Q.describe(t, iri)), "edges": self.rows(Q.neighbourhood(t, iri))}
            case [".well-known", "void"] | ["dataset", "void"]:
                return self.lines(ntriples(Q.void(t, self.namespace)))
            case ["dataset", *name]:
                return self.lines(Q.export(t, self.namespace + "/".join(name), args.get("format", "turtle")))
            case ["api", "download", "ttl"]:
                return self.stream(ntriples(t))
            case ["api", "download", "jsonld"]:
                return self.stream(jsonld(t))
            case ["sitemap.xml"]:
                urls = "".join(f"<url><loc>{r[0]}</loc></url>" for r in Q.sitemap(t).collect())
                return f'<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">{urls}</urlset>'
            case ["robots.txt"]:
                return "User-agent: *\nAllow: /\n"
        raise KeyError(path)

    @staticmethod
    def stream(df: DataFrame) -> Iterator[str]:
        return (f"{r[0]}\n" for r in df.toLocalIterator())

    def lines(self, df: DataFrame) -> str:
        """The lines of one entity."""
        return "".join(self.stream(df))


def serve(service: Service, port: int = 8080) -> ThreadingHTTPServer:
    """A threaded server; call serve_forever() on it."""

    class Handler(BaseHTTPRequestHandler):
        def _reply(self, body: dict | None) -> None:
            url = urlsplit(self.path)
            try:
                value, code = service.answer(url.path, {k: v[0] for k, v in parse_qs(url.query).items()}, body), 200
            except KeyError as e:
                value, code = {"error": f"not found: {e.args[0]}"}, 404
            except ValueError as e:
                value, code = {"error": str(e)}, 400
            if isinstance(value, Iterator):  # the end of the connection ends it
                self.send_response(code)
                self.send_header("Content-Type", "text/plain; charset=utf-8")
                self.end_headers()
                for line in value:
                    self.wfile.write(line.encode())
                return
            raw = (value if isinstance(value, str) else json.dumps(value)).encode()
            self.send_response(code)
            self.send_header("Content-Type", "text/plain; charset=utf-8" if isinstance(value, str) else "application/json")
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def do_GET(self) -> None:
            self._reply(None)

        def do_POST(self) -> None:
            self._reply(json.loads(self.rfile.read(int(self.headers.get("Content-Length", 0))) or b"{}"))

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer(("127.0.0.1", port), Handler)
