"""The HTTP service: databases and queries as JSON.

One Spark session serves all requests; which database is current is guarded by a lock. With a fixed database only queries
and the disconnect request are offered.
"""

from __future__ import annotations

import json
import os
import re
import threading
from collections.abc import Iterator
from email.parser import BytesParser
from email.policy import HTTP
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from itertools import chain
from time import perf_counter
from urllib.parse import parse_qs, urlsplit

from brindle.plans.syntax import QueryError
from brindle.sources.store import StoreError

#: Path before the names of all requests; a client of another service may set its own.
BASE = os.environ.get("BRINDLE_BASE_URL", "/api")

#: Bytes of the largest upload.
MOST_BYTES = 1 << 30

# The codes that clients of this interface know; its requests and fields are named below as they expect them.
OK, NO_NAME, LOADED, NO_UPLOAD, NO_CREATE_NAME, NO_CREATE_FILE = 1, 2, 3, 4, 5, 6


class Service:
    """The state behind the requests and their answers, apart from HTTP."""

    def __init__(self, engine, fixed: str | None = None, folder: str | None = None):
        self.engine, self.fixed, self.folder = engine, fixed, folder or f"{engine.store.root}/.uploads"
        self.lock = threading.Lock()
        self.current = fixed
        if fixed:
            engine.graph(fixed)

    def sparql(self, text: str) -> tuple[int, dict | Iterator[str]]:
        """The answer of a query as pieces of JSON: head.vars, results.bindings as lists of strings, their number, and
        milliseconds. The rows are sent as they come, so an answer may have any size."""
        with self.lock:
            name = self.current
        if not name:
            return 409, {"message": "no database is loaded"}
        began = perf_counter()
        try:
            variables, rows = self.engine.stream(name, text)
        except QueryError as error:
            return 400, {"message": str(error)}
        return 200, self._pieces(variables, rows, began)

    @staticmethod
    def _pieces(variables: list[str], rows: Iterator[list[str | None]], began: float) -> Iterator[str]:
        head, count = f'{{"head": {json.dumps({"vars": variables}, ensure_ascii=False)}, "results": {{"bindings": [', 0
        for row in rows:
            yield (head if not count else ",\n") + json.dumps(row, ensure_ascii=False)
            count += 1
        yield f'{"" if count else head}], "binding_cnt": {count}, "time_cost": {(perf_counter() - began) * 1e3}}}}}'

    def create(self, body: dict) -> tuple[int, dict]:
        if not body.get("db_name"):
            return 200, {"code": NO_CREATE_NAME, "message": "db_name is missing"}
        if not body.get("file_name"):
            return 200, {"code": NO_CREATE_FILE, "message": "file_name is missing"}
        self.engine.create(body["db_name"], body["file_name"])
        return 200, {"code": OK, "message": f"{body['db_name']} is created"}

    def load(self, body: dict) -> tuple[int, dict]:
        name = body.get("db_name")
        if not name:
            return 200, {"code": NO_NAME, "message": "db_name is missing"}
        with self.lock:
            if name == self.current:
                return 200, {"code": LOADED, "message": f"{name} is loaded already"}
        self.engine.graph(name)
        with self.lock:
            self.current = name
        return 200, {"code": OK, "message": f"{name} is loaded"}

    def close(self) -> tuple[int, dict]:
        with self.lock:
            if self.current:
                self.engine.close(self.current)
            self.current = None
        return 200, {"code": OK, "message": "the database is closed"}

    def delete(self, body: dict) -> tuple[int, dict]:
        name = body.get("db_name")
        if not name:
            return 200, {"code": NO_NAME, "message": "db_name is missing"}
        try:
            gone = self.engine.delete(name)
        except StoreError:
            gone = False
        if not gone:
            return 200, {"code": LOADED, "message": f"{name} can't be deleted"}
        with self.lock:
            if self.current == name:
                self.current = None
        return 200, {"code": OK, "message": f"{name} is deleted"}

    def list(self) -> tuple[int, dict]:
        return 200, {"data": self.engine.store.list()}

    def info(self) -> tuple[int, dict]:
        with self.lock:
            name = self.current
        known = self.engine.store.info(name) if name else {}
        return 200, {"data": {k: known[k] for k in ("triplets", "predicates", "entities") if k in known}}

    def upload(self, files: dict[str, tuple[str, bytes]]) -> tuple[int, dict]:
        """Keep the file of the part ``rdf_file`` under its bare name in the upload folder."""
        if "rdf_file" not in files:
            return 200, {"code": NO_UPLOAD, "message": "no file was sent"}
        sent, data = files["rdf_file"]
        name = re.sub(r"[^A-Za-z0-9_.-]", "_", os.path.basename(sent.replace("\\", "/"))).lstrip(".") or "upload"
        return 200, {"code": OK, "message": f"{name} is saved", "file_name": self.engine.store.upload(self.folder, name, data), "size": len(data)}


def handler(service: Service, origin: str = "*", base: str = BASE) -> type[BaseHTTPRequestHandler]:
    class Handler(BaseHTTPRequestHandler):
        def answer(self, status: int, pieces: dict | Iterator[str], kind: str = "text/plain") -> None:
            """Send the first piece with the head, the others behind it; the end of the connection ends the answer."""
            whole = json.dumps(pieces, indent=2, ensure_ascii=False) if isinstance(pieces, dict) else None
            rest = iter(()) if whole is not None else pieces
            first = (whole if whole is not None else next(rest)).encode()
            self.send_response(status)
            self.send_header("Content-Type", f"{kind};charset=utf-8")
            if whole is not None:
                self.send_header("Content-Length", str(len(first)))
            for name, value in (("Origin", origin), ("Methods", "POST, GET, OPTIONS"), ("Headers", "*")):
                self.send_header(f"Access-Control-Allow-{name}", value)
            self.end_headers()
            self.wfile.write(first)
            for piece in rest:
                self.wfile.write(piece.encode())

        def body(self) -> bytes:
            size = int(self.headers.get("Content-Length") or 0)
            if size > MOST_BYTES:
                raise ValueError(f"more than {MOST_BYTES} bytes were sent")
            return self.rfile.read(size)

        def json(self) -> dict:
            body = json.loads(self.body() or b"{}")
            if not isinstance(body, dict):
                raise ValueError("the body must be an object")
            return body

        def files(self) -> dict[str, tuple[str, bytes]]:
            head = f"Content-Type: {self.headers.get('Content-Type', '')}\r\n\r\n".encode()
            message = BytesParser(policy=HTTP).parsebytes(head + self.body())
            parts = message.iter_parts() if message.is_multipart() else []
            return {p.get_param("name", header="content-disposition"): (p.get_filename() or "", p.get_payload(decode=True) or b"") for p in parts}

        def route(self, method: str) -> None:
            url = urlsplit(self.path)
            name = url.path.removeprefix(f"{base}/") if url.path.startswith(f"{base}/") else ""
            kind = "application/sparql-results+json" if name == "sparql" else "text/plain"
            try:
                if (method, name) == ("GET", "sparql"):
                    out = service.sparql(parse_qs(url.query).get("query", [""])[0])
                elif (method, name) == ("GET", "disconnect"):
                    out = 200, {"code": OK, "message": "the server stops"}
                    threading.Thread(target=self.server.shutdown, daemon=True).start()
                elif service.fixed:
                    out = 404, {"message": "not offered"}
                elif method == "GET" and name in ("list", "info", "close"):
                    out = getattr(service, name)()
                elif method == "POST" and name in ("create", "delete"):
                    out = getattr(service, name)(self.json())
                elif (method, name) == ("POST", "load_db"):
                    out = service.load(self.json())
                elif (method, name) == ("POST", "upload"):
                    out = service.upload(self.files())
                else:
                    out = 404, {"message": "not offered"}
                if not isinstance(out[1], dict):
                    out = out[0], chain([next(out[1])], out[1])  # a job that fails at once is an error, not half an answer
            except ValueError as error:
                out = 400, {"message": str(error)}
            except Exception as error:  # a failed job must not end the service
                out = 500, {"message": str(error)[:500]}
            self.answer(*out, kind)

        def do_GET(self) -> None:
            self.route("GET")

        def do_POST(self) -> None:
            self.route("POST")

        def do_OPTIONS(self) -> None:
            self.answer(200, {})

        def log_message(self, form: str, *args) -> None:
            pass

    return Handler


def make_server(engine, ip: str = "127.0.0.1", port: int = 8080, name: str | None = None, origin: str = "*", folder: str | None = None) -> ThreadingHTTPServer:
    """A server that isn't running yet; port 0 takes any free one."""
    return ThreadingHTTPServer((ip, port), handler(Service(engine, name, folder), origin))


def serve(engine, ip: str = "127.0.0.1", port: int = 8080, name: str | None = None, origin: str = "*") -> None:
    with make_server(engine, ip, port, name, origin) as server:
        server.serve_forever()
