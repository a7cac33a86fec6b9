"""Store, engine, command line and HTTP service on a small file."""

import io
import json
import threading
import urllib.error
import urllib.request

import pytest

from brindle.cli import arguments, run_queries
from brindle.engine import Engine
from brindle.plans.syntax import QueryError, parse
from brindle.server import BASE, Service, make_server
from brindle.session import run_dir, shared_dir
from brindle.sources.store import StoreError, read_rejects, read_triples, valid_name

FILE = """# a delivery
<a> <p> <b> .
<a> <p> <b> .
<b> <p>\t"x y." .

<b> <q> "z"@en
<b> <p .
<c> <q> _:n.\r
"""


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("service")
    (root / "data.nt").write_text(FILE, newline="")
    engine = Engine(spark, str(root / "databases"))
    engine.file = str(root / "data.nt")
    assert engine.create("one", engine.file) == {"triplets": 5, "triples": 4, "predicates": 2, "entities": 6}
    return engine


def test_text_files(spark, engine):
    assert {tuple(r) for r in read_triples(spark, engine.file).collect()} == {("<a>", "<p>", "<b>"), ("<b>", "<p>", '"x y."'), ("<b>", "<q>", '"z"@en'), ("<c>", "<q>", "_:n")}
    assert [tuple(r) for r in read_rejects(spark, engine.file).collect()] == [("<b> <p .", "quoting")]


def test_catalogue(engine):
    assert engine.store.list() == ["one"]
    assert {r.p: (r.rows, r.subjects, r.objects) for r in engine.store.predicate_statistics("one").collect()} == {"<p>": (2, 2, 2), "<q>": (2, 2, 2)}
    for name in ("", "../x", "a/b", ".x", None):
        with pytest.raises(StoreError):
            valid_name(name)
    with pytest.raises(StoreError):
        engine.query("none", "SELECT ?s WHERE { ?s <p> ?o }")


def test_answers(engine):
    answer = engine.answer("one", "SELECT ?s ?o WHERE { ?s <p> <b> . <b> ?q ?o }")
    assert answer.variables == ["s", "o"] and sorted(answer.rows) == [["<a>", '"x y."'], ["<a>", '"z"@en']] and answer.total_ms > 0
    with pytest.raises(QueryError):
        engine.answer("one", "SELECT")


def test_partition_of_a_predicate_is_pruned(engine):
    engine.store.create("heavy", engine.query("one", "SELECT * WHERE { ?s ?p ?o }"), heavy_rows=2)
    plan = engine.query("heavy", "SELECT ?s WHERE { ?s <p> <b> }")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(part" in plan and "EqualTo(o,<b>)" in plan and "/pos]" in plan
    assert engine.delete("heavy") and not engine.delete("heavy")


def test_preloaded_predicates_and_export(spark, engine, tmp_path):
    text = "SELECT ?s ?o WHERE { ?s <p> <b> . <b> <q> ?o }"
    before = engine.answer("one", text).rows
    engine.graph("one").preload(["<p>", "<p>", "<none>"])
    assert "InMemoryTableScan" in engine.query("one", text)._jdf.queryExecution().toString() and engine.answer("one", text).rows == before
    engine.close("one")
    assert "InMemoryTableScan" not in engine.query("one", text)._jdf.queryExecution().toString()
    engine.store.export("one", str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4


def test_command_line(engine):
    args = arguments().parse_args(["build", "--database", "x", "-f", "y"])
    assert (args.command, args.db, args.file) == ("build", "x", "y")
    assert arguments().parse_args(["server", "-p", "80"]).ip == "127.0.0.1"
    with pytest.raises(SystemExit):
        arguments().parse_args(["query", "--db", "x"])
    out = io.StringIO()
    run_queries(engine, "one", ["SELECT ?o WHERE { <a> <p> ?o }\n", "\n", "SELECT ?o WHERE { <b> <p> ?o } LIMIT 5\n"], out)
    text = out.getvalue()
    assert "<b>\nrows: 1\nplan: " in text and '"x y."\nrows: 1\n' in text and text.count("total: ") == 2


class Client:
    def __init__(self, server):
        self.base = f"http://127.0.0.1:{server.server_address[1]}{BASE}"

    def __call__(self, path, body=None, kind="application/json"):
        data = body if isinstance(body, bytes) or body is None else json.dumps(body).encode()
        request = urllib.request.Request(f"{self.base}/{path}", data, {"Content-Type": kind} if data is not None else {})
        try:
            with urllib.request.urlopen(request, timeout=120) as response:
                self.headers = response.headers
                return response.status, json.loads(response.read())
        except urllib.error.HTTPError as error:
            return error.code, json.loads(error.read())


def started(engine, folder, name=None):
    server = make_server(engine, port=0, name=name, folder=str(folder))
    thread = threading.Thread(target=server.serve_forever, daemon=True)
    thread.start()
    return server, thread, Client(server)


QUERY = "sparql?query=SELECT%20%3Fo%20WHERE%20%7B%20%3Ca%3E%20%3Cp%3E%20%3Fo%20%7D"


def test_http(engine, tmp_path):
    server, thread, call = started(engine, tmp_path)
    assert call(QUERY)[0] == 409
    assert call("list") == (200, {"data": ["one"]}) and call("info") == (200, {"data": {}})
    assert call("create", {})[1]["code"] == 5 and call("create", {"db_name": "two"})[1]["code"] == 6
    assert call("create", {"db_name": "two", "file_name": engine.file})[1]["code"] == 1
    assert call("load_db", {})[1]["code"] == 2 and call("load_db", {"db_name": "two"})[1]["code"] == 1
    assert call("load_db", {"db_name": "two"})[1]["code"] == 3
    status, body = call(QUERY)
    assert status == 200 and body["head"]["vars"] == ["o"] and body["results"]["bindings"] == [["<b>"]] and body["results"]["binding_cnt"] == 1
    assert body["results"]["time_cost"] > 0 and call.headers["Access-Control-Allow-Origin"] == "*" and "sparql-results+json" in call.headers["Content-Type"]
    assert call("sparql?query=nonsense")[0] == 400 and call("nothing")[0] == 404 and call("create", b"[1]")[0] == 400
    assert call("info")[1]["data"] == {"triplets": 5, "predicates": 2, "entities": 6}
    assert call("delete", {})[1]["code"] == 2 and call("delete", {"db_name": "../one"})[1]["code"] == 3 and call("delete", {"db_name": "one2"})[1]["code"] == 3
    assert call(QUERY)[0] == 200
    assert call("delete", {"db_name": "two"})[1]["code"] == 1 and call(QUERY)[0] == 409
    form = b'--x\r\nContent-Disposition: form-data; name="rdf_file"; filename="../../a b.nt"\r\nContent-Type: text/plain\r\n\r\n<a> <p> <b> .\n\r\n--x--\r\n'
    status, body = call("upload", form, "multipart/form-data; boundary=x")
    assert (body["code"], body["size"]) == (1, 14) and (tmp_path / "a_b.nt").read_text() == "<a> <p> <b> .\n"
    assert call("upload", b"--x--\r\n", "multipart/form-data; boundary=x")[1]["code"] == 4
    assert call("close")[1]["code"] == 1 and call("disconnect")[1]["code"] == 1
    thread.join(30)
    assert not thread.is_alive()
    server.server_close()


def test_http_with_one_database(engine, tmp_path):
    server, thread, call = started(engine, tmp_path, "one")
    assert call(QUERY)[1]["results"]["bindings"] == [["<b>"]] and call("list")[0] == 404
    call("disconnect")
    thread.join(30)
    server.server_close()


def test_a_database_may_be_built_from_the_one_it_replaces(spark, engine):
    engine.store.create("copy", engine.query("one", "SELECT * WHERE { ?s ?p ?o }"))
    assert engine.store.create("copy", engine.store.open("copy").scan(parse("SELECT ?s WHERE { ?s <p> ?o }").patterns[0]))["triples"] == 2
    assert engine.store.list() == ["copy", "one"] and sorted(engine.answer("copy", "SELECT ?s WHERE { ?s ?p ?o }").rows) == [["<a>"], ["<b>"]]
    with pytest.raises(Exception):  # noqa: B017
        engine.store.create("copy", spark.range(2).selectExpr("cast(raise_error('x') as string) as s", "'p' as p", "'o' as o"))
    assert engine.store.info("copy")["triples"] == 2 and engine.delete("copy")


def test_answers_are_streamed(engine):
    variables, rows = engine.stream("one", "SELECT ?s ?p ?o WHERE { ?s ?p ?o }")
    assert variables == ["s", "p", "o"] and next(rows) and len(list(rows)) == 3
    pieces = list(Service(engine, "one").sparql("SELECT ?s WHERE { ?s <p> ?o }")[1])
    assert len(pieces) == 3 and json.loads("".join(pieces))["results"]["binding_cnt"] == 2
    empty = json.loads("".join(Service(engine, "one").sparql("SELECT ?s WHERE { ?s <none> ?o }")[1]))
    assert empty["results"]["bindings"] == [] and empty["head"]["vars"] == ["s"]


def test_shared_folders(spark):
    assert run_dir(spark, "x") != run_dir(spark, "x")

    class Cluster:
        class conf:
            get = staticmethod(lambda name, default=None: default)

        class sparkContext:
            master = "spark://host:7077"
            getConf = staticmethod(lambda: {})

    with pytest.raises(ValueError):
        shared_dir(Cluster)
