"""The service, the prompt and the SQL form."""

import json
import threading
import urllib.error
import urllib.request

import pytest

from lumenvec import cli, service
from lumenvec.plans.compile import Sources
from lumenvec.plans.planner import Settings
from lumenvec.session import Engine
from lumenvec.sources import table_function
from lumenvec.sources.embedding import EmbeddingError, HashEmbedder, HttpEmbedder

FIND = "FIND SIMILARITY(vector, VECTOR(1.0, 0.0)) LIMIT 2"


@pytest.fixture(scope="module")
def engine(spark):
    r = spark.createDataFrame([(i, [1.0 / (i + 1), 1.0 * i], "x" if i else "y") for i in range(5)], "id long, vector array<double>, kind string")
    return Engine(spark, Sources(r), Settings(dim=2, records=5), HashEmbedder(2))


def ask(port, path, body=None, **headers):
    request = urllib.request.Request(f"http://127.0.0.1:{port}{path}", json.dumps(body).encode() if body is not None else None, {k.replace("_", "-"): v for k, v in headers.items()})
    try:
        with urllib.request.urlopen(request, timeout=60) as a:
            return a.status, a.read().decode()
    except urllib.error.HTTPError as e:
        return e.code, e.read().decode()


@pytest.fixture
def serve(engine):
    made = []

    def start(**k):
        s = service.server(engine, **k)
        threading.Thread(target=s.serve_forever, daemon=True).start()
        made.append(s)
        return s.server_address[1]

    yield start
    for s in made:
        s.shutdown()
        s.server_close()


def test_http(serve):
    seen = []
    port = serve(insert=seen.append)
    assert ask(port, "/health")[0] == 200 and ask(port, "/health/readiness")[0] == 200
    code, text = ask(port, "/query", {"query": FIND})
    body = json.loads(text)
    assert code == 200 and [r["id"] for r in body["results"]] == [0, 1] and body["total"] == 2
    assert ask(port, "/query", {"query": "nonsense"})[0] == 400
    assert ask(port, "/insert", {"id": 7, "vector": [1, 2]})[0] == 201 and seen == [{"id": 7, "vector": [1.0, 2.0], "metadata": "{}"}]
    assert ask(port, "/insert", {"id": 7})[0] == 400 and ask(port, "/other")[0] == 404
    assert "queries_total 1" in ask(port, "/metrics")[1]


def test_description_and_lines(serve):
    port = serve()
    said = json.loads(ask(port, "/openapi.json")[1])
    assert set(said["paths"]) >= {"/query", "/insert", "/health", "/metrics"} and "POST /query" in ask(port, "/docs")[1]
    code, text = ask(port, "/query", {"query": FIND}, Accept="application/x-ndjson")
    assert code == 200 and [json.loads(x)["id"] for x in text.splitlines()] == [0, 1]
    assert ask(port, "/query", {"query": "nonsense"}, Accept="application/x-ndjson")[0] == 400


def test_forgotten_addresses():
    now = [0.0]
    limit = service.RateLimit(2, 60, lambda: now[0])
    for k in range(100):
        limit.allows(f"a{k}")
    now[0] = 120
    assert limit.allows("b") and set(limit.seen) == {"b"}


def test_computed_arguments(engine):
    got = table_function.sql(engine, "SELECT count(*) AS n, ')' AS s FROM find(concat('FIND SIMILARITY(vector, VECTOR(1.0, 0.0)) ', 'LIMIT ', 1 + 2)) -- find('x')")
    assert tuple(got.first()) == (3, ")")
    near = "SIMILARITY(vector, VECTOR(1.0, 0.0)) WITH METADATA WHERE kind"
    got = table_function.sql(engine, f"SELECT a.id FROM find($$FIND {near} = 'x' LIMIT 9$$) a JOIN FIND(\"FIND {near} = 'y'\") b ON a.id <> b.id")
    assert got.count() == 4


def test_access_and_limits(serve):
    port = serve(access=service.Access(frozenset({"k"}), "s"))
    assert ask(port, "/query", {"query": FIND})[0] == 401
    assert ask(port, "/query", {"query": FIND}, X_API_Key="k")[0] == 200
    assert ask(port, "/query", {"query": FIND}, Authorization="Bearer " + service.token({"sub": "u"}, "s"))[0] == 200
    assert ask(port, "/query", {"query": FIND}, Authorization="Bearer " + service.token({"exp": 1}, "s"))[0] == 401
    assert ask(port, "/query", {"query": FIND}, Authorization="Bearer " + service.token({}, "other"))[0] == 401
    assert ask(serve(limit=service.RateLimit(0)), "/query", {"query": FIND})[0] == 429
    now = [0.0]
    limit = service.RateLimit(2, 60, lambda: now[0])
    assert [limit.allows("a") for _ in range(3)] == [True, True, False] and limit.allows("b")
    now[0] = 60
    assert limit.allows("a")


def test_prompt(engine, tmp_path):
    out = []
    (tmp_path / "f").write_text(FIND + ";\n")
    cli.run(engine, ["FIND SIMILARITY(vector, VECTOR(1.0, 0.0))\n", " LIMIT 1;\n", f":plan {FIND}\n", f":ast {FIND};\n", ":help\n", "nonsense;\n", f":load {tmp_path / 'f'}\n", ":quit\n", "never;"], out.append)
    assert out[0]["id"] == 0 and out[1].startswith("1 rows") and out[2].startswith("Limit") and out[3].startswith("Query(") and out[5].startswith("error:") and len(out) == 9


def test_sql(engine):
    df = table_function.sql(engine, f"SELECT kind, count(*) AS n FROM find($${FIND}$$) GROUP BY kind ORDER BY kind")
    assert [tuple(r) for r in df.collect()] == [("x", 1), ("y", 1)]
    assert table_function.sql(engine, "SELECT * FROM find('FIND SIMILARITY(vector, ''text'') LIMIT 3')").count() == 3


def test_http_embedder():
    from http.server import BaseHTTPRequestHandler, HTTPServer

    answers = [(500, b"{}"), (200, json.dumps({"data": [{"embedding": [1, 2]}]}).encode()), (404, b"{}")]

    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *a): ...

        def do_POST(self):
            self.rfile.read(int(self.headers["Content-Length"]))
            code, body = answers.pop(0)
            self.send_response(code)
            self.end_headers()
            self.wfile.write(body)

    s = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    e = HttpEmbedder(f"http://127.0.0.1:{s.server_address[1]}", "key", "model", pause_s=0.01)
    assert e.embed("x") == [1.0, 2.0]
    with pytest.raises(EmbeddingError, match="404"):
        e.embed("x")
    s.shutdown()
    s.server_close()
