"""Routes, mounts and guards on graphs of small Express programs built by hand."""

import pytest
from graphsieve import Graph
from graphsieve.operators.endpoints import display_name, get_endpoints, is_frontend_path, render, resolve_code, router_mounts, routes, sink_display
from pyspark.sql import functions as F


class Program:
    """Rows of a program, written call by call."""

    def __init__(self):
        self.nodes, self.edges, self.next = [], [], 1

    def add(self, label, **columns):
        i = self.next
        self.next += 1
        self.nodes.append({"id": i, "label": label} | columns)
        return i

    def method(self, name, file, params=(), **columns):
        m = self.add("METHOD", name=name, full_name=f"{file}::program:{name}", filename=file, ast_parent_full_name=f"{file}::program", is_external=False, line=7, **columns)
        for k, p in enumerate(params, 1):
            self.add("METHOD_PARAMETER_IN", name=p, method_id=m, ord=k)
        return m

    def call(self, name, file, *args, receiver=None, method=None, full=None):
        c = self.add("CALL", name=name, method_full_name=full or name, code=f"{name}()", filename=file, method_id=method)
        if receiver is not None:
            self.edges.append((c, self.add("IDENTIFIER", name=receiver, code=receiver), "ARGUMENT", 0))
        for k, a in enumerate(args, 1):
            self.edges.append((c, a, "ARGUMENT", k))
        return c

    def text(self, value):
        return self.add("LITERAL", code=f"'{value}'")

    def ref(self, m):
        return self.add("METHOD_REF", method_full_name=self.nodes[m - 1]["full_name"])


@pytest.fixture(scope="module")
def g(spark):
    p = Program()
    home = p.method("<lambda>0", "app.js", ("req", "res"))
    guard = p.method("requireAuth", "app.js", ("req", "res", "next"))
    p.call("get", "app.js", p.text("/health"), p.ref(home), receiver="app")
    data = p.method("<lambda>1", "app.js", ("req", "res"))
    template = p.call("<operator>.formatString", "app.js", p.text("/u/"), p.add("IDENTIFIER", name="version", code="version"))
    p.call("post", "app.js", template, p.ref(guard), p.ref(data), receiver="app")
    p.call("exec", "app.js", p.text("ls"), method=data, full="child_process:exec")
    p.call("use", "app.js", p.text("/api"), p.call("require", "app.js", p.text("./routers")), receiver="app")
    p.call("use", "routers/index.js", p.text("/v1"), p.call("require", "routers/index.js", p.text("./v1")), receiver="router")
    profile = p.method("<lambda>2", "routers/v1/user.js", ("req", "res"))
    p.call("get", "routers/v1/user.js", p.text("/profile"), p.ref(profile), receiver="router")
    lost = p.method("<lambda>3", "other.js", ("req", "res"))
    p.call("get", "other.js", p.text("/lost"), p.ref(lost), receiver="router")
    front = p.method("click", "client/view.js", ("req", "res"))
    p.names = {"home": home, "data": data, "profile": profile, "lost": lost, "front": front}
    graph = Graph.of_rows(spark, p.nodes, p.edges).materialize()
    graph.names = p.names
    return graph


def test_templates_fold(g):
    values = {r["value"] for r in resolve_code(g).collect()}
    assert "/u/{version}" in values and "/health" in values


def test_mounts_nest(g):
    found = {(r["key"], r["prefix"]) for r in router_mounts(g).collect()}
    assert {("routers", "/api"), ("v1", "/api/v1")} <= found


def test_routes(g):
    found = {r["method_id"]: r["path"] for r in routes(g).collect()}
    n = g.names
    assert found[n["home"]] == "GET /health" and found[n["data"]] == "POST /u/{version}"
    assert found[n["profile"]] == "GET /api/v1/profile" and n["lost"] not in found


def test_endpoints(g):
    rows = {r["action"]: r for r in get_endpoints(g, "javascript").collect()}
    assert rows["POST /u/{version}"]["is_protected"] and not rows["GET /health"]["is_protected"]
    assert rows["POST /u/{version}"]["capabilities"] == {"Command Execution": ["child_process.exec"]}
    assert "<lambda>3 (L7)" in rows and "click" not in rows
    text = render([r.asDict() for r in rows.values()])
    assert "Guarded: requireAuth" in text and "PUBLIC?" in text


def test_names(spark):
    df = spark.createDataFrame([("a.b.C.run", "run"), ("x:C.<init>", "new"), ("<operator>.add", "add"), ("m:f(int)", "f")], "f string, n string")
    assert [r[0] for r in df.select(sink_display(F.col("f"), F.col("n"))).collect()] == ["C.run", "C", "add", "m.f"]
    paths = spark.createDataFrame([("src/client/a.ts",), ("client/a.ts",), ("server/client/a.ts",), ("src/a.ts",)], "p string")
    assert [r[0] for r in paths.select(is_frontend_path(F.col("p"))).collect()] == [True, True, False, False]
    assert display_name("a/b.js::program") == "b.js" and display_name("com.x.Users") == "Users"
