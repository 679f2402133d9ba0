"""Small programs through the Python frontend: what each flow rule should and should not find."""

import pytest
from graphsieve import Call, Engine, Identifier, Literal, Method, Parameter, Query, Var
from graphsieve.operators.scans import run_scans
from graphsieve.reports import sarif
from graphsieve.reports.console import ConsoleReporter, SliceReporter, tree_text, usage_text
from graphsieve.rules import library
from graphsieve.sources.python_frontend import import_python, parse

APP = '''import os, subprocess, shlex
from flask import request, Flask
from tools import run_it
app = Flask(__name__)

def unsafe(cmd):
    subprocess.call("ls " + cmd, shell=True)

def quoted(cmd):
    clean = shlex.quote(cmd)
    subprocess.call("ls " + clean, shell=True)

def constant():
    subprocess.call("ls")

def cross():
    data = request.args["q"]
    run_it(data)

class Box:
    pass

def field_hit(x):
    b = Box()
    b.prop = x
    sink(b.prop)

def field_miss(x):
    b = Box()
    b.other = x
    b.prop = 1
    sink(b.prop)

def guarded(u, c):
    check_auth(u)
    os.system(c)

def maybe(u, c):
    if u:
        check_auth(u)
    os.system(c)

def overwritten(x):
    x = "fixed"
    sink(x)

def looped(items):
    out = ""
    for i in items:
        out = out + i
    sink(out)

def formatted(x):
    sink(f"select {x}")

def same(a, b):
    pair(a, a)
    pair(a, b)

@app.route("/home")
def home_view(req):
    return unsafe(req)

@app.route("/safe")
@login_required
def safe_view(req):
    return quoted(req)

def outer():
    return home_view(1)

def recursive(n):
    return recursive(n)
'''
TOOLS = '''import subprocess

def run_it(what, shell=True):
    return subprocess.call(what, shell=shell)
'''


@pytest.fixture(scope="module")
def engine(spark):
    files = spark.createDataFrame([("app.py", APP), ("tools.py", TOOLS), ("bad.py", "def (")], "path string, content string")
    g, errors = import_python(files)
    e = Engine(spark).use_graph(g)
    e.errors = errors
    return e


def methods(engine, q):
    return sorted({(r["method"] or "").split(":")[-1] for r in engine.execute(q).collect()})


SUBPROCESS = Call(fullname=r"subprocess\.call")


def test_errors_are_rows(engine):
    assert [r["path"] for r in engine.errors.collect()] == ["bad.py"]
    assert parse("x.py", "a = 1")[2] is None


def test_flow_and_sanitizer(engine):
    q = Query.source(Parameter("cmd")) >> SUBPROCESS
    assert methods(engine, q) == ["quoted", "unsafe"]
    assert methods(engine, q.passes_not(Call(fullname=".*quote.*"))) == ["unsafe"]


def test_flow_across_files_and_calls(engine):
    q = Query.source(Identifier("request").field("args")) >> SUBPROCESS
    assert methods(engine, q) == ["run_it"]
    traced = engine.execute(q.with_trace()).collect()
    assert all(s["file"] for s in traced[0]["trace"]) and traced[0]["trace"][-1]["file"] == "tools.py"
    assert methods(engine, Query.source(Parameter("req")) >> SUBPROCESS) == ["quoted", "unsafe"]


def test_fields_overwrites_loops_and_templates(engine):
    assert methods(engine, Query.source(Parameter("x")) >> Call(name="sink")) == ["field_hit", "formatted"]
    assert methods(engine, Query.source(Parameter("items")) >> Call(name="sink")) == ["looped"]


def test_literals_and_unification(engine):
    assert methods(engine, Query.source(Call(name="call", args=["ls"]))) == ["constant"]
    lines = [r["code"] for r in engine.execute(Query.source(Call(name="pair", args=["$X", "$X"]))).collect()]
    assert lines == ["pair(a, a)"]
    assert methods(engine, Query.source(Literal("fixed"))) == ["overwritten"]


def test_dominance(engine):
    sink, check = Call(fullname=r"os\.system"), Call(name="check_auth")
    assert methods(engine, Query.source(sink.is_dominated_by(check))) == ["guarded"]
    assert methods(engine, Query.source(sink.is_not_dominated_by(check))) == ["maybe"]


def test_inside_and_annotations(engine):
    assert methods(engine, Query.source(Call(name="quoted").inside(Method(annotation=".*login.*")))) == ["safe_view"]
    assert methods(engine, Query.source(Var("$P")))[0] != ""


def test_scan_and_reports(engine, tmp_path):
    rules = library.scan_rules("python")
    found = run_scans(engine.graph, rules).cache()
    seen = {(r["rule"], (r["method"] or "").split(":")[-1]) for r in found.collect()}
    assert ("Command Injection", "unsafe") in seen and ("Command Injection", "run_it") in seen
    assert ("Command Injection", "quoted") not in seen and ("Command Injection", "constant") not in seen
    text = ConsoleReporter().report(found)
    assert "[HIGH] Command Injection" in text and "Findings:" in text
    import json

    log = json.loads(sarif.document(found, rules))
    assert log["version"] == "2.1.0" and log["runs"][0]["results"][0]["message"]["text"]
    assert len(log["runs"][0]["results"]) == found.count()
    steps = run_scans(engine.graph, [r for r in rules if r.name == "Command Injection"], trace=True).collect()
    ends = {(s["trace"][0]["code"], s["trace"][-1]["file"]) for s in steps}
    assert ("cmd", "app.py") in ends and all(len(s["trace"]) >= 2 for s in steps)
    sarif.write(found, f"file://{tmp_path}/sarif")


def test_one_closure_finds_what_single_queries_find(engine):
    rules = [r for r in library.scan_rules("python") if r.name == "Command Injection"]
    together = {(r["source_id"], r["node_id"]) for r in run_scans(engine.graph, rules).collect()}
    alone = {(r["source_id"], r["node_id"]) for r in engine.execute(rules[0].query).collect()}
    assert together == alone


def test_lists(engine):
    assert {r["full_name"] for r in engine.list_calls("system").collect()} == {"os.system"}
    entry = {r["name"] for r in engine.list_methods(internal_only=True, entry_points_only=True).collect()}
    assert "outer" in entry and "unsafe" not in entry and ":program" not in entry
    row = engine.method_details("app.py:unsafe").collect()[0]
    assert [p["name"] for p in row["params"]] == ["cmd"] and row["callers"] == ["app.py:home_view"]
    assert engine.find_calls("system").count() == 2
    assert {r["module"] for r in engine.api_summary().collect()} >= {"subprocess", "os"}


def test_call_graph(engine):
    rows = engine.call_graph("outer", depth=4, heuristics=library.discovery_heuristics("python"), barrier_patterns=["login.*"]).collect()
    assert [r["name"] for r in sorted(rows, key=lambda r: r["depth"])][:3] == ["outer", "home_view", "unsafe"]
    again = engine.call_graph("recursive", depth=5).collect()
    assert sorted((r["depth"], r["cut"]) for r in again) == [(0, False), (1, True)]
    callers = engine.call_graph("unsafe", direction="caller").collect()
    assert {r["name"] for r in callers} == {"unsafe", "home_view", "outer"}
    with pytest.raises(ValueError):
        engine.call_graph(direction="up")
    traced = engine.call_graph("home_view", depth=2, heuristics=library.discovery_heuristics("python"), traces=True, conditions=True)
    assert {r["name"] for r in traced.collect()} >= {"home_view", "unsafe"}
    assert "outer" in tree_text(engine.call_graph("outer", depth=2).withColumn("category", __import__("pyspark").sql.functions.lit(None).cast("string")))


def test_wrappers(engine):
    rows = {r["name"]: r for r in engine.discover_wrappers("python").collect()}
    assert rows["unsafe"]["score"] == 15 and "constant" not in rows
    assert rows["run_it"]["calls"][0]["category"] == "Command Execution"


def test_slices(engine):
    nodes, edges = engine.data_flow_slice(r"subprocess\.call", 20)
    assert nodes.where("is_sink").count() > 0 and nodes.where("is_origin").count() > 0
    assert "SINK" in SliceReporter().report_slice(nodes, edges)
    empty, none = engine.data_flow_slice("nothing_like_it")
    assert empty.count() == 0 and SliceReporter().report_slice(empty, none) == "No slice."
    assert "passed to" in usage_text(engine.usage_slice())


def test_endpoints(engine):
    from graphsieve.operators.endpoints import render

    rows = {r["action"]: r for r in engine.endpoints("python").collect()}
    assert rows["safe_view"]["is_protected"] and "Command Execution" in rows["home_view"]["capabilities"]
    assert "home_view" in render(list(rows.values()))


def test_pack_cache_and_cli(spark, tmp_path, capsys):
    from graphsieve.cli import main

    src = tmp_path / "src"
    src.mkdir()
    (src / "auth.py").write_text(APP)
    (src / "plain.py").write_text("x = 1\n")
    (src / "skip.py").write_text("secret")
    (src / "raw.bin").write_bytes(b"\xff\xfe\x00")
    (src / ".gitignore").write_text("skip.py\n")
    e = Engine(spark, cache=str(tmp_path / "cache"))
    e.load_code(str(src))
    first = e.graph.nodes.count()
    assert Engine(spark, cache=str(tmp_path / "cache")).load_code(str(src)).graph.nodes.count() == first
    text = e.pack(str(src))
    assert "# auth.py (score" in text and "skip.py" not in text
    assert main(["find-calls", str(src), "system"], e) == 0
    assert main(["slice", str(src), "--list-rules"]) == 0
    assert main(["query", str(src), "SELECT count(*) AS n FROM {nodes}"], e) == 0
    out = capsys.readouterr().out
    assert "os.system" in out and "sql-exec" in out


def test_token_counter(spark):
    import public_tokenizers
    from graphsieve.functions.tokens import counter

    count = counter(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    df = spark.createDataFrame([("hello world",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(count("t")).collect()] == [2, 0, 0]


def test_incremental_import(spark, tmp_path):
    from graphsieve.streaming.ingest import linked, start

    (tmp_path / "in").mkdir()
    (tmp_path / "in/tools.py").write_text(TOOLS)
    args = (spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"))
    start(*args).awaitTermination()
    before = linked(spark, str(tmp_path / "out")).label("METHOD").count()
    (tmp_path / "in/more.py").write_text("def f():\n    pass\n")
    start(*args).awaitTermination()
    assert linked(spark, str(tmp_path / "out")).label("METHOD").count() == before + 2
