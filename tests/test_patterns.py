"""Pattern algebra on small graphs built by hand."""

import pytest
from graphsieve import And, Any, Call, Field, Graph, Identifier, Inside, Literal, Method, Not, Or, Parameter, Query, Return, Var
from graphsieve.operators.query import execute


def call(i, name, full=None, method=100, **k):
    return {"id": i, "label": "CALL", "name": name, "method_full_name": full or name, "code": k.pop("code", f"{name}()"), "method_id": method, "filename": "f", "line": i} | k


@pytest.fixture(scope="module")
def g(spark):
    nodes = [
        {"id": 100, "label": "METHOD", "name": "admin_view", "full_name": "app.admin_view", "ast_parent_full_name": "app.Views", "is_external": False},
        {"id": 101, "label": "METHOD", "name": "helper", "full_name": "app.helper", "ast_parent_full_name": "app.Other", "is_external": False},
        {"id": 102, "label": "TYPE_DECL", "name": "Views", "full_name": "app.Views"},
        {"id": 103, "label": "ANNOTATION", "name": "secured", "code": "@secured"},
        {"id": 104, "label": "METHOD_PARAMETER_IN", "name": "req", "code": "req", "method_id": 100, "ord": 1},
        {"id": 105, "label": "METHOD_PARAMETER_IN", "name": "x", "code": "x", "method_id": 101, "ord": 1},
        {"id": 106, "label": "RETURN", "method_id": 100},
        call(1, "run", "os.run"),
        {"id": 2, "label": "LITERAL", "code": '"ls"', "method_id": 100},
        {"id": 3, "label": "IDENTIFIER", "name": "x", "code": "x", "method_id": 100},
        call(4, "run", "os.run", 101),
        {"id": 5, "label": "IDENTIFIER", "name": "x", "code": "x", "method_id": 101},
        {"id": 6, "label": "IDENTIFIER", "name": "y", "code": "y", "method_id": 101},
        call(7, "<operator>.fieldAccess", code="req.user"),
        {"id": 8, "label": "IDENTIFIER", "name": "req", "code": "req", "method_id": 100, "type_full_name": "web.Request"},
        {"id": 9, "label": "FIELD_IDENTIFIER", "code": "user", "method_id": 100},
        call(10, "get", "web.get"),
        {"id": 11, "label": "LITERAL", "code": "42", "method_id": 100},
        call(12, "pair"),
        call(13, "pair"),
        {"id": 14, "label": "LITERAL", "code": "'42'", "method_id": 100},
    ]
    edges = [(1, 2, "ARGUMENT", 1), (4, 5, "ARGUMENT", 1), (4, 6, "ARGUMENT", 2), (7, 8, "ARGUMENT", 1), (7, 9, "ARGUMENT", 2), (10, 8, "ARGUMENT", 0), (10, 11, "ARGUMENT", 1)]
    edges += [(12, 3, "ARGUMENT", 1), (12, 5, "ARGUMENT", 2), (13, 3, "ARGUMENT", 1), (13, 6, "ARGUMENT", 2), (102, 103, "ANNOTATED_BY")]
    return Graph.of_rows(spark, nodes, edges)


def ids(g, p):
    return sorted(r["id"] for r in p.scan(g).select("id").collect())


@pytest.mark.parametrize(
    "pattern, want",
    [
        (Call(name="run"), [1, 4]),
        (Call(name="ru"), []),
        (Call(name="ignored", fullname=r"os\..*"), [1, 4]),
        (Call(name="run", args=["ls"]), [1]),
        (Call(name="run", args=["$X", "$Y"]), [4]),
        (Call(name="run", args=[None, "$Y"]), [4]),
        (Call(name="pair", args=["$X", "$X"]), [12]),
        (Call(name="pair", args=["$_", "$_"]), [12, 13]),
        (Call(receiver_type="Request"), [10]),
        (Literal("ls"), [2]),
        (Literal(42), [11]),
        (Literal("42"), [11, 14]),
        (Literal("$x"), [2, 11, 14]),
        (Identifier("x|y"), [3, 5, 6]),
        (Identifier("req").field("user"), [7]),
        (Field(Identifier("req"), "other"), []),
        (Return(), [106]),
        (Parameter("x"), [105]),
        (Parameter("$p"), [104, 105]),
        (Method(name=".*_view"), [100]),
        (Method(name="view"), []),
        (Method(parameter="req"), [100]),
        (Method(annotation="secured"), []),
        (Call(name="run").inside(Method(name="view")), [1]),
        (Call(name="run").inside(Method(annotation="secured")), [1]),
        (Call(name="run").inside(~Method(annotation="secured")), [4]),
        (Call(name="run") | Call(name="get"), [1, 4, 10]),
        (Or([Call(name="get"), Call(name="run", args=["ls"])]), [1, 10]),
        (Call(name="run") & ~Call(args=["ls"]), [4]),
        (Call(name="run").where(Inside(Any(), Method(name="helper"))), [4]),
        (And([Var("$a"), Not(Literal("$_"))]) & Identifier("y"), [6]),
    ],
)
def test_scan(g, pattern, want):
    assert ids(g, pattern) == want


def test_predicates_on_columns_need_no_join(g):
    plan = (Call(name="run") | ~Call(name="get")).scan(g)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_search_bindings(g):
    rows = execute(g, Query.source(Call(name="run", args=["$A"]))).collect()
    assert sorted((r["node_id"], r["bindings"]["$A"]) for r in rows) == [(1, '"ls"'), (4, "x")]


def test_calls_on_one_line_are_bound_each_for_itself(spark):
    """An external callee stands for the internal ones of its class; another on the same line stays."""
    from graphsieve.graph import Graph
    from graphsieve.operators.analyses import method_calls, security_summary

    method = lambda i, name, full, external=False: {"id": i, "label": "METHOD", "name": name, "full_name": full, "is_external": external}
    nodes = [method(1, "main", "app:Main:main"), method(2, "get", "app:Store:get"), method(3, "put", "lib:Other:put", True), method(4, "get", "lib:Store:get", True), method(5, "get", "app:Cache:get"), method(6, "run", "run", True), method(7, "run", "app:Job:run")]
    nodes += [{"id": 10 + k, "label": "CALL", "name": "c", "method_id": 1, "line": line} for k, line in enumerate((3, 3, None, None))]
    edges = [(10, 4, "CALL"), (11, 3, "CALL"), (12, 6, "CALL"), (13, 3, "CALL")]
    got = {(r["src"], r["dst"]): r["line"] for r in method_calls(Graph.of_rows(spark, nodes, edges)).collect()}
    assert got == {(1, 2): 3, (1, 3): 3, (1, 7): None}
    tree = spark.createDataFrame([(1, 1, 0, None, "main", "m", "a.py"), (1, 2, 1, "Run", "x", "sys", None), (1, 3, 2, "Run", "x", "sys", None)], "root long, node long, depth int, category string, name string, full_name string, file string")
    assert [tuple(r) for r in security_summary(tree).collect()] == [("Run", "sys", ["main (a.py)"])]
