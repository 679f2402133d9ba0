"""Reachability and dominance against brute force on random graphs."""

import random

from graphsieve import Call, Graph, Query
from graphsieve.operators.closure import flows, reach, towards
from graphsieve.operators.dominance import dominated, immediate_dominators
from graphsieve.operators.query import execute
from pyspark.sql import functions as F


def brute(edges, starts, blocked=()):
    out = {}
    for s in starts:
        if s in blocked:
            continue
        seen, front, d = {s: 0}, [s], 0
        while front:
            d += 1
            front = [b for b in {b for a, b in edges if a in front} if b not in seen and b not in blocked]
            seen |= dict.fromkeys(front, d)
        out |= {(s, n): k for n, k in seen.items()}
    return out


def test_reach_with_cycles_and_blocks(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(30), rng.randrange(30)) for _ in range(55)]
    e = spark.createDataFrame(edges, "src long, dst long")
    starts = spark.createDataFrame([(i, i) for i in range(6)], "root long, node long")
    for blocked in ((), (3, 7, 11)):
        b = spark.createDataFrame([(x,) for x in blocked], "id long") if blocked else None
        got = {(r["root"], r["node"]): r["depth"] for r in reach(e, starts, blocked=b, trace=True).collect()}
        assert got == brute(edges, range(6), blocked)
    two = {(r["root"], r["node"]) for r in reach(e, starts, 2).collect()}
    assert two == {k for k, d in brute(edges, range(6)).items() if d <= 2}


def test_groups_differ_in_what_is_blocked(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (1, 4), (4, 3)], "src long, dst long")
    starts = spark.createDataFrame([(0, 1, 1), (1, 1, 1)], "grp int, root long, node long")
    blocked = spark.createDataFrame([(1, 2), (1, 4)], "grp int, id long")
    got = {(r["grp"], r["node"]) for r in reach(e, starts, blocked=blocked).collect()}
    assert got == {(0, 1), (0, 2), (0, 3), (0, 4), (1, 1)}


def test_only_what_leads_to_an_end_is_walked(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(30), rng.randrange(30)) for _ in range(50)]
    e = spark.createDataFrame(edges, "src long, dst long")
    starts = spark.createDataFrame([(g, i, i) for g in (0, 1) for i in range(8)], "grp int, root long, node long")
    ends = spark.createDataFrame([(g, i) for g in (0, 1) for i in (20, 23, 26)], "grp int, id long")
    stop = spark.createDataFrame([(1, 4), (1, 11), (1, 23)], "grp int, id long")
    back = towards(e, ends, stop).collect()
    got = {(r["grp"], r["root"], r["node"]): (r["depth"], r["path"]) for r in reach(e, starts, trace=True, within=towards(e, ends, stop)).collect()}
    full = {(r["grp"], r["root"], r["node"]): (r["depth"], r["path"]) for r in reach(e, starts, blocked=stop, trace=True).collect()}
    for grp, blocked in ((0, ()), (1, (4, 11, 23))):
        useful = {n for (_, n) in brute([(b, a) for a, b in edges], (20, 23, 26), blocked)}
        assert {r["id"] for r in back if r["grp"] == grp} == useful
        assert {k: v for k, v in got.items() if k[0] == grp} == {k: v for k, v in full.items() if k[0] == grp and k[2] in useful}
    assert 0 < len(got) < len(full)


def test_trace_is_a_path(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "src long, dst long")
    rows = reach(e, spark.createDataFrame([(1, 1)], "root long, node long"), trace=True).collect()
    assert {r["node"]: r["path"] for r in rows}[4] == [1, 2, 3, 4]


def test_dominators_against_removal(spark):
    rng = random.Random(2)
    for _ in range(40):
        n = rng.randrange(3, 9)
        edges = [(a, rng.randrange(n)) for a in range(n) for _ in range(2)]
        idom = immediate_dominators(0, edges)
        live = {b for (_, b) in brute(edges, [0])}
        for x in live:
            chain, k = set(), x
            while idom[k] != k:
                k = idom[k]
                chain.add(k)
            want = {d for d in live if d != x and x not in {b for (_, b) in brute(edges, [0], {d})}}
            assert chain == want


def test_two_barriers_on_branches_do_not_dominate(spark):
    big = 1 << 60  # ids beyond what a double holds
    nodes = [{"id": big, "label": "METHOD", "name": "m"}] + [{"id": big + i, "label": "CALL", "name": n, "method_id": big} for i, n in enumerate(("if", "check", "check", "sink", "check", "late"), 1)]
    edges = [(big, big + 1, "CFG"), (big + 1, big + 2, "CFG"), (big + 1, big + 3, "CFG"), (big + 2, big + 4, "CFG"), (big + 3, big + 4, "CFG"), (big + 4, big + 5, "CFG"), (big + 5, big + 6, "CFG")]
    g = Graph.of_rows(spark, nodes, edges)
    calls = g.label("CALL")
    got = {r["id"] - big for r in dominated(g, calls.where(F.col("name").isin("sink", "late")), calls.where("name = 'check'")).collect()}
    assert got == {6}


def test_positions_agree_with_the_fixpoint(spark):
    rng = random.Random(9)
    names = [*"sxxkbsxbkk", *(rng.choice("sxkb") for _ in range(30))]
    nodes = [{"id": i, "label": "CALL", "name": n, "method_id": i // 10, "code": n} for i, n in enumerate(names)]
    edges = [(i, i + 1, "DDG") for i in range(39) if i % 10 != 9]
    loop = Graph.of_rows(spark, nodes, edges)
    chain = spark.createDataFrame([(i, i // 10, i) for i in range(40)], "id long, chain long, pos long")
    fast = Graph(loop.nodes, loop.edges, chain)
    args = (Call(name="s").ids(loop), Call(name="k").ids(loop), Call(name="b").ids(loop))
    one, two = ({(r["source"], r["sink"], r["depth"]) for r in flows(g, *args).collect()} for g in (loop, fast))
    assert one == two and one
    q = (Query.source(Call(name="s")) >> Call(name="x") >> Call(name="k")).passes_not(Call(name="b"))
    a, b = ({(r["source_id"], r["node_id"], r["depth"]) for r in execute(g, q).collect()} for g in (loop, fast))
    assert a == b and a
    long = Query.source(Call(name="s")) >> Call(name="x") >> Call(name="x|b") >> Call(name="k")
    a, b = ({(r["source_id"], r["node_id"], r["depth"]) for r in execute(g, long).collect()} for g in (loop, fast))
    assert a == b and a


def test_empty_graph(spark):
    g = Graph.of_rows(spark, [], [])
    assert execute(g, Query.source(Call(name="a")) >> Call(name="b")).count() == 0
