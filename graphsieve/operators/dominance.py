"""Dominance in control flow graphs.

A node is dominated by a set of barriers if one of them strictly dominates it; two
barriers on opposite branches do not.  Methods' graphs are small and independent, so
dominator sets are computed a method at a time in one grouped pass, and only for methods
that have both a target and a barrier.  Annotated methods dominate all their nodes.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..graph import Graph
from ..storage import ship


def immediate_dominators(entry: int, edges: list[tuple[int, int]]) -> dict[int, int]:
    """Immediate dominator of each node that the entry reaches, by iteration in reverse postorder."""
    after: dict[int, list[int]] = {}
    before: dict[int, list[int]] = {}
    for a, b in edges:
        after.setdefault(a, []).append(b)
        before.setdefault(b, []).append(a)
    order, seen, stack = [], {entry}, [(entry, iter(after.get(entry, ())))]
    while stack:
        node, rest = stack[-1]
        for nxt in rest:
            if nxt not in seen:
                seen.add(nxt)
                stack.append((nxt, iter(after.get(nxt, ()))))
                break
        else:
            order.append(node)
            stack.pop()
    rank = {n: i for i, n in enumerate(order)}
    idom = {entry: entry}
    changed = True
    while changed:
        changed = False
        for n in reversed(order):
            if n == entry:
                continue
            new = None
            for p in before.get(n, ()):
                if p in idom:
                    if new is None:
                        new = p
                        continue
                    a, b = p, new
                    while a != b:
                        while rank[a] < rank[b]:
                            a = idom[a]
                        while rank[b] < rank[a]:
                            b = idom[b]
                    new = a
            if new is not None and idom.get(n) != new:
                idom[n] = new
                changed = True
    return idom


def _method(pdf: pd.DataFrame) -> pd.DataFrame:
    """Rows: kind 0 flow edge (a, b), 1 target a, 2 barrier a; the method's own id is the entry."""
    method = int(pdf["method_id"].iloc[0])
    edges = [(int(a), int(b)) for a, b in pdf.loc[pdf["kind"] == 0, ["a", "b"]].itertuples(index=False)]
    barriers = {int(a) for a in pdf.loc[pdf["kind"] == 2, "a"]}
    targets = [int(a) for a in pdf.loc[pdf["kind"] == 1, "a"]]
    starts = {a for a, _ in edges} - {b for _, b in edges}
    entry = method if any(a == method for a, _ in edges) or not starts else -1
    if entry == -1:  # no edge leaves the method node: a virtual entry before all starts
        edges += [(-1, s) for s in starts]
    idom = immediate_dominators(entry, edges)
    found = []
    for t in targets:
        n = t
        while n in idom and idom[n] != n:
            n = idom[n]
            if n in barriers:
                found.append(t)
                break
    return pd.DataFrame({"id": pd.Series(found, dtype="int64")})


def dominated(g: Graph, targets: DataFrame, barriers: DataFrame) -> DataFrame:
    """id of the targets that some barrier strictly dominates."""
    of_method = barriers.where("label = 'METHOD'").select(F.col("id").alias("method_id"))
    whole = targets.join(of_method, "method_id", "left_semi").select("id")
    inner = barriers.where("label != 'METHOD'")
    if g.chain is not None:
        # flow graphs that are paths: the first barrier of a path dominates all that follow
        w = g.chain.join(inner.select("id"), "id", "left_semi").groupBy("chain").agg(F.min("pos").alias("first"))
        later = targets.select("id").join(g.chain, "id").join(w, "chain").where("pos > first").select("id")
        return later.unionByName(whole).distinct()
    ship(g.spark)
    both = targets.select("method_id").distinct().join(inner.select("method_id").distinct(), "method_id", "left_semi")
    at = g.nodes.select("id", F.when(F.col("label") == "METHOD", F.col("id")).otherwise(F.col("method_id")).alias("method_id"))
    flow = g.links("CFG").select(F.col("src").alias("id"), "dst").join(at, "id").join(both, "method_id", "left_semi")
    rows = flow.select("method_id", F.lit(0).alias("kind"), F.col("id").alias("a"), F.col("dst").alias("b"))
    for kind, df in ((1, targets), (2, inner)):
        rows = rows.unionByName(df.join(both, "method_id", "left_semi").select("method_id", F.lit(kind).alias("kind"), F.col("id").alias("a"), F.lit(0).cast("long").alias("b")))  # no null: ids stay whole numbers
    found = rows.groupBy("method_id").applyInPandas(_method, "id long")
    return found.unionByName(whole).distinct()


def control_conditions(g: Graph, most: int = 100) -> DataFrame:
    """id, conditions: the distinct codes that control a node, without loop machinery and long ones."""
    by = g.links("CDG").select(F.col("src").alias("c"), F.col("dst").alias("id"))
    code = g.nodes.select(F.col("id").alias("c"), "code")
    kept = by.join(code, "c").where(~F.col("code").rlike(r"_iterator|_result|\.next\(\)") & (F.length("code") < most))
    return kept.groupBy("id").agg(F.array_sort(F.collect_set("code")).alias("conditions"))


def descendants(g: Graph, ancestors: DataFrame) -> DataFrame:
    """ancestor, id of AST descendants, by pre-order intervals within a file instead of a closure."""
    a = ancestors.select(F.col("id").alias("ancestor"), "filename", F.col("ast_pre").alias("lo"), F.col("ast_post").alias("hi"))
    return g.nodes.join(a, "filename").where((F.col("ast_pre") > F.col("lo")) & (F.col("ast_pre") <= F.col("hi"))).select("ancestor", "id")


def latest(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")
