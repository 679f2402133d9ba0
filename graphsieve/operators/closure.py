"""Reachability over edges: a semi-naive loop, or positions where flows are paths.

``reach`` starts all roots at once.  Each round joins the frontier with the edges, drops
pairs that are known (anti-join) and writes the new pairs, which cuts the lineage.  One
shortest witness is kept for each pair, the path as an array only if it is asked for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from ..storage import Scratch

FLOW = ("DDG", "REACHING_DEF")


def reach(edges: DataFrame, starts: DataFrame, depth: int | None = None, blocked: DataFrame | None = None, trace: bool = False, within: DataFrame | None = None) -> DataFrame:
    """root, node, depth (and path) of all pairs, the root itself at depth 0.

    edges: src, dst. starts: root, node, and optionally grp, which then is a column of the
    result: groups share the rounds and differ in what is blocked. blocked: id (and grp)
    of nodes that no path may touch. within: id (and grp) of the only nodes that paths may
    touch, as ``towards`` gives them. A null depth runs to the fixpoint.
    """
    scratch = Scratch(starts.sparkSession, "reach")
    key = [c for c in ("grp", "root") if c in starts.columns]
    grouped = blocked is not None and "grp" in blocked.columns
    starts = starts.select(*key, "node").distinct()
    if blocked is not None:
        blocked = scratch.save(blocked.withColumnRenamed("id", "node").distinct(), "blocked")
        on = ["grp", "node"] if grouped else ["node"]
        starts = starts.join(blocked, on, "left_anti")
        if not grouped:
            edges = edges.join(blocked.select(F.col("node").alias("dst")), "dst", "left_anti")
    narrow = within is not None and "grp" in within.columns
    if within is not None:
        within = scratch.save(within.withColumnRenamed("id", "node").distinct(), "within")
        starts = starts.join(within, ["grp", "node"] if narrow else ["node"], "left_semi")
        if not narrow:
            edges = edges.join(within.select(F.col("node").alias("dst")), "dst", "left_semi")
    hops = scratch.save(edges.select(F.col("src").alias("node"), F.col("dst").alias("next")).distinct(), "edges")
    frontier = starts.withColumn("depth", F.lit(0))
    if trace:
        frontier = frontier.withColumn("path", F.array("node"))
    frontier = known = scratch.save(frontier, "round0")
    k = 0
    while depth is None or k < depth:
        k += 1
        step = frontier.join(hops, "node")
        if trace:
            # of equally short paths the smallest counts
            new = step.select(*key, F.col("next").alias("node"), F.concat("path", F.array("next")).alias("path")).groupBy(*key, "node").agg(F.min("path").alias("path"))
        else:
            new = step.select(*key, F.col("next").alias("node")).distinct()
        if grouped:
            new = new.join(blocked, ["grp", "node"], "left_anti")
        if narrow:
            new = new.join(within, ["grp", "node"], "left_semi")
        new = new.join(known.select(*key, "node"), [*key, "node"], "left_anti").withColumn("depth", F.lit(k))
        frontier = scratch.save(new.select(known.columns), f"round{k}")
        if frontier.isEmpty():
            break
        known = known.unionByName(frontier)
        if k % 8 == 0:
            known = scratch.save(known, f"known{k}")
    return known


def towards(edges: DataFrame, ends: DataFrame, blocked: DataFrame | None = None) -> DataFrame:
    """id (and grp) of the nodes from which a clean path leads to an end, the ends included.

    One set for all ends (of a group), so it grows with the nodes and not with pairs.
    ends: id (and grp).
    """
    key = [c for c in ("grp",) if c in ends.columns]
    starts = ends.select(*key, F.lit(0).cast("long").alias("root"), F.col("id").alias("node"))
    found = reach(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), starts, blocked=blocked)
    return found.select(*key, F.col("node").alias("id"))


def flow_edges(g: Graph) -> DataFrame:
    return g.links(*FLOW).select("src", "dst")


def flows(g: Graph, sources: DataFrame, sinks: DataFrame, blocked: DataFrame | None = None, trace: bool = False, strict: bool = False) -> DataFrame:
    """source, sink, depth (and path): a clean path leads from one to the other.

    sources, sinks: id.  strict leaves out a node that is both ends of an empty path.
    An empty side costs no rounds.  Nodes that lead to no sink leave first: pairs are kept
    only on the way to one.
    """
    if g.chain is not None:
        return _chain_flows(g, sources, sinks, blocked, strict)
    edges = flow_edges(g)
    pairs = reach(edges, sources.select(F.col("id").alias("root"), F.col("id").alias("node")), trace=trace, within=towards(edges, sinks, blocked))
    out = pairs.join(sinks.select(F.col("id").alias("node")).distinct(), "node", "left_semi")
    out = out.where("depth > 0") if strict else out
    return out.withColumnsRenamed({"root": "source", "node": "sink"})


def _chain_flows(g: Graph, sources: DataFrame, sinks: DataFrame, blocked: DataFrame | None, strict: bool) -> DataFrame:
    """Paths by position: a sink follows a source in its chain with no blocked node between.

    The number of blocked nodes up to a position is the same at both ends of a clean path,
    so it joins the key and the join never sees pairs across a blocked node.
    """
    chain = g.chain.select("id", "chain", "pos")
    if blocked is None:
        chain = chain.withColumn("gate", F.lit(0).cast("long"))
    else:
        from pyspark.sql import Window

        marked = chain.join(blocked.select("id").distinct().withColumn("_b", F.lit(1)), "id", "left")
        w = Window.partitionBy("chain").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
        chain = marked.withColumn("gate", F.sum(F.coalesce("_b", F.lit(0))).over(w)).where("_b is null").drop("_b")
    a = chain.join(sources.select("id").distinct(), "id", "left_semi").select(F.col("id").alias("source"), "chain", "gate", F.col("pos").alias("from"))
    b = chain.join(sinks.select("id").distinct(), "id", "left_semi").select(F.col("id").alias("sink"), "chain", "gate", F.col("pos").alias("to"))
    order = F.col("from") < F.col("to") if strict else F.col("from") <= F.col("to")
    return a.join(b, ["chain", "gate"]).where(order).select("source", "sink", (F.col("to") - F.col("from")).cast("int").alias("depth"))


def backward(edges: DataFrame, ends: DataFrame, depth: int) -> DataFrame:
    """root, node, depth of what reaches the ends within ``depth`` steps."""
    return reach(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ends, depth)
