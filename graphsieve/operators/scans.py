"""Many rules over one graph.

Flow rules share one closure: sources of all rules start together, in a group for each
set of sanitizers, so the number of rounds is that of the longest flow and not the sum
over rules.  A rule then only joins its sinks to what its sources reach.  Rules of
several steps, searches and graphs with positions run one by one.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from ..rules.model import Confidence, ScanRule, Severity
from ..storage import Scratch
from .closure import flow_edges, reach, towards
from .findings import deduplicate
from .query import describe, execute, points, with_trace

_COLUMNS = ("rule", "rule_id", "severity", "confidence")


def _labelled(df: DataFrame, rule: ScanRule) -> DataFrame:
    return df.select(F.lit(rule.name).alias("rule"), F.lit(rule.rule_id).alias("rule_id"), F.lit(int(rule.severity)).alias("severity"), F.lit(int(rule.confidence)).alias("confidence"), *df.columns)


def run_scans(g: Graph, rules: Sequence[ScanRule], severity: Severity | None = None, confidence: Confidence | None = None, trace: bool = False) -> DataFrame:
    """Findings of all rules at or above the floors, one match for each place, source method and bindings.

    trace adds the steps of one shortest path of each flow, as ``with_trace`` gives them.
    """
    rules = [r for r in rules if (severity is None or r.severity >= severity) and (confidence is None or r.confidence >= confidence)]
    if not rules:
        return _labelled(deduplicate(describe(g, _no_rows(g), [])), ScanRule("none", None)).limit(0)  # type: ignore[arg-type]
    scratch = Scratch(g.spark, "scans")
    shared = [r for r in rules if len(r.query.steps) == 1 and g.chain is None]
    out = []
    if shared:
        out += _shared(g, shared, scratch, trace)
    for r in (r for r in rules if r not in shared):
        out.append(_labelled(deduplicate(execute(g, r.query.with_trace() if trace else r.query)), r))
    found = reduce(DataFrame.unionByName, out)
    return with_trace(g, scratch.save(found, "found")) if trace else found


def _no_rows(g: Graph) -> DataFrame:
    return g.spark.createDataFrame([], "sink_owner long, source_id long, depth int, path array<bigint>")


def _shared(g: Graph, rules: list[ScanRule], scratch: Scratch, trace: bool) -> list[DataFrame]:
    groups: dict[tuple, int] = {}
    sources, sinks, blocked = [], [], {}
    for k, r in enumerate(rules):
        q = r.query
        names = q.variables()
        key = tuple(sorted(repr(_shape(p)) for p in q.sanitizers))
        grp = groups.setdefault(key, len(groups))
        if q.sanitizers and grp not in blocked:
            ids = reduce(DataFrame.unionByName, [p.ids(g, True) for p in q.sanitizers]).distinct()
            blocked[grp] = ids.select(F.lit(grp).alias("grp"), "id")
        pairs = [x for n in names for x in (F.lit(n), F.col(f"`{n}`"))]
        held = F.create_map(*pairs) if pairs else F.expr("cast(map() as map<string,string>)")
        sources.append(points(g, q.origin, names, q.arg_index).select(F.lit(k).alias("k"), F.lit(grp).alias("grp"), "id", held.alias("bound")))
        sinks.append(points(g, q.steps[0], names).select(F.lit(k).alias("k"), F.lit(grp).alias("grp"), "id", "owner", held.alias("bound")))
    starts = scratch.save(reduce(DataFrame.unionByName, sources), "sources")
    ends = scratch.save(reduce(DataFrame.unionByName, sinks), "sinks")
    stop = scratch.save(reduce(DataFrame.unionByName, blocked.values()), "blocked") if blocked else None
    edges = flow_edges(g)
    found = reach(edges, starts.select("grp", F.col("id").alias("root"), F.col("id").alias("node")), trace=trace, within=towards(edges, ends.select("grp", "id"), stop))
    if not trace:
        found = found.withColumn("path", F.lit(None).cast("array<bigint>"))
    hits = found.join(ends.withColumnsRenamed({"id": "node", "bound": "b"}), ["grp", "node"])
    hits = hits.join(starts.withColumnsRenamed({"id": "root", "bound": "a"}), ["k", "grp", "root"])
    # names that both ends bind have equal code; empty code binds nothing
    same = F.expr("forall(map_keys(a), n -> (a[n] is null or b[n] is null or a[n] = b[n]) and coalesce(a[n], b[n], '-') <> '')")
    bound = F.expr("transform_values(a, (n, v) -> coalesce(v, b[n]))")
    rows = hits.where(same).select("k", F.col("root").alias("source_id"), F.col("owner").alias("sink_owner"), "depth", "path", bound.alias("bound"))
    rows = rows.groupBy("k", "source_id", "sink_owner", F.to_json("bound").alias("j")).agg(F.min(F.struct("depth", "path")).alias("best"), F.any_value("bound").alias("bound"))
    rows = scratch.save(rows.select("k", "source_id", "sink_owner", "best.depth", "best.path", "bound"), "rows")
    marks = g.spark.createDataFrame([(k, r.name, r.rule_id, int(r.severity), int(r.confidence)) for k, r in enumerate(rules)], "k int, rule string, rule_id string, severity int, confidence int")
    seen = describe(g, rows.drop("bound"), [], keep=("k",)).drop("bindings")
    one = rows.select("k", F.col("source_id"), F.col("sink_owner").alias("node_id"), F.map_filter("bound", lambda _, v: v.isNotNull()).alias("bindings"))
    full = seen.join(one, ["k", "source_id", "node_id"]).join(F.broadcast(marks), "k")  # one row a rule
    return [deduplicate(full, "k").drop("k").select(*_COLUMNS, *[c for c in full.columns if c not in (*_COLUMNS, "k")])]


def _shape(x: object) -> object:
    """What a pattern looks for, comparable across instances."""
    if hasattr(x, "__dict__"):
        return (type(x).__name__, tuple(sorted((k, repr(_shape(v))) for k, v in vars(x).items())))
    if isinstance(x, (list, tuple)):
        return tuple(_shape(v) for v in x)
    return x
