"""Queries: a source pattern, the patterns it flows to, and what no path may touch.

``execute`` gives one row for each match.  Without a step it is a search; with steps
each leg is a reachability join, sanitized nodes leave the graph before any path is
sought, and names that stand at several places must bind equal code.

Decisions: a pair counts if some clean path leads from source to sink; the row's source
is the query's source, whatever the number of steps; every branch of an Or expands for
itself; a bound value must not be empty.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import absent, class_name, is_operator
from ..graph import Graph
from .closure import flows
from .patterns import Call, Or, Parameter, Pattern, Var


@dataclass(frozen=True)
class Query:
    origin: Pattern
    arg_index: int | None = None
    steps: tuple[Pattern, ...] = ()
    sanitizers: tuple[Pattern, ...] = ()
    trace: bool = False

    @staticmethod
    def source(pattern: Pattern, arg_index: int | None = None) -> Query:
        # a bare variable as a source means the parameters
        return Query(Parameter(pattern.name) if isinstance(pattern, Var) else pattern, arg_index)

    def flows_to(self, pattern: Pattern) -> Query:
        return replace(self, steps=(*self.steps, pattern))

    def __rshift__(self, pattern: Pattern) -> Query:
        return self.flows_to(pattern)

    def passes_not(self, pattern: Pattern) -> Query:
        return replace(self, sanitizers=(*self.sanitizers, pattern))

    def with_trace(self) -> Query:
        return replace(self, trace=True)

    def summary(self) -> Query:
        return replace(self, trace=False)

    def variables(self) -> list[str]:
        """Names that bind, in order of appearance."""
        names = [v.name for p in (self.origin, *self.steps) for v in p.variables() if v.name != "$_"]
        return list(dict.fromkeys(names))


def _bindings(g: Graph, owners: DataFrame, pattern: Pattern, names: Sequence[str]) -> DataFrame:
    """owners (id, code) with one column ``$x`` for each name: the code it is bound to."""
    places: dict[str, int | None] = {}
    for v in pattern.variables():
        places.setdefault(v.name, v.index)
    out = owners
    for name in names:
        index = places.get(name, 0)
        if index == 0:
            out = out.withColumn(name, F.lit(None).cast("string"))
        elif index is None:
            out = out.withColumn(name, F.col("code"))
        else:
            at = g.with_code(g.argument(index), "arg", name).select(F.col("call").alias("id"), name)
            out = out.join(at, "id", "left")
    return out


def points(g: Graph, pattern: Pattern, names: Sequence[str], arg_index: int | None = None, expand: bool = True) -> DataFrame:
    """id, owner and the bindings: where data enters or leaves a match.

    A call with argument patterns is entered at those arguments; other matches at the
    node and all its arguments; parameters at themselves.
    """
    if isinstance(pattern, Or):
        return reduce(DataFrame.unionByName, [points(g, p, names, arg_index, expand) for p in pattern.parts]).distinct()
    found = pattern.scan(g).select("id", "code", "label")
    bound = _bindings(g, found.select("id", "code"), pattern, names).withColumnRenamed("id", "owner")
    if arg_index is not None and not isinstance(pattern, Parameter):
        places = g.argument(arg_index).select(F.col("call").alias("owner"), F.col("arg").alias("id"))
    elif not expand or isinstance(pattern, Parameter):
        places = found.select(F.col("id").alias("owner"), "id")
    else:
        given = [i + 1 for i, a in enumerate(pattern.args) if a is not None] if isinstance(pattern, Call) else []
        args = g.argument().join(found.select(F.col("id").alias("call")), "call", "left_semi")
        if given:
            places = args.where(F.col("idx").isin(given)).select(F.col("call").alias("owner"), F.col("arg").alias("id"))
        else:
            places = args.select(F.col("call").alias("owner"), F.col("arg").alias("id")).unionByName(found.select(F.col("id").alias("owner"), "id"))
    return bound.join(places, "owner").select("id", "owner", *[F.col(f"`{n}`") for n in names])


def _named(df: DataFrame, names: Sequence[str], suffix: str) -> DataFrame:
    return df.withColumnsRenamed({n: f"{n}{suffix}" for n in names})


def _unify(df: DataFrame, names: Sequence[str], sides: Sequence[str], new: str) -> DataFrame:
    """Equal code at every place where a name is bound; null means that the place does not bind it."""
    for n in names:
        seen = F.coalesce(*[F.col(f"`{n}{s}`") for s in sides])
        here = F.col(f"`{n}{new}`")
        df = df.where(here.isNull() | seen.isNull() | (here == seen))
    return df


def _nearest(g: Graph, q: Query, current: DataFrame, bound: Sequence[str]) -> DataFrame:
    """Between two legs: one row for each source, place and bindings.

    Where flows are paths the nearest place stands for all later ones, as what follows
    those follows it too; a trace names the places, so there all stay.
    """
    key = ["source_id", *[F.col(f"`{b}`") for b in bound]]
    if g.chain is not None and not q.trace:
        best = current.groupBy(*key).agg(F.min(F.struct("depth", "path", "at")).alias("best"))
    else:
        best = current.groupBy(*key, F.col("at").alias("place")).agg(F.min(F.struct("depth", "path", "at")).alias("best"))
    return best.select("source_id", "best.at", "best.depth", "best.path", *[F.col(f"`{b}`") for b in bound])


def execute(g: Graph, q: Query) -> DataFrame:
    """Matches with the columns of ``describe``."""
    names = q.variables()
    start = points(g, q.origin, names, q.arg_index, expand=bool(q.steps))
    if not q.steps:
        rows = start.select(F.col("owner").alias("sink_owner"), F.lit(None).cast("long").alias("source_id"), F.lit(None).cast("int").alias("depth"), F.lit(None).cast("array<bigint>").alias("path"), *[F.col(f"`{n}`") for n in names])
        return describe(g, rows.distinct(), names)
    blocked = None
    if q.sanitizers:
        blocked = reduce(DataFrame.unionByName, [p.ids(g, True) for p in q.sanitizers]).distinct()
    current = _named(start, names, "@0").select(F.col("id").alias("source_id"), F.col("id").alias("at"), F.lit(0).alias("depth"), F.array("id").alias("path"), *[F.col(f"`{n}@0`") for n in names])
    sides = ["@0"]
    for k, step in enumerate(q.steps, 1):
        ends = _named(points(g, step, names), names, f"@{k}")
        found = flows(g, current.select(F.col("at").alias("id")).distinct(), ends.select("id"), blocked, q.trace)
        leg = found.withColumnsRenamed({"source": "at", "depth": "leg"})
        if "path" in leg.columns:
            leg = leg.withColumnRenamed("path", "leg_path")
        current = current.join(leg, "at").join(ends.withColumnRenamed("id", "sink"), "sink")
        current = _unify(current, names, sides, f"@{k}")
        sides.append(f"@{k}")
        if not q.trace:
            path = F.col("path")
        else:
            path = F.concat("path", F.slice("leg_path", 2, 1 << 30)) if "leg_path" in leg.columns else F.array_distinct(F.concat("path", F.array("sink")))
        current = current.select("source_id", F.col("sink").alias("at"), (F.col("depth") + F.col("leg")).alias("depth"), path.alias("path"), F.col("owner").alias("sink_owner"), *[F.col(f"`{n}{s}`") for n in names for s in sides])
        if k < len(q.steps):
            current = _nearest(g, q, current, [f"{n}{s}" for n in names for s in sides])
    for n in names:
        current = current.withColumn(n, F.coalesce(*[F.col(f"`{n}{s}`") for s in sides]))
        current = current.where(F.col(f"`{n}`").isNull() | (F.col(f"`{n}`") != ""))  # null: this branch does not bind it
    rows = current.groupBy("source_id", "sink_owner", *[F.col(f"`{n}`") for n in names]).agg(F.min(F.struct("depth", "path")).alias("best"))
    rows = rows.select("source_id", "sink_owner", F.col("best.depth").alias("depth"), (F.col("best.path") if q.trace else F.lit(None).cast("array<bigint>")).alias("path"), *[F.col(f"`{n}`") for n in names])
    return describe(g, rows, names)


_WHAT = ("id", "label", "name", "code", "line", "col", "line_end", "col_end", "filename", "method_id")


def describe(g: Graph, rows: DataFrame, names: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Everything a report says of a match.

    A match that is neither a call nor inside one is described by itself; operators and
    plain expressions by the call that they are an argument of.
    """
    nodes = g.nodes.select(*_WHAT, F.col("method_full_name").alias("called"), F.col("type_full_name"))
    methods = g.label("METHOD").select(F.col("id").alias("method_id"), F.col("name").alias("method_name"), F.col("full_name").alias("method"), F.col("ast_parent_full_name").alias("decl"), F.col("filename").alias("method_file"))
    sink = nodes.select(*[F.col(c).alias(c if c != "id" else "sink_owner") for c in nodes.columns])
    out = rows.join(sink, "sink_owner").join(methods, "method_id", "left")
    root = F.lit(g.metadata_root())
    source = g.nodes.select(F.col("id").alias("source_id"), F.col("code").alias("source_code"), F.col("label").alias("source_label"), F.col("line").alias("source_line"), F.col("filename").alias("source_file"), F.col("method_id").alias("source_method_id"))
    out = out.join(source, "source_id", "left")
    source_methods = g.label("METHOD").select(F.col("id").alias("source_method_id"), F.col("full_name").alias("source_method"))
    out = out.join(source_methods, "source_method_id", "left")
    pairs = [x for n in names for x in (F.lit(n), F.col(f"`{n}`"))]
    bindings = F.create_map(*pairs) if pairs else F.expr("cast(map() as map<string,string>)")
    return out.select(
        *keep,
        F.col("sink_owner").alias("node_id"),
        "label",
        "name",
        "code",
        F.col("line"),
        "col",
        F.coalesce("line_end", "line").alias("line_end"),
        "col_end",
        F.coalesce(absent(F.col("filename")), absent(F.col("method_file")), root).alias("file"),
        F.when(~is_operator(F.col("called")), F.col("called")).alias("called_method"),
        F.coalesce("method", "called").alias("method"),
        F.coalesce(absent(F.col("method_name")), F.col("name")).alias("method_name"),
        class_name(F.col("decl"), F.col("filename"), F.col("method_name"), F.col("method")).alias("class_name"),
        "source_id",
        "source_label",
        "source_code",
        "source_line",
        "source_file",
        "source_method",
        "depth",
        "path",
        bindings.alias("bindings"),
    )


def with_trace(g: Graph, matches: DataFrame) -> DataFrame:
    """``path`` as an array of steps: file, line, col, method, code, line_end, col_end."""
    at = matches.select("node_id", "source_id", F.posexplode("path").alias("k", "id")).distinct()
    methods = g.label("METHOD").select(F.col("id").alias("method_id"), F.col("full_name").alias("method"))
    steps = at.join(g.nodes.select("id", "filename", "line", "col", "code", "line_end", "col_end", "method_id"), "id").join(methods, "method_id", "left")
    one = F.struct("k", F.col("filename").alias("file"), "line", "col", "method", "code", "line_end", "col_end")
    lists = steps.groupBy("node_id", "source_id").agg(F.array_sort(F.collect_list(one)).alias("trace"))
    return matches.join(lists, ["node_id", "source_id"], "left").select(*matches.columns, "trace")
