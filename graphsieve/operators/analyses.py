"""Table-valued analyses over a graph: lists, details, call trees, slices, wrappers."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import any_match, first_category, full_match, is_operator, noise
from ..graph import Graph
from ..storage import Scratch
from .closure import backward, flow_edges, flows, reach
from .dominance import control_conditions, descendants
from .patterns import Pattern


@dataclass(frozen=True)
class Heuristic:
    """What a category of calls looks like, how much it weighs and which parameters make it worse."""

    category: str
    patterns: tuple[str, ...]
    weight: int = 5
    suspicious: tuple[str, ...] = field(default=())


# ------------------------------------------------------------------ lists
def list_calls(g: Graph, pattern: str = ".*") -> DataFrame:
    """full_name: distinct callees whose name or full name matches, without operators and code."""
    calls = g.label("CALL").where((full_match("name", pattern) | full_match("method_full_name", pattern)) & ~noise(F.col("method_full_name")))
    return calls.select(F.col("method_full_name").alias("full_name")).distinct()


def entry_points(g: Graph, methods: DataFrame) -> DataFrame:
    """Methods that nothing calls; of lambdas only those at the top level."""
    called = g.links("CALL").select(F.col("dst").alias("id"))
    lambda_ = F.col("name").startswith("<lambda>")
    top = F.col("full_name").contains(":program") & ~F.col("full_name").rlike(r"<lambda>.*:<lambda>")
    return methods.join(called, "id", "left_anti").where(~lambda_ | top)


def list_methods(g: Graph, pattern: str = ".*", internal_only: bool = False, file_pattern: str | None = None, entry_points_only: bool = False) -> DataFrame:
    """Methods by name or full name, without operators, code and, if internal, module bodies."""
    out = g.label("METHOD").where((full_match("name", pattern) | full_match("full_name", pattern)) & ~noise(F.col("full_name")))
    if internal_only:
        out = out.where(~F.coalesce("is_external", F.lit(False)) & ~F.col("full_name").endswith(":program"))
    if file_pattern is not None:
        out = out.where(full_match("filename", file_pattern))
    return entry_points(g, out) if entry_points_only else out


def find_calls(g: Graph, pattern: str) -> DataFrame:
    """name, full_name, caller, code, file, line of matching call sites; whoever shows them sorts."""
    calls = g.label("CALL").where((full_match("name", pattern) | full_match("method_full_name", pattern)) & ~is_operator(F.col("name")))
    callers = g.label("METHOD").select(F.col("id").alias("method_id"), F.col("full_name").alias("caller"))
    out = calls.join(callers, "method_id", "left")
    return out.select("name", F.col("method_full_name").alias("full_name"), F.coalesce("caller", F.lit("<unknown>")).alias("caller"), "code", F.col("filename").alias("file"), "line")


def api_summary(g: Graph) -> DataFrame:
    """module, names: dotted callees by their first part; without a dot they are builtins."""
    name = F.col("method_full_name")
    part = F.when(name.contains(":"), F.element_at(F.split(name, ":"), -1)).otherwise(name)
    calls = g.label("CALL").where(~is_operator(name) & name.isNotNull()).select(part.alias("full")).distinct()
    module = F.when(F.col("full").contains("."), F.split_part("full", F.lit("."), F.lit(1))).otherwise("builtins")
    return calls.groupBy(module.alias("module")).agg(F.sort_array(F.collect_set("full")).alias("names"))


def method_details(g: Graph, full_name: str) -> DataFrame:
    """One row for each method of that full name (else of the pattern): parameters, callees, callers, code."""
    exact = g.label("METHOD").where(F.col("full_name") == full_name)
    found = exact if not exact.isEmpty() else g.label("METHOD").where(full_match("full_name", full_name))
    m = found.select(F.col("id").alias("method_id"), "full_name", "name", F.col("filename").alias("file"), "line", "code")
    inside = g.nodes.join(m.select("method_id"), "method_id", "left_semi")
    params = inside.where("label = 'METHOD_PARAMETER_IN'").groupBy("method_id").agg(F.array_sort(F.collect_list(F.struct(F.col("ord").alias("index"), "name", F.col("type_full_name").alias("type")))).alias("params"))
    calls = inside.where((F.col("label") == "CALL") & ~is_operator(F.col("name"))).groupBy("method_id").agg(F.array_sort(F.collect_set(F.struct("name", F.col("method_full_name").alias("full_name"), "code"))).alias("calls_out"))
    into = g.links("CALL").select(F.col("dst").alias("method_id"), F.col("src").alias("id")).join(m.select("method_id"), "method_id", "left_semi")
    callers = into.join(g.nodes.select("id", F.col("method_id").alias("caller_id")), "id").join(g.label("METHOD").select(F.col("id").alias("caller_id"), F.col("full_name").alias("caller")), "caller_id")
    callers = callers.groupBy("method_id").agg(F.array_sort(F.collect_set("caller")).alias("callers"))
    return m.join(params, "method_id", "left").join(calls, "method_id", "left").join(callers, "method_id", "left")


# ------------------------------------------------------------------ call graph
def method_calls(g: Graph) -> DataFrame:
    """src, dst, line: method calls method, by resolved call, method reference or nested lambda.

    An external callee ``package:Class:name`` stands for the internal methods of that class
    and name; one without a class for those of its name.  A call site whose callee has
    none keeps the external one.  Module bodies in between are passed through.
    """
    sites = g.label("CALL").where(~is_operator(F.col("name"))).select(F.col("id").alias("call"), F.col("method_id").alias("src"), "line")
    methods = g.label("METHOD").select("id", "name", "full_name", F.coalesce("is_external", F.lit(False)).alias("external"))
    direct = sites.join(g.links("CALL").select(F.col("src").alias("call"), F.col("dst")), "call")
    parts = F.split(F.coalesce("full_name", F.lit("")), ":")
    owner = F.when(F.size(parts) > 1, F.concat_ws(":", F.element_at(parts, -2), F.element_at(parts, -1)))
    target = methods.select(F.col("id").alias("dst"), "external", F.when(F.size(parts) > 1, F.element_at(parts, -1)).otherwise(F.col("name")).alias("callee"), owner.alias("owner"))
    direct = direct.join(target, "dst")
    inner = methods.where("not external").select(F.col("id").alias("inner"), F.col("name").alias("callee"), F.col("full_name").alias("inner_name"))
    # few external methods have internal namesakes: those pairs are found once, not for each call
    stands = target.where("external").join(inner, "callee").where("owner is null or endswith(inner_name, owner)").select("dst", "inner")
    answered = direct.where("external").join(stands, "dst", "left").select("src", F.coalesce("inner", "dst").alias("dst"), "line")
    unbound = direct.where("not external").select("src", "dst", "line")
    refs = g.label("METHOD_REF").select(F.col("method_id").alias("src"), F.col("method_full_name").alias("full_name"), "line").join(methods.select(F.col("id").alias("dst"), "full_name"), "full_name").select("src", "dst", "line")
    lambdas = g.label("METHOD").where(F.col("name").startswith("<lambda>"))
    nested = descendants(g, g.label("METHOD")).join(lambdas.select("id"), "id", "left_semi").select(F.col("ancestor").alias("src"), F.col("id").alias("dst"), F.lit(None).cast("int").alias("line"))
    out = unbound.unionByName(answered).unionByName(refs).unionByName(nested)
    return out.groupBy("src", "dst").agg(F.min("line").alias("line"))


def call_tree(edges: DataFrame, roots: DataFrame, depth: int = 5, reverse: bool = False, keep: DataFrame | None = None) -> DataFrame:
    """root, path, node, depth, cut: the tree below each root, one row a node of it.

    A method that is on its own path shows once more as a leaf (cut); so does one at the
    last depth.  keep: id of methods that may be expanded or shown, for pruning before
    paths multiply.
    """
    scratch = Scratch(roots.sparkSession, "calls")
    hop = edges.select(F.col("dst").alias("a"), F.col("src").alias("b")) if reverse else edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    if keep is not None:
        hop = hop.join(keep.select(F.col("id").alias("b")), "b", "left_semi")
    hop = scratch.save(hop.distinct(), "edges")
    level = scratch.save(roots.select(F.col("id").alias("root"), F.array("id").alias("path"), F.col("id").alias("node"), F.lit(0).alias("depth"), F.lit(depth == 0).alias("cut")), "level0")
    out = level
    for k in range(1, depth + 1):
        step = level.where("not cut").join(hop, F.col("node") == F.col("a")).select("root", F.concat("path", F.array("b")).alias("path"), F.col("b").alias("node"), F.lit(k).alias("depth"), (F.array_contains("path", F.col("b")) | F.lit(k == depth)).alias("cut"))
        level = scratch.save(step, f"level{k}")
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return out


def barriers(g: Graph, patterns: Sequence[str], predicate: Pattern | None = None) -> DataFrame:
    """id, barriers of methods: matching annotations (their class's too), calls and telling names."""
    notes = g.label("ANNOTATION").where(any_match("name", list(patterns))).select(F.col("id").alias("dst"), F.col("code").alias("what"))
    noted = g.links("ANNOTATED_BY").join(notes, "dst").select(F.col("src").alias("id"), "what")
    methods = g.label("METHOD")
    of_class = g.label("TYPE_DECL").join(noted, "id").select(F.col("full_name").alias("ast_parent_full_name"), "what")
    by_class = methods.join(of_class, "ast_parent_full_name").select("id", "what")
    calls = g.label("CALL").where(any_match("method_full_name", list(patterns))).select(F.col("method_id").alias("id"), F.col("name").alias("what"))
    named = methods.where(full_match("name", "(?i).*(auth|login|verify|perm|authorize|secure).*")).select("id", F.col("name").alias("what"))
    every = methods.join(noted, "id").select("id", "what").unionByName(by_class).unionByName(calls).unionByName(named)
    if predicate is not None:
        every = every.join(predicate.filter(g, methods, True).select("id"), "id", "left_semi")
    return every.groupBy("id").agg(F.array_sort(F.collect_set("what")).alias("barriers"))


def call_graph(
    g: Graph,
    pattern: str = ".*",
    direction: str = "callee",
    depth: int = 5,
    exclude: Sequence[str] = (),
    heuristics: Sequence[Heuristic] = (),
    barrier_patterns: Sequence[str] = (),
    barrier_predicate: Pattern | None = None,
    external: str | None = None,
    interesting_only: bool = False,
    conditions: bool = False,
    traces: bool = False,
    starts: DataFrame | None = None,
) -> DataFrame:
    """The call tree as flat rows: root, path, depth, cut, name, full_name, file, line, category, barriers, is_dominated.

    With heuristics children are categorised, internal or of the external pattern; with
    ``interesting_only`` branches without a category go, found by one reverse
    reachability before any path is built.
    """
    if direction not in ("callee", "caller"):
        raise ValueError("direction is callee or caller")
    edges = method_calls(g)
    methods = g.label("METHOD").where(~any_match("full_name", list(exclude)))
    category = first_category("full_name", heuristics)
    shown = methods.withColumn("category", category)
    if heuristics:
        wanted = F.col("category").isNotNull() | ~F.coalesce("is_external", F.lit(False))
        shown = shown.where(wanted | (full_match("full_name", external) if external else F.lit(False)))
    keep = shown.select("id")
    if interesting_only and heuristics:
        hits = shown.where("category is not null").select(F.col("id").alias("root"), F.col("id").alias("node"))
        back = edges if direction == "caller" else edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        keep = reach(back.select("src", "dst"), hits.withColumn("root", F.lit(0)), depth).select(F.col("node").alias("id")).distinct().join(keep, "id", "left_semi")
    roots = starts if starts is not None else list_methods(g, pattern).where(~F.coalesce("is_external", F.lit(False)))
    if interesting_only and heuristics:
        roots = roots.join(keep, "id", "left_semi")
    tree = call_tree(edges, roots.select("id"), depth, direction == "caller", keep)
    out = tree.join(shown.select(F.col("id").alias("node"), "name", "full_name", F.col("filename").alias("file"), "line", "category"), "node")
    if barrier_patterns:
        b = barriers(g, barrier_patterns, barrier_predicate)
        out = out.join(b.select(F.col("id").alias("node"), "barriers"), "node", "left")
        guarded = b.select(F.col("id").alias("up"))
        above = out.select("root", "path", F.explode(F.slice("path", 1, F.greatest(F.lit(0), F.size("path") - 1))).alias("up")).join(guarded, "up", "left_semi").select("root", "path").distinct()
        out = out.join(above.withColumn("_up", F.lit(True)), ["root", "path"], "left").withColumn("is_dominated", F.coalesce("_up", F.lit(False)) & F.col("barriers").isNull()).drop("_up")
    if traces:
        out = out.join(_argument_traces(g), [F.get("path", F.size("path") - 2) == F.col("_src"), F.col("node") == F.col("_dst")], "left").drop("_src", "_dst")
        out = out.withColumn("traces", F.when(F.col("category").isNotNull(), F.coalesce("traces", F.expr("cast(array() as array<string>)"))))
    if conditions:
        sites = g.label("CALL").select("id", F.col("method_id").alias("src")).join(g.links("CALL").select(F.col("src").alias("id"), F.col("dst").alias("node")), "id")
        cond = sites.join(control_conditions(g), "id").groupBy("src", "node").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("conditions")))).alias("conditions"))
        parent = F.when(F.size("path") > 1, F.get("path", F.size("path") - 2))
        out = out.withColumn("src", parent).join(cond, ["src", "node"], "left").drop("src")
    return out


#: Parameters that say nothing about a flow.
_NOISY = ("this", "self", "resolve", "reject", "callback", "cb", "next", "res", "req", "ctx")


def _argument_traces(g: Graph) -> DataFrame:
    """_src, _dst, traces: what a method's calls of another pass on, parameter by parameter, without literals."""
    sites = g.label("CALL").select(F.col("id").alias("call"), F.col("method_id").alias("_src")).join(g.links("CALL").select(F.col("src").alias("call"), F.col("dst").alias("_dst")), "call")
    args = g.argument().where("idx > 0").join(sites, "call").join(g.nodes.where("label <> 'LITERAL'").select(F.col("id").alias("arg"), F.col("code").alias("what")), "arg")
    params = g.label("METHOD_PARAMETER_IN").select(F.col("id").alias("root"), F.col("name").alias("param"), F.col("method_id").alias("_src"))
    params = params.join(args.select("_src").distinct(), "_src", "left_semi")
    found = flows(g, params.select(F.col("root").alias("id")), args.select(F.col("arg").alias("id"))).select(F.col("source").alias("root"), F.col("sink").alias("arg"))
    hits = args.join(found, "arg").join(params, ["root", "_src"])
    shown = F.concat(F.lit("arg: "), "what", F.lit(" <- param: "), "param")
    return hits.where(~F.lower("param").isin(*_NOISY)).groupBy("_src", "_dst").agg(F.array_sort(F.collect_set(shown)).alias("traces"))


def security_summary(tree: DataFrame) -> DataFrame:
    """category, sink, entries: by category and categorised method the distinct roots that reach it, as name and file.

    tree: rows of ``call_graph`` with heuristics; the roots' own rows name them.
    """
    roots = tree.where("depth = 0").select("root", F.concat("name", F.lit(" ("), F.coalesce("file", F.lit("")), F.lit(")")).alias("entry"))
    hits = tree.where("category is not null").select("root", "category", F.col("full_name").alias("sink")).distinct()
    return hits.join(roots, "root").groupBy("category", "sink").agg(F.array_sort(F.collect_set("entry")).alias("entries"))


def interesting_counts(tree: DataFrame) -> DataFrame:
    """root and its number of categorised rows."""
    return tree.groupBy("root").agg(F.count_if(F.col("category").isNotNull()).alias("interesting"))


def sink_distance(g: Graph, heuristics: Sequence[Heuristic], most: int = 12) -> DataFrame:
    """id, distance of methods to the nearest categorised one along calls."""
    hits = g.label("METHOD").where(first_category("full_name", heuristics).isNotNull()).select(F.lit(0).cast("long").alias("root"), F.col("id").alias("node"))
    found = backward(method_calls(g).select("src", "dst"), hits, most)
    return found.groupBy(F.col("node").alias("id")).agg(F.min("depth").alias("distance"))


# ------------------------------------------------------------------ slices
def data_flow_slice(g: Graph, sink_pattern: str, depth: int = 40) -> tuple[DataFrame, DataFrame]:
    """Nodes with flags is_sink, is_origin, is_param_use, and the edges of the backward slice.

    Origins are parameters other than ``this`` and identifiers that are named like a
    parameter of their method; parameters of all touched methods come along.
    """
    hit = F.col("label") == "CALL"
    sinks = g.nodes.where(hit & (full_match("name", sink_pattern) | full_match("code", f"(?s).*{sink_pattern}.*")))
    starts = sinks.select(F.lit(0).cast("long").alias("root"), F.col("id").alias("node"))
    arguments = g.argument().select(F.col("arg").alias("src"), F.col("call").alias("dst"))
    edges = flow_edges(g).unionByName(arguments).distinct()
    found = backward(edges, starts, depth).select(F.col("node").alias("id")).distinct()
    nodes = g.nodes.join(found, "id", "left_semi")
    params = g.label("METHOD_PARAMETER_IN").where("name != 'this'")
    extra = params.join(nodes.select("method_id").distinct(), "method_id", "left_semi")
    every = nodes.unionByName(extra).dropDuplicates(["id"])
    own = params.select("method_id", "name").distinct().withColumn("_like", F.lit(True))
    flags = every.join(sinks.select("id").withColumn("_sink", F.lit(True)), "id", "left").join(own, ["method_id", "name"], "left")
    use = (F.col("label") == "IDENTIFIER") & F.coalesce("_like", F.lit(False))
    is_param = (F.col("label") == "METHOD_PARAMETER_IN") & (F.col("name") != "this")
    flags = flags.withColumn("is_sink", F.coalesce("_sink", F.lit(False))).withColumn("is_param_use", use).withColumn("is_origin", is_param | use).drop("_sink", "_like")
    inside = edges.join(found.select(F.col("id").alias("src")), "src", "left_semi").join(found.select(F.col("id").alias("dst")), "dst", "left_semi")
    return flags, inside


def usage_slice(g: Graph, min_calls: int = 1, exclude_operators: bool = True) -> DataFrame:
    """method, object, defined_by, invoked, passed_to of locals and parameters with enough calls."""
    uses = g.links("REF").select(F.col("src").alias("use"), F.col("dst").alias("object"))
    args = g.argument().select("call", F.col("arg").alias("use"), "idx").join(uses, "use")
    calls = g.label("CALL").select(F.col("id").alias("call"), F.col("name").alias("callee"))
    if exclude_operators:
        calls = calls.where(~is_operator(F.col("callee")))
    seen = args.join(calls, "call")
    per = seen.groupBy("object").agg(F.array_sort(F.collect_set(F.when(F.col("idx") == 0, F.col("callee")))).alias("invoked"), F.array_sort(F.collect_set(F.when(F.col("idx") > 0, F.struct("callee", F.col("idx").alias("position"))))).alias("passed_to"), F.countDistinct("call").alias("calls"))
    objects = g.nodes.select(F.col("id").alias("object"), "label", "name", F.col("type_full_name").alias("type"), "method_id", F.col("filename").alias("file"), "line")
    defined = g.links("DDG").select(F.col("dst").alias("use"), F.col("src")).join(uses, "use").join(g.nodes.select(F.col("id").alias("src"), F.col("code")), "src").groupBy("object").agg(F.min("code").alias("defined_by"))
    return per.where(F.col("calls") >= min_calls).join(objects, "object").join(defined, "object", "left")


# ------------------------------------------------------------------ wrappers
def discover_wrappers(g: Graph, heuristics: Sequence[Heuristic]) -> DataFrame:
    """Internal methods of which a parameter reaches an argument of a categorised call, with their score.

    A call's score is its category's weight, and 5 more if a tainting parameter has a
    suspicious name; a method's is that of its best call.
    """
    methods = g.label("METHOD").where(~F.coalesce("is_external", F.lit(False)) & ~noise(F.col("full_name")))
    calls = g.label("CALL").withColumn("category", first_category("method_full_name", heuristics)).where("category is not null")
    args = g.argument().where("idx > 0").join(calls.select(F.col("id").alias("call"), "category", "name", "method_full_name", "method_id"), "call")
    params = g.label("METHOD_PARAMETER_IN").join(methods.select(F.col("id").alias("method_id")), "method_id", "left_semi")
    # only parameters of methods with such a call can taint one
    starts = params.join(args.select("method_id").distinct(), "method_id", "left_semi").select("id")
    found = flows(g, starts, args.select(F.col("arg").alias("id")))
    tainted = args.join(found.select(F.col("sink").alias("arg"), F.col("source").alias("param")), "arg").join(params.select(F.col("id").alias("param"), F.col("name").alias("tainted_by"), F.col("method_id").alias("owner")), "param").where("owner = method_id")
    weight, risky = F.lit(5), F.lit(False)
    for h in heuristics:
        weight = F.when(F.col("category") == h.category, h.weight).otherwise(weight)
        risky = F.when(F.col("category") == h.category, F.lower("tainted_by").isin(*[s.lower() for s in h.suspicious]) if h.suspicious else F.lit(False)).otherwise(risky)
    scored = tainted.withColumn("score", weight + F.when(risky, 5).otherwise(0))
    per_call = scored.groupBy("method_id", "category", "method_full_name").agg(F.max("score").alias("score"), F.array_sort(F.collect_set("tainted_by")).alias("tainted_by"), F.min("name").alias("name"))
    one = F.struct((-F.col("score")).alias("order"), "category", F.col("method_full_name").alias("full_name"), "name", "score", "tainted_by")
    per = per_call.groupBy("method_id").agg(F.max("score").alias("score"), F.array_sort(F.collect_list(one)).alias("calls"))
    names = params.groupBy("method_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "name"))), lambda p: p["name"]).alias("params"))
    out = per.join(methods.select(F.col("id").alias("method_id"), "name", "full_name", F.col("filename").alias("file"), F.coalesce("line", F.lit(-1)).alias("line")), "method_id")
    return out.join(names, "method_id", "left")


def category_evidence(rows: DataFrame, key: str, category: Column, evidence: Column, most: int = 3) -> DataFrame:
    """key, capabilities: a map from category to sorted distinct evidence, up to ``most`` each."""
    per = rows.withColumn("_c", category).where("_c is not null").groupBy(key, "_c").agg(F.slice(F.sort_array(F.collect_set(evidence)), 1, most).alias("e"))
    return per.groupBy(key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("_c", "e")))).alias("capabilities"))
