"""Attack surface: controller methods, their guards, routes and capabilities.

Routes of Express-like routers come from calls ``app.get(path, ..., handler)`` and from
routers mounted with ``use``; mounts within mounted files are found by three joins, as
deep as routers nest in practice.  Everything is joined on method ids.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import absent, any_match, base_name, first_category, full_match, is_operator, join_path, module_path, strip_quotes, version_suffix
from ..graph import Graph
from ..rules import library
from ..rules.scoring import BACKEND_PATH_HINTS, FRONTEND_PATH_HINTS
from ..storage import Scratch
from .analyses import category_evidence, method_calls
from .closure import reach
from .dominance import dominated

VERBS = "get|post|put|delete|patch|all|use"
_SKIP = r".*(\.ctor|get_|set_|<init>|__init__).*"


def resolve_code(g: Graph, depth: int = 4) -> DataFrame:
    """id, value: constant text of literals, templates and sums; names and fields become ``{name}``.

    Built from the leaves up: each round joins the values of arguments into their call.
    """
    n = g.nodes
    leaf = n.where("label in ('LITERAL', 'IDENTIFIER')").select("id", F.when(F.col("label") == "LITERAL", strip_quotes(F.col("code"))).otherwise(F.concat(F.lit("{"), "name", F.lit("}"))).alias("value"))
    fields = g.argument(2).join(n.where("label = 'FIELD_IDENTIFIER'").select(F.col("id").alias("arg"), "code"), "arg").select(F.col("call").alias("id"), F.concat(F.lit("{"), "code", F.lit("}")).alias("value"))
    sums = n.where(F.col("name").isin("<operator>.formatString", "<operator>.addition", "<operator>.plus")).select(F.col("id").alias("call"))
    parts = g.argument().join(sums, "call", "left_semi")
    known = leaf.unionByName(fields)
    scratch = Scratch(g.spark, "codes")
    for k in range(depth):
        ready = parts.join(known.withColumnRenamed("id", "arg"), "arg", "left").groupBy("call").agg(F.count_if(F.col("value").isNull()).alias("open"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "value"))), lambda x: x["value"]), "").alias("value"))
        made = ready.where("open = 0").select(F.col("call").alias("id"), "value").join(known.select("id"), "id", "left_anti")
        made = scratch.save(made, f"round{k}")
        if made.isEmpty():
            break
        known = known.unionByName(made)
    return known


def _route_calls(g: Graph, names: str) -> DataFrame:
    """call, verb, receiver, file, route, handlers: route calls with their path and what follows it."""
    calls = g.label("CALL").where(full_match("name", names)).select(F.col("id").alias("call"), F.upper("name").alias("verb"), F.col("filename").alias("file"))
    receiver = g.argument(0).join(g.label("IDENTIFIER").select(F.col("id").alias("arg"), F.col("name").alias("receiver")), "arg").select("call", "receiver")
    values = resolve_code(g)
    texts = g.nodes.where("label = 'LITERAL' or name in ('<operator>.formatString', '<operator>.addition', '<operator>.plus', '<operator>.fieldAccess')").select(F.col("id").alias("arg")).join(values.withColumnRenamed("id", "arg"), "arg")
    args = g.argument().where("idx > 0").join(calls.select("call"), "call", "left_semi")
    path = args.join(texts, "arg").groupBy("call").agg(F.min(F.struct("idx", F.col("value").alias("route"))).alias("p")).select("call", F.col("p.idx").alias("at"), F.col("p.route").alias("route"))
    return calls.join(receiver, "call", "left").join(path, "call", "left")


def _handlers(g: Graph, calls: DataFrame) -> DataFrame:
    """call, idx, method_id of methods that the arguments after the path stand for."""
    args = g.argument().join(calls.select("call", F.coalesce("at", F.lit(0)).alias("at")), "call").where("idx > at and idx > 0")
    names = g.label("METHOD").select(F.col("id").alias("method_id"), F.col("full_name").alias("method_full_name"))
    refs = g.label("METHOD_REF").select(F.col("id").alias("ref"), "method_full_name").join(names, "method_full_name").select("ref", "method_id")
    direct = args.join(refs.withColumnRenamed("ref", "arg"), "arg").select("call", "idx", "method_id")
    # an identifier that was assigned a method, and a call that returns one
    local = g.links("REF").select(F.col("src").alias("use"), F.col("dst").alias("local"))
    assigned = g.label("CALL").where("name = '<operator>.assignment'").select(F.col("id").alias("call"))
    left = g.argument(1).join(assigned, "call", "left_semi").join(local.withColumnRenamed("use", "arg"), "arg").select("call", "local")
    right = g.argument(2).join(refs.withColumnRenamed("ref", "arg"), "arg").select("call", "method_id")
    held = left.join(right, "call").select("local", "method_id")
    named = args.join(local.withColumnRenamed("use", "arg"), "arg").join(held, "local").select("call", "idx", "method_id")
    inner = g.links("AST").select(F.col("src").alias("outer"), F.col("dst").alias("method_id")).join(g.label("METHOD").select(F.col("id").alias("method_id")), "method_id", "left_semi")
    called = g.links("CALL").select(F.col("src").alias("arg"), F.col("dst").alias("outer")).join(inner, "outer").select("arg", "method_id")
    made = args.join(called, "arg").select("call", "idx", "method_id")
    return direct.unionByName(named).unionByName(made).distinct()


def file_matches(file: Column, key: Column) -> Column:
    """A file belongs to a mount key: by its name, its folder, or the version both end in."""
    k = module_path(key)
    suffixes = [F.concat(k, F.lit(s)) for s in (".ts", ".js", "/index.ts", "/index.js")]
    direct = file.contains(F.concat(k, F.lit("/")))
    for s in suffixes:
        direct = direct | file.endswith(s)
    version = version_suffix(k)
    return direct | ((version != "") & file.contains(F.concat(F.lit("/"), version, F.lit("/"))))


def router_mounts(g: Graph, rounds: int = 3) -> DataFrame:
    """key, prefix: module or name of a router and the path that it is mounted at."""
    uses = _route_calls(g, "use").where("route is not null")
    last = g.argument().join(uses.select("call"), "call", "left_semi").groupBy("call").agg(F.max_by("arg", "idx").alias("arg"))
    names = g.label("IDENTIFIER").select(F.col("id").alias("arg"), F.col("name").alias("key"), F.col("type_full_name"))
    by_name = last.join(names, "arg").select("call", F.explode(F.array_distinct(F.array_compact(F.array("key", absent(F.split_part(F.col("type_full_name"), F.lit(":"), F.lit(1))))))).alias("key"))
    requires = g.label("CALL").where("name = 'require'").select(F.col("id").alias("req"))
    module = g.argument(1).join(requires.withColumnRenamed("req", "call"), "call", "left_semi").join(g.label("LITERAL").select(F.col("id").alias("arg"), module_path(strip_quotes(F.col("code"))).alias("module")), "arg").select(F.col("call").alias("req"), "module")
    by_require = last.join(module.withColumnRenamed("req", "arg"), "arg").select("call", F.col("module").alias("key"))
    # a name that was assigned a require
    local = g.links("REF").select(F.col("src").alias("use"), F.col("dst").alias("local"))
    assigned = g.label("CALL").where("name = '<operator>.assignment'").select(F.col("id").alias("call"))
    left = g.argument(1).join(assigned, "call", "left_semi").join(local.withColumnRenamed("use", "arg"), "arg").select("call", "local")
    right = g.argument(2).join(module.withColumnRenamed("req", "arg"), "arg").select("call", "module")
    by_local = last.join(local.withColumnRenamed("use", "arg"), "arg").join(left.join(right, "call").select("local", F.col("module").alias("key")), "local").select("call", "key")
    keys = by_name.unionByName(by_require).unionByName(by_local).distinct()
    every = Scratch(g.spark, "mounts").save(uses.join(keys, "call").select("receiver", "file", "route", "key"), "uses")
    mounts = every.where("receiver = 'app'").select("key", F.col("route").alias("prefix")).distinct()
    inner = every.where("receiver is null or receiver <> 'app'")
    for _ in range(rounds):
        hosts = inner.join(mounts.withColumnsRenamed({"key": "parent", "prefix": "above"}), file_matches(F.col("file"), F.col("parent")))
        mounts = mounts.unionByName(hosts.select("key", join_path(F.col("above"), F.col("route")).alias("prefix"))).distinct()
    return mounts


def routes(g: Graph) -> DataFrame:
    """method_id, path (verb and full path, the longest), middleware (method ids before the handler)."""
    calls = _route_calls(g, VERBS)
    handlers = _handlers(g, calls)
    last = handlers.groupBy("call").agg(F.max("idx").alias("idx"))
    final = handlers.join(last, ["call", "idx"]).select("call", "method_id")
    before = handlers.join(last.withColumnRenamed("idx", "end"), "call").where("idx < end").groupBy("call").agg(F.collect_set("method_id").alias("middleware"))
    mounts = router_mounts(g)
    own = calls.where("receiver = 'app'").select("call", F.concat_ws(" ", "verb", F.coalesce("route", F.lit(""))).alias("path"))
    mounted = calls.where("route is not null and (receiver is null or receiver <> 'app')").join(mounts, (F.col("receiver") == F.col("key")) | file_matches(F.col("file"), F.col("key"))).select("call", F.concat_ws(" ", "verb", join_path(F.col("prefix"), F.col("route"))).alias("path"))
    found = own.unionByName(mounted).join(final, "call").join(before, "call", "left")
    none = F.expr("cast(array() as array<bigint>)")
    return found.groupBy("method_id").agg(F.max_by("path", F.struct(F.length("path"), "path")).alias("path"), F.array_distinct(F.flatten(F.collect_list(F.coalesce("middleware", none)))).alias("middleware"))


def guards_of(g: Graph, methods: DataFrame, language: str | None) -> DataFrame:
    """method_id, guards: annotations and calls that look like a check, a telling name, or a dominating check."""
    patterns = [p for h in library.barrier_heuristics(language) for p in h.patterns]
    ids = methods.select(F.col("id").alias("method_id"))
    m = g.label("METHOD").join(methods.select("id"), "id", "left_semi")
    notes = g.label("ANNOTATION").where(any_match("name", patterns)).select(F.col("id").alias("dst"), F.col("code").alias("what"))
    noted = g.links("ANNOTATED_BY").join(notes, "dst").select(F.col("src").alias("id"), "what")
    own = m.join(noted, "id").select(F.col("id").alias("method_id"), "what")
    of_class = g.label("TYPE_DECL").join(noted, "id").select(F.col("full_name").alias("ast_parent_full_name"), "what")
    by_class = m.join(of_class, "ast_parent_full_name").select(F.col("id").alias("method_id"), "what")
    calls = g.label("CALL").join(ids, "method_id", "left_semi").where((any_match("method_full_name", patterns) | any_match("name", patterns)) & ~is_operator(F.col("name"))).select("method_id", F.col("code").alias("what"))
    named = m.where(full_match("name", "(?i).*(auth|login|verify|perm|authorize|secure).*")).select(F.col("id").alias("method_id"), F.col("name").alias("what"))
    returns = g.label("RETURN").join(ids, "method_id", "left_semi")
    barrier = library.auth_barrier(language)
    safe = returns.join(dominated(g, returns, barrier.filter(g, g.label("CALL", "IDENTIFIER"), True)), "id", "left_semi").select("method_id", F.lit("dominating check").alias("what"))
    every = own.unionByName(by_class).unionByName(calls).unionByName(named)
    every = every.unionByName(safe.join(every.select("method_id"), "method_id", "left_anti"))
    return every.groupBy("method_id").agg(F.array_sort(F.collect_set("what")).alias("guards"))


def sink_display(full_name: Column, name: Column) -> Column:
    """``Class.method`` of a callee; a constructor is its class."""
    clean = F.regexp_replace(F.split_part(full_name, F.lit("("), F.lit(1)), "<unresolvedNamespace>[.]|<unresolvedSignature>|<returnValue>", "")
    parts = F.filter(F.split(clean, "[:.]"), lambda p: p != "")
    last, owner = F.element_at(parts, -1), F.get(parts, F.size(parts) - 2)
    whole = F.when(last.isin("<init>", "__init__", ".ctor"), owner).when(last.isin("<member>", "<unknownFullName>"), F.concat_ws(".", owner, name)).otherwise(F.concat_ws(".", owner, last))
    return F.when(is_operator(full_name) | (full_name == "<unknownFullName>"), name).when(F.size(parts) >= 2, whole).otherwise(clean)


def is_frontend_path(path: Column) -> Column:
    """A path with a front-end folder and no back-end folder."""
    p = F.concat(F.lit("/"), F.lower(F.replace(path, F.lit("\\"), F.lit("/"))))
    front, back = F.lit(False), F.lit(False)
    for h in FRONTEND_PATH_HINTS:
        front = front | p.contains(f"/{h}")
    for h in BACKEND_PATH_HINTS:
        back = back | p.contains(f"/{h}")
    return front & ~back


def get_endpoints(g: Graph, language: str | None = None, depth: int = 10) -> DataFrame:
    """controller, action, full_name, is_protected, guards, capabilities; one row for each controller and action."""
    found = library.controller(language).filter(g, g.label("METHOD"))
    found = found.where(~full_match("full_name", _SKIP))
    if language == "javascript":
        found = found.where(~is_frontend_path(F.col("filename")))
    m = Scratch(g.spark, "endpoints").save(found.select("id", "name", "full_name", "filename", "line", "ast_parent_full_name"), "methods")
    way = routes(g)
    middle = way.select("method_id", F.explode("middleware").alias("id"))
    checks = guards_of(g, m.select("id").unionByName(middle.select("id")).distinct(), language)
    by_route = middle.join(checks.select(F.col("method_id").alias("id"), F.col("guards").alias("g")), "id").select("method_id", "g")
    guards = checks.withColumnRenamed("guards", "g").select("method_id", "g").unionByName(by_route).groupBy("method_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("g")))).alias("guards"))
    bypass = library.auth_bypass(language).filter(g, g.label("METHOD"), True).select(F.col("id").alias("method_id"), F.lit(True).alias("open"))
    heuristics = library.discovery_heuristics(language)
    out = m.withColumnRenamed("id", "method_id").join(way.select("method_id", "path"), "method_id", "left").join(guards, "method_id", "left").join(bypass, "method_id", "left")
    if heuristics:
        within = reach(method_calls(g).select("src", "dst"), m.select(F.col("id").alias("root"), F.col("id").alias("node")), depth)
        calls = g.label("CALL").where(~is_operator(F.col("method_full_name")) & ~F.col("method_full_name").rlike("^__(ecma|whatwg)")).select(F.col("method_id").alias("node"), "name", "method_full_name")
        seen = within.join(calls, "node").withColumnRenamed("root", "method_id")
        caps = category_evidence(seen, "method_id", first_category("method_full_name", heuristics), sink_display(F.col("method_full_name"), F.col("name")), 50)
        out = out.join(caps, "method_id", "left")
    else:
        out = out.withColumn("capabilities", F.expr("cast(null as map<string,array<string>>)"))
    owner = F.when(F.col("ast_parent_full_name").endswith(":program"), base_name(F.col("filename"))).otherwise(F.element_at(F.split("ast_parent_full_name", ":"), -1))
    action = F.coalesce("path", F.when(F.col("name").startswith("<lambda>") & F.col("line").isNotNull(), F.concat("name", F.lit(" (L"), F.col("line").cast("string"), F.lit(")"))).otherwise(F.col("name")))
    out = out.withColumn("controller", F.coalesce(owner, base_name(F.col("filename")), F.lit("<unknown>"))).withColumn("action", action)
    out = out.withColumn("guards", F.coalesce("guards", F.expr("cast(array() as array<string>)"))).withColumn("is_protected", (F.size("guards") > 0) & F.col("open").isNull())
    from .dominance import latest

    return latest(out, ["controller", "action"], "full_name").select("controller", "action", "full_name", "is_protected", "guards", "capabilities")


def display_name(controller: str) -> str:
    """Short name of a controller for a report."""
    module, found, _ = controller.partition("::program")
    if found:
        return module.replace("\\", "/").rsplit("/", 1)[-1]
    mark = next((m for m in (":", "/", "\\") if m in controller), None)
    if mark:
        return controller.rsplit(mark, 1)[-1]
    return controller if controller.endswith((".py", ".js", ".ts")) else controller.rsplit(".", 1)[-1]


def render(endpoints: Sequence) -> str:
    """The tree of endpoints as text."""
    out, by = ["Attack Surface"], {}
    for e in endpoints:
        by.setdefault(e["controller"], []).append(e)
    for c in sorted(by):
        out.append(f"  {display_name(c)}")
        for e in sorted(by[c], key=lambda x: x["action"]):
            guards = [" ".join(x.split()) for x in e["guards"]]
            guards = [x if len(x) <= 60 else x[:57] + "..." for x in guards]
            status = (f"Guarded: {', '.join(guards)}" if guards else "Protected?") if e["is_protected"] else "PUBLIC?"
            caps = " ".join(f"{k} ({', '.join(v[:3])})" for k, v in sorted((e["capabilities"] or {}).items()))
            out.append(f"    {e['action']}  [{status}]" + (f"  {caps}" if caps else ""))
    return "\n".join(out)
