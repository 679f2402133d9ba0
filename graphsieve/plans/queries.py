"""Registered queries of the engine, and the same results in SQL for DuckDB.

Each query builds a graph over the test tables, applies one operator to all of it and
selects comparable columns.  Lists are joined to texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import analyses as A
from ..operators import findings as D
from ..operators import regions, scoring
from ..operators.closure import flow_edges, flows, reach
from ..operators.patterns import Any, Call, Field, Identifier, Literal, Method, Parameter, Return, Var
from ..operators.query import Query, execute
from ..rules import scoring as words
from . import projections as P

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def register(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


ORDERED = "e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events)"


# ------------------------------------------------------------------ scans and predicates
@register("SELECT event_id AS id, event_type AS name FROM events WHERE regexp_full_match(event_type, '(signup|purch.*)')")
def q_scan_call_regex(spark, sf):
    return Call(name="(signup|purch.*)").scan(P.events(spark, sf)).select("id", "name")


@register("SELECT l_orderkey AS call, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1")
def q_scan_literal(spark, sf):
    g = P.order_calls(spark, sf)
    found = Literal("R").scan(g).select(F.col("id").alias("arg"))
    return g.argument().join(found.groupBy("arg").count(), "arg").groupBy("call").agg(F.count("*").alias("n"))


@register("SELECT n_name AS name FROM nation WHERE regexp_full_match(n_name, 'NATION_1.*')")
def q_scan_identifier(spark, sf):
    return Identifier("NATION_1.*").scan(P.fields(spark, sf)).select("name")


@register("""SELECT event_type AS label_name, count(*) AS n FROM events WHERE props LIKE '%7%' AND event_type <> 'error' AND event_type IN ('click', 'view', 'error') GROUP BY 1""")
def q_pattern_and(spark, sf):
    class PropsWith7(Call):
        """A user-defined pattern: a call whose code holds a 7."""

        def condition(self, context=False):
            return super().condition(context) & F.col("code").contains("7")

        def filter(self, g, nodes, context=False):
            return nodes.where(self.condition(context))

    p = PropsWith7() & Call(name="(click|view|error)") & ~Call(name="error")
    return p.scan(P.events(spark, sf)).groupBy(F.col("name").alias("label_name")).agg(F.count("*").alias("n"))


@register("""SELECT o_orderkey AS id FROM orders o WHERE o_orderstatus = 'P' OR EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l_linenumber = 1 AND l_returnflag = 'A')""")
def q_pattern_or(spark, sf):
    return (Call(name="P") | Call(args=["A"])).scan(P.order_calls(spark, sf)).select("id")


@register("""SELECT o_orderkey AS id FROM orders o WHERE o_orderstatus = 'O' AND NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l_linenumber = 2 AND l_returnflag = 'R')""")
def q_pattern_not(spark, sf):
    return (Call(name="O") & ~Call(args=[None, "R"])).scan(P.order_calls(spark, sf)).select("id")


@register("SELECT event_id AS id FROM events WHERE event_type = 'purchase' AND regexp_matches('user_' || user_id, 'user_1[0-5]')")
def q_inside(spark, sf):
    return Call(name="purchase").inside(Method(name="user_1[0-5]")).scan(P.events(spark, sf)).select("id")


@register("""SELECT o_orderkey AS id FROM orders o WHERE o_orderstatus = 'F'
 AND EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l_linenumber = 1 AND l_returnflag = 'R')
 AND EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l_linenumber = 2)""")
def q_arg_semi(spark, sf):
    return Call(name="F", args=["R", "$X"]).scan(P.order_calls(spark, sf)).select("id")


@register("""SELECT DISTINCT a.l_orderkey AS id FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey JOIN orders o ON o.o_orderkey = a.l_orderkey
 WHERE a.l_linenumber = 1 AND b.l_linenumber = 2 AND a.l_returnflag = b.l_returnflag""")
def q_arg_unify(spark, sf):
    return Call(args=["$X", "$X"]).scan(P.order_calls(spark, sf)).select("id")


@register("SELECT o_orderkey AS id FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment LIKE '%BUILD%'")
def q_receiver_type(spark, sf):
    return Call(receiver_type="BUILD").scan(P.order_calls(spark, sf)).select("id")


@register("""SELECT o_orderkey AS id FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
 WHERE regexp_full_match(n_name, 'NATION_1.') AND c_mktsegment = 'BUILDING' AND o_orderpriority = '1-URGENT'""")
def q_field_chain(spark, sf):
    g = P.fields(spark, sf).materialize()  # a union of five tables: written by label, hops scan only what they follow
    return Field(Field(Identifier("NATION_1."), "BUILDING"), "1-URGENT").scan(g).select("id")


_SIGNED = f"WITH {ORDERED} SELECT event_id AS id FROM e WHERE event_type = 'purchase' AND {{}} EXISTS (SELECT 1 FROM e s WHERE s.user_id = e.user_id AND s.event_type = 'signup' AND s.pos < e.pos)"


@register(_SIGNED.format(""))
def q_dominated_by(spark, sf):
    return Call(name="purchase").is_dominated_by(Call(name="signup")).scan(P.events(spark, sf)).select("id")


@register(_SIGNED.format("NOT"))
def q_not_dominated(spark, sf):
    return Call(name="purchase").is_not_dominated_by(Call(name="signup")).scan(P.events(spark, sf)).select("id")


@register("""SELECT conv_id * 1000 + turn AS id FROM conversations c WHERE role = 'assistant'
 AND NOT EXISTS (SELECT 1 FROM conversations s WHERE s.conv_id = c.conv_id AND s.role = 'system' AND s.turn < c.turn)""")
def q_missing_auth(spark, sf):
    """The rule form, with dominators from control flow graphs."""
    q = Query.source(Call(name="assistant").is_not_dominated_by(Call(name="system")))
    return execute(P.conversations(spark, sf), q).select(F.col("node_id").alias("id"))


# ------------------------------------------------------------------ flows
@register(f"""WITH {ORDERED} SELECT a.event_id AS source_id, b.event_id AS sink_id, (b.pos - a.pos) AS depth FROM e a JOIN e b ON a.user_id = b.user_id
 WHERE a.event_type = 'signup' AND b.event_type = 'purchase' AND a.pos < b.pos""")
def q_flow_single(spark, sf):
    out = execute(P.events(spark, sf), Query.source(Call(name="signup")) >> Call(name="purchase"))
    return out.select("source_id", F.col("node_id").alias("sink_id"), F.col("depth").cast("long").alias("depth"))


@register(f"""WITH {ORDERED} SELECT DISTINCT a.event_id AS source_id, b.event_id AS sink_id FROM e a JOIN e m ON a.user_id = m.user_id JOIN e b ON a.user_id = b.user_id
 WHERE a.event_type = 'signup' AND m.event_type = 'click' AND b.event_type = 'purchase' AND a.pos < m.pos AND m.pos < b.pos""")
def q_flow_multi(spark, sf):
    out = execute(P.events(spark, sf), Query.source(Call(name="signup")) >> Call(name="click") >> Call(name="purchase"))
    return out.select("source_id", F.col("node_id").alias("sink_id"))


@register(f"""WITH {ORDERED}, c AS (SELECT *, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY pos) AS gate FROM e)
 SELECT a.event_id AS source_id, b.event_id AS sink_id FROM c a JOIN c b ON a.user_id = b.user_id AND a.gate = b.gate
 WHERE a.event_type = 'signup' AND b.event_type = 'purchase' AND a.pos < b.pos""")
def q_flow_sanitized(spark, sf):
    q = (Query.source(Call(name="signup")) >> Call(name="purchase")).passes_not(Call(name="error"))
    return execute(P.events(spark, sf), q).select("source_id", F.col("node_id").alias("sink_id"))


@register(f"""WITH {ORDERED} SELECT a.event_id AS source_id, b.event_id AS sink_id, a.props AS value FROM e a JOIN e b ON a.user_id = b.user_id
 WHERE a.event_type = 'view' AND b.event_type = 'purchase' AND a.pos < b.pos AND a.props = b.props""")
def q_flow_unify(spark, sf):
    q = Query.source(Call(name="view") & Var("$P")) >> (Call(name="purchase") & Var("$P"))
    return execute(P.events(spark, sf), q).select("source_id", F.col("node_id").alias("sink_id"), F.element_at("bindings", "$P").alias("value"))


@register("""SELECT o_orderkey AS id, max(a.l_returnflag) AS first_code, o_orderstatus AS callee FROM orders JOIN lineitem a ON a.l_orderkey = o_orderkey AND a.l_linenumber = 1
 GROUP BY 1, 3 HAVING count(DISTINCT a.l_returnflag) = 1""")
def q_bindings_map(spark, sf):
    out = execute(P.order_calls(spark, sf), Query.source(Call(name="$F", args=["$A"])))
    one = out.select("node_id", "name", F.element_at("bindings", "$A").alias("a")).groupBy("node_id", "name").agg(F.max("a").alias("first_code"), F.countDistinct("a").alias("n"))
    return one.where("n = 1").select(F.col("node_id").alias("id"), "first_code", F.col("name").alias("callee"))


_TRADE = f"""t AS (SELECT {P.SPAN} + n_regionkey AS src, {2 * P.SPAN} + n_nationkey AS dst FROM nation UNION ALL SELECT {2 * P.SPAN} + c_nationkey, {3 * P.SPAN} + c_custkey FROM customer
 UNION ALL SELECT {3 * P.SPAN} + o_custkey, {4 * P.SPAN} + o_orderkey FROM orders)"""


@register(f"""WITH RECURSIVE {_TRADE}, w AS (SELECT {P.SPAN} + r_regionkey AS root, {P.SPAN} + r_regionkey AS node, 0 AS depth FROM region UNION SELECT root, dst, depth + 1 FROM w JOIN t ON src = node WHERE depth < 3)
 SELECT root, node, min(depth) AS depth FROM w GROUP BY 1, 2""")
def q_reach_depth(spark, sf):
    g = P.trade(spark, sf)
    roots = P.table(spark, sf, "region").select((P.SPAN + F.col("r_regionkey")).alias("root")).withColumn("node", F.col("root"))
    return reach(flow_edges(g), roots, 3).select("root", "node", F.col("depth").cast("long").alias("depth"))


@register(f"""WITH {_TRADE} SELECT {2 * P.SPAN} + n_nationkey AS root, count(DISTINCT a.dst) AS customers, count(b.dst) AS orders FROM nation LEFT JOIN t a ON a.src = {2 * P.SPAN} + n_nationkey LEFT JOIN t b ON b.src = a.dst GROUP BY 1""")
def q_calltree(spark, sf):
    g = P.trade(spark, sf)
    roots = P.table(spark, sf, "nation").select((2 * P.SPAN + F.col("n_nationkey")).alias("id"))
    tree = A.call_tree(g.links("DDG").select("src", "dst"), roots, 2)
    return tree.groupBy("root").agg(F.count_if(F.col("depth") == 1).alias("customers"), F.count_if(F.col("depth") == 2).alias("orders"))


@register("SELECT c_name AS name, r_name || '.' || n_name || '.' || c_name AS path FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def q_method_path(spark, sf):
    """The chain of AST parents of each customer, joined from the root."""
    g = P.trade(spark, sf)
    names = g.nodes.select(F.col("id").alias("node"), "name")
    up = g.links("AST").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    own = P.table(spark, sf, "customer").select((3 * P.SPAN + F.col("c_custkey")).alias("root")).withColumn("node", F.col("root"))
    chain = reach(up, own, 8).join(names, "node")
    parts = chain.groupBy("root").agg(F.array_sort(F.collect_list(F.struct((-F.col("depth")).alias("d"), "name"))).alias("p"))
    return parts.select(F.element_at("p", -1)["name"].alias("name"), F.array_join(F.transform("p", lambda x: x["name"]), ".").alias("path"))


# ------------------------------------------------------------------ slices
@register(f"""WITH {_TRADE}, s AS (SELECT {4 * P.SPAN} + o_orderkey AS id FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'P'),
 l1 AS (SELECT DISTINCT src AS id FROM t JOIN s ON dst = s.id), l2 AS (SELECT DISTINCT src AS id FROM t JOIN l1 ON dst = l1.id)
 SELECT id FROM s UNION SELECT id FROM l1 UNION SELECT id FROM l2""")
def q_slice_backward(spark, sf):
    g = P.trade(spark, sf)
    ends = P.table(spark, sf, "orders").where("o_orderpriority = '1-URGENT' and o_orderstatus = 'P'").select(F.lit(0).cast("long").alias("root"), (4 * P.SPAN + F.col("o_orderkey")).alias("node"))
    edges = flow_edges(g).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return reach(edges, ends, 2).select(F.col("node").alias("id"))


@register(f"""WITH {_TRADE}, n AS (SELECT {2 * P.SPAN} + n_nationkey AS id FROM nation UNION ALL SELECT {3 * P.SPAN} + c_custkey FROM customer)
 SELECT id, (SELECT count(*) FROM t WHERE dst = id) AS indegree, (SELECT count(*) FROM t WHERE src = id) AS outdegree FROM n""")
def q_slice_degrees(spark, sf):
    g = P.trade(spark, sf)
    inner = g.nodes.where((F.col("id") >= 2 * P.SPAN) & (F.col("id") < 4 * P.SPAN))
    return D.degrees(flow_edges(g), inner)


# ------------------------------------------------------------------ lists
@register("SELECT DISTINCT 'event.' || event_type AS full_name FROM events WHERE event_type LIKE '%i%'")
def q_list_calls(spark, sf):
    return A.list_calls(P.events(spark, sf), ".*i.*")


@register("SELECT DISTINCT 'user_' || user_id AS full_name FROM events WHERE CAST(user_id AS VARCHAR) LIKE '%7'")
def q_list_methods(spark, sf):
    return A.list_methods(P.events(spark, sf), "user_.*7", internal_only=True).select("full_name")


@register("SELECT c_name AS name FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o_orderpriority = '1-URGENT' AND o_orderstatus = 'P')")
def q_entry_points(spark, sf):
    from ..graph import Graph

    g = P.trade(spark, sf)
    urgent = P.table(spark, sf, "orders").where("o_orderpriority = '1-URGENT' and o_orderstatus = 'P'")
    calls = urgent.select((4 * P.SPAN + F.col("o_orderkey")).alias("src"), (3 * P.SPAN + F.col("o_custkey")).alias("dst"), F.lit("CALL").alias("label"))
    return A.list_methods(Graph(g.nodes, calls), "Customer#.*", entry_points_only=True).select("name")


@register("SELECT event_type AS name, 'event.' || event_type AS full_name, 'user_' || user_id AS caller, props AS code FROM events WHERE event_type IN ('error', 'purchase')")
def q_find_calls(spark, sf):
    return A.find_calls(P.events(spark, sf), "error|purchase").select("name", "full_name", "caller", "code")


@register("""SELECT 'user_' || user_id AS full_name, count(DISTINCT event_type || props) AS calls FROM events WHERE 'user_' || user_id IN ('user_7', 'user_11') GROUP BY 1""")
def q_method_details(spark, sf):
    g = P.events(spark, sf)
    both = A.method_details(g, "user_7").unionByName(A.method_details(g, "user_11"))
    return both.select("full_name", F.size("calls_out").cast("long").alias("calls"))


_HOST = "regexp_extract(url, '^https?://([^/]+)', 1)"


@register(f"SELECT split_part({_HOST}, '.', 1) AS module, string_agg(DISTINCT {_HOST}, ',' ORDER BY {_HOST}) AS names FROM pages GROUP BY 1")
def q_api_summary(spark, sf):
    from ..graph import Graph

    p = P.pages(spark, sf)
    nodes = p.select(F.col("page_id").alias("id"), F.lit("CALL").alias("label"), F.col("host").alias("method_full_name"))
    out = A.api_summary(Graph(nodes, spark.createDataFrame([], "src long, dst long, label string")))
    return out.select("module", F.array_join("names", ",").alias("names"))


@register("""SELECT event_type AS full_name, count(*) AS calls, (SELECT string_agg(p, '|' ORDER BY p) FROM (SELECT DISTINCT props AS p FROM events i WHERE i.event_type = o.event_type ORDER BY p LIMIT 3)) AS codes FROM events o GROUP BY event_type""")
def q_group_simple(spark, sf):
    e = P.table(spark, sf, "events").select(F.col("event_type").alias("full_name"), F.col("props").alias("code"))
    return D.group_codes(e).select("full_name", "calls", F.array_join("codes", "|").alias("codes"))


# ------------------------------------------------------------------ heuristics
_HEUR = (A.Heuristic("Return", ("flag\\.R",), 10, ("1-URGENT",)), A.Heuristic("Archive", ("flag\\.A",), 7, ("5-LOW", "2-HIGH")))


@register("""WITH c AS (SELECT o_orderkey, l_returnflag, CASE WHEN l_returnflag = 'R' THEN 10 + CASE WHEN o_orderpriority = '1-URGENT' THEN 5 ELSE 0 END ELSE 7 + CASE WHEN o_orderpriority IN ('5-LOW', '2-HIGH') THEN 5 ELSE 0 END END AS score
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linestatus = 'O' AND l_returnflag IN ('R', 'A'))
 SELECT 'Order#' || o_orderkey AS full_name, max(score) AS score, count(DISTINCT l_returnflag) AS calls FROM c GROUP BY 1""")
def q_wrappers_score(spark, sf):
    """Orders are methods with their priority as a parameter, lines are calls, open lines take the parameter."""
    from ..graph import Graph

    o, li = P.table(spark, sf, "orders"), P.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_partkey", "l_suppkey")
    key = F.pmod(F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus"), F.lit(P.SPAN))
    ok = F.col("o_orderkey")
    methods = o.select((P.SPAN + ok).alias("id"), F.lit("METHOD").alias("label"), F.concat(F.lit("Order#"), ok.cast("string")).alias("name")).withColumn("full_name", F.col("name"))
    params = o.select((2 * P.SPAN + ok).alias("id"), F.lit("METHOD_PARAMETER_IN").alias("label"), F.col("o_orderpriority").alias("name"), (P.SPAN + ok).alias("method_id"), F.lit(1).alias("ord"))
    calls = li.select((3 * P.SPAN + key).alias("id"), F.lit("CALL").alias("label"), F.col("l_returnflag").alias("name"), F.concat(F.lit("flag."), "l_returnflag").alias("method_full_name"), (P.SPAN + F.col("l_orderkey")).alias("method_id"))
    args = li.select((4 * P.SPAN + key).alias("id"), F.lit("IDENTIFIER").alias("label"))
    nodes = methods.unionByName(params, allowMissingColumns=True).unionByName(calls, allowMissingColumns=True).unionByName(args, allowMissingColumns=True)
    edges = li.select((3 * P.SPAN + key).alias("src"), (4 * P.SPAN + key).alias("dst"), F.lit("ARGUMENT").alias("label"), F.lit(1).alias("idx"))
    flow = li.where("l_linestatus = 'O'").select((2 * P.SPAN + F.col("l_orderkey")).alias("src"), (4 * P.SPAN + key).alias("dst"), F.lit("DDG").alias("label"), F.lit(None).cast("int").alias("idx"))
    out = A.discover_wrappers(Graph(nodes, edges.unionByName(flow)), _HEUR)
    return out.select("full_name", F.col("score").cast("long").alias("score"), F.size("calls").cast("long").alias("calls"))


@register(f"""WITH p AS (SELECT {_HOST} AS host, regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1) AS path FROM pages)
 SELECT host AS controller, count(DISTINCT path) AS actions, max(struct_pack(n := length(path), p := path)).p AS longest FROM p GROUP BY 1""")
def q_endpoints(spark, sf):
    p = P.pages(spark, sf)
    return p.groupBy(F.col("host").alias("controller")).agg(F.countDistinct("path").alias("actions"), F.max(F.struct(F.length("path").alias("n"), F.col("path").alias("p")))["p"].alias("longest"))


_CAPABILITIES = (("Contact", r"\w+@\w+"), ("Money", r"\b\d{16}\b"), ("Network", r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b"), ("License", "[Ll]icen[sc]e"))


@register("SELECT doc_id, string_agg(c, ',' ORDER BY c) AS categories FROM (" + " UNION ALL ".join(f"SELECT doc_id, '{c}' AS c FROM documents WHERE regexp_matches(text, '{p}')" for c, p in _CAPABILITIES) + ") GROUP BY 1")
def q_capabilities(spark, sf):
    d = P.table(spark, sf, "documents")
    tags = F.array_compact(F.array(*[F.when(F.col("text").rlike(p), F.lit(c)) for c, p in _CAPABILITIES]))
    rows = d.select("doc_id", F.explode(tags).alias("category"), F.lit("x").alias("evidence"))
    out = A.category_evidence(rows, "doc_id", F.col("category"), F.col("evidence"))
    return out.select("doc_id", F.array_join(F.array_sort(F.map_keys("capabilities")), ",").alias("categories"))


@register(f"""SELECT page_id, CASE WHEN r = '' THEN CASE WHEN p = '' THEN '/' ELSE '/' || p END ELSE '/' || p || '/' || r END AS full_path FROM
 (SELECT page_id, rtrim(split_part({_HOST}, '.', 1), '/') AS p, ltrim(regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1), '/') AS r FROM pages)""")
def q_join_path(spark, sf):
    p = P.pages(spark, sf)
    return p.select("page_id", X.join_path(F.split_part("host", F.lit("."), F.lit(1)), F.col("path")).alias("full_path"))


# ------------------------------------------------------------------ reports
@register(f"""WITH {ORDERED} SELECT event_id AS id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, props ORDER BY length(event_type) DESC, event_id) AS r FROM e) WHERE r = 1""")
def q_match_dedup(spark, sf):
    e = P.table(spark, sf, "events").select(F.col("event_id").alias("node_id"), F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("file"), F.lit(0).alias("line"), F.col("event_type").alias("code"), F.create_map(F.lit("$P"), F.col("props")).alias("bindings"))
    rows = e.withColumns({"source_method": F.lit(None).cast("string"), "source_code": F.lit(None).cast("string"), "source_id": F.lit(None).cast("long")})
    return D.deduplicate(rows).select(F.col("node_id").alias("id"))


@register("""SELECT event_id AS id, r AS rank, greatest(0, n - 3) AS hidden FROM (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY length(props) DESC, event_id) AS r, count(*) OVER (PARTITION BY event_type, user_id) AS n FROM events) WHERE r <= 3""")
def q_top_findings(spark, sf):
    e = P.table(spark, sf, "events").select(F.col("event_id").alias("node_id"), F.col("event_type").alias("rule"), F.col("user_id").alias("file"), F.col("props").alias("code"))
    return D.top_findings(e, 3).select(F.col("node_id").alias("id"), F.col("rank").cast("long").alias("rank"), "hidden")


@register("""SELECT event_type AS rule, CAST(value / 10 AS BIGINT) AS severity, count(*) AS findings, count(DISTINCT user_id) AS files FROM (SELECT event_type, user_id, floor(least(value, 49.9) / 10) * 10 AS value FROM events) GROUP BY ROLLUP (event_type, CAST(value / 10 AS BIGINT))""")
def q_exec_summary(spark, sf):
    e = P.table(spark, sf, "events").select(F.col("event_type").alias("rule"), F.floor(F.least("value", F.lit(49.9)) / 10).cast("long").alias("severity"), F.col("user_id").alias("file"))
    return D.executive_summary(e)


def _count_sql(word: str) -> str:
    return f"((length(t) - length(replace(t, '{word}', ''))) // {len(word)})"


_HITS = " + ".join(f"CAST(contains(t, '{w}') AS INT)" for w in words.SECURITY_KEYWORDS)
_TOTAL = " + ".join(_count_sql(w) for w in words.SECURITY_KEYWORDS)
_GUARDS = " + ".join(f"CAST(contains(t, '{w}') AS INT)" for w in words.AUTH_GUARD_KEYWORDS)
_SCORED = f"""s AS (SELECT doc_id, path, n, least(5 * hits, 50) - CASE WHEN hits > 0 AND total - hits >= 10 AND total >= 3 * hits THEN least(2 * (total - hits), 40) ELSE 0 END + least(15 * guards, 45) - CASE WHEN path LIKE 'public/%' THEN 60 ELSE 0 END AS score
 FROM (SELECT doc_id, path, n, {_HITS} AS hits, {_TOTAL} AS total, {_GUARDS} AS guards FROM (SELECT doc_id, CASE WHEN lang = 'fr' THEN 'public/' ELSE 'srv/' END || doc_id || '.txt' AS path, lower(text) AS t, ceil(length(text) / 4.0) AS n FROM documents)))"""


def _files(spark: SparkSession, sf: str) -> DataFrame:
    d = P.table(spark, sf, "documents")
    top = F.when(F.col("lang") == "fr", "public/").otherwise("srv/")
    return d.select("doc_id", F.concat(top, F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.col("text").alias("content"))


@register(f"WITH {_SCORED} SELECT doc_id, path, CAST(score AS BIGINT) AS score FROM s")
def q_file_score(spark, sf):
    return scoring.score_files(_files(spark, sf)).select("doc_id", "path", F.col("score").cast("long").alias("score"))


@register(f"WITH {_SCORED} SELECT path, CAST(used AS BIGINT) AS used FROM (SELECT path, sum(n) OVER (ORDER BY score DESC, path ROWS UNBOUNDED PRECEDING) AS used FROM s) WHERE used <= 100000")
def q_pack_budget(spark, sf):
    scored = scoring.score_files(_files(spark, sf)).select("path", "score", X.token_estimate(F.col("content")).alias("tokens"))
    return D.budget_prefix(scored, 100_000).select("path", "used")


@register(f"""WITH RECURSIVE {_TRADE}, w AS (SELECT {3 * P.SPAN} + c_custkey AS id, 0 AS d FROM customer WHERE c_mktsegment = 'MACHINERY' UNION SELECT src, d + 1 FROM w JOIN t ON dst = id WHERE d < 5)
 SELECT id, min(d) AS distance FROM w GROUP BY 1""")
def q_min_distance(spark, sf):
    g = P.trade(spark, sf)
    hits = P.table(spark, sf, "customer").where("c_mktsegment = 'MACHINERY'").select(F.lit(0).cast("long").alias("root"), (3 * P.SPAN + F.col("c_custkey")).alias("node"))
    back = flow_edges(g).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return reach(back, hits, 5).groupBy(F.col("node").alias("id")).agg(F.min("depth").cast("long").alias("distance"))


@register("""WITH l AS (SELECT DISTINCT user_id, CAST(floor(epoch(ts)) AS BIGINT) // 3600 AS line FROM events), m AS (SELECT *, CASE WHEN line - lag(line) OVER (PARTITION BY user_id ORDER BY line) > 10 THEN 1 ELSE 0 END AS brk FROM l),
 b AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY line) AS block FROM m) SELECT user_id, block, min(line) AS first_line, max(line) AS last_line, count(*) AS lines FROM b GROUP BY 1, 2""")
def q_line_gaps(spark, sf):
    seconds = F.unix_timestamp(F.col("ts").cast("timestamp"))
    lines = P.table(spark, sf, "events").select("user_id", F.floor(seconds / 3600).cast("long").alias("line")).distinct()
    return D.blocks(lines, ["user_id"])


@register("""WITH c AS (SELECT conv_id, turn, role FROM conversations), m AS (SELECT *, CASE WHEN lag(role) OVER (PARTITION BY conv_id ORDER BY turn) = role THEN 0 ELSE 1 END AS brk FROM c),
 r AS (SELECT *, sum(brk) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM m) SELECT conv_id, run, role, min(turn) AS first_turn FROM r GROUP BY 1, 2, 3""")
def q_runs(spark, sf):
    c = P.table(spark, sf, "conversations").select("conv_id", F.col("turn").alias("k"), F.lit("f").alias("file"), F.lit(0).alias("line"), F.col("role").alias("method"), F.lit("").alias("code"))
    return D.runs(c, ["conv_id"]).select("conv_id", F.col("run").cast("long").alias("run"), F.col("method").alias("role"), F.col("k").alias("first_turn"))


@register(f"""WITH {ORDERED}, g AS (SELECT user_id, event_type, min(pos) AS k, bool_or(event_type = 'purchase') AS sink FROM e GROUP BY 1, 2)
 SELECT user_id, event_type, CASE WHEN sink THEN 'SINK' ELSE CAST(sum(CASE WHEN sink THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY k) AS VARCHAR) END AS step FROM g""")
def q_step_labels(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = P.table(spark, sf, "events").select(F.col("user_id").alias("match"), F.row_number().over(w).alias("k"), F.col("event_type").alias("file"), F.lit(0).alias("line"), F.col("props").alias("code"), (F.col("event_type") == "purchase").alias("is_sink"))
    return D.steps_of(e).select(F.col("match").alias("user_id"), F.col("file").alias("event_type"), "step")


@register(r"""SELECT doc_id, regexp_replace(regexp_replace(trim(regexp_replace(text, '[ \t\n\r\f\v]+', ' ', 'g')), ' *;+ *$', ''), '^\((.*)\)$', '\1') AS code FROM documents""")
def q_step_normalise(spark, sf):
    return P.table(spark, sf, "documents").select("doc_id", X.normalize_step(F.col("text")).alias("code"))


@register(r"""SELECT event_id, array_to_string(regexp_extract_all(props, '"(\w+)"', 1), ',') AS names FROM events""")
def q_interpolated(spark, sf):
    e = P.table(spark, sf, "events")
    braces = F.regexp_replace(F.regexp_replace("props", "[{}]", ""), r'"(\w+)"', r"{$1}")
    return e.select("event_id", F.array_join(X.interpolated(braces), ",").alias("names"))


@register(r"""WITH p AS (SELECT DISTINCT props, trim(props) AS c FROM events),
 l AS (SELECT props, c, list_concat([c], CASE WHEN contains(c, ',') THEN list_transform(string_split(c, ','), lambda x: regexp_replace(trim(x), '^["''`]+|["''`]+$', '', 'g')) ELSE [] END,
  CASE WHEN contains(c, '=') THEN [trim(substr(c, strpos(c, '=') + 1))] ELSE [] END, regexp_extract_all(c, '[A-Za-z_][\w.]*\s*\([^)]*\)'), regexp_extract_all(c, '[A-Za-z_][\w.]*')) AS v FROM p),
 t AS (SELECT props, c, list_transform(v, lambda x: trim(x)) AS v FROM l),
 u AS (SELECT props, c, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM t),
 d AS (SELECT props, c, x, min(i) AS i FROM u WHERE length(x) > 2 AND NOT (upper(x) IN ('SELECT', 'FROM', 'WHERE', 'AND', 'OR', 'LIKE', 'ORDER', 'BY', 'LIMIT', 'INSERT', 'INTO', 'VALUES', 'UPDATE', 'SET', 'DELETE', 'NULL', 'IS') AND length(x) < length(c)) GROUP BY 1, 2, 3)
 SELECT props, string_agg(x, '|' ORDER BY -length(x), i) AS candidates FROM d GROUP BY 1""")
def q_candidates(spark, sf):
    e = P.table(spark, sf, "events").select("props").distinct()
    return e.select("props", F.array_join(X.candidates(F.col("props")), "|").alias("candidates"))


_REPORTS = "r AS (SELECT doc_id, 2 + doc_id % 3 AS line, split_part(text, ' ', 4) AS snippet FROM documents WHERE split_part(text, ' ', 4) <> '')"


@register(f"""WITH {_REPORTS}, l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
 h AS (SELECT r.doc_id, r.line, l.pos, CASE WHEN abs(l.pos - r.line) <= 2 THEN abs(l.pos - r.line) ELSE 3 END AS near FROM r JOIN l ON l.doc_id = r.doc_id AND contains(l.t, r.snippet))
 SELECT r.doc_id, (SELECT first(h.pos ORDER BY near, h.pos) FROM h WHERE h.doc_id = r.doc_id) AS found_line FROM r""")
def q_region_fuzzy(spark, sf):
    d = P.table(spark, sf, "documents")
    files = d.select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"))
    snippet = F.split_part("text", F.lit(" "), F.lit(4))
    reports = d.select(F.col("doc_id").alias("key"), F.col("doc_id").cast("string").alias("path"), (2 + F.col("doc_id") % 3).alias("line"), snippet.alias("snippet")).where("snippet <> ''")
    return regions.resolve_regions(reports, regions.file_lines(files)).select(F.col("key").alias("doc_id"), F.col("found_line").cast("long").alias("found_line"))


@register("""SELECT event_id AS id, CASE WHEN s >= 4 THEN 'error' WHEN s = 3 THEN 'warning' ELSE 'note' END AS level, CASE s WHEN 5 THEN 95.0 WHEN 4 THEN 80.0 WHEN 3 THEN 50.0 WHEN 2 THEN 25.0 ELSE 10.0 END AS rank
 FROM (SELECT event_id, CASE event_type WHEN 'error' THEN 5 WHEN 'purchase' THEN 4 WHEN 'signup' THEN 3 WHEN 'click' THEN 2 ELSE 1 END AS s FROM events)""")
def q_sarif_rows(spark, sf):
    kind = F.col("event_type")
    s = F.when(kind == "error", 5).when(kind == "purchase", 4).when(kind == "signup", 3).when(kind == "click", 2).otherwise(1)
    e = P.table(spark, sf, "events")
    return e.select(F.col("event_id").alias("id"), X.sarif_level(s).alias("level"), X.sarif_rank(s).alias("rank"))


@register("SELECT CAST(count(*) AS BIGINT) AS calls FROM events WHERE event_type = 'error'")
def q_raw_sql(spark, sf):
    """The raw escape hatch."""
    return P.events(spark, sf).sql("SELECT count(*) AS calls FROM {nodes} WHERE label = 'CALL' AND name = 'error'")


@register(f"""WITH {ORDERED}, n AS (SELECT *, count(*) FILTER (event_type IN ('purchase', 'signup', 'view')) OVER (PARTITION BY user_id ORDER BY pos) AS walls FROM e)
 SELECT a.event_id AS source_id, b.event_id AS sink_id, b.pos - a.pos AS depth FROM n a JOIN n b ON a.user_id = b.user_id AND a.walls = b.walls AND b.pos > a.pos WHERE a.event_type = 'click' AND b.event_type = 'error'""")
def q_flow_fixpoint(spark, sf):
    """Flows by the semi-naive loop, however long: from a click to an error, no event of other types on the way."""
    g = P.events(spark, sf, chain=False)
    found = flows(g, Call(name="click").ids(g), Call(name="error").ids(g), Call(name="(purchase|signup|view)").ids(g), strict=True)
    return found.select(F.col("source").alias("source_id"), F.col("sink").alias("sink_id"), F.col("depth").cast("long").alias("depth"))


# ------------------------------------------------------------------ programs
_S = P.SPAN
_CALLED = f"SELECT {_S} + o_custkey AS src, CASE o_orderstatus WHEN 'F' THEN {9 * _S + 1} WHEN 'O' THEN {9 * _S + 2} ELSE {8 * _S + 1} END AS dst, o_orderkey % 7 AS line FROM orders"
_SINKS = (A.Heuristic("Done", ("sys:Order:F",), 10, ()), A.Heuristic("Pending", ("app:Order:P",), 5, ()))


@register(f"SELECT src, dst, CAST(min(line) AS BIGINT) AS line FROM ({_CALLED}) GROUP BY 1, 2")
def q_method_calls(spark, sf):
    """Call edges between methods; an external callee stands for the internal one of its class."""
    return A.method_calls(P.programs(spark, sf)).select("src", "dst", F.col("line").cast("long").alias("line"))


_TREE = f"""SELECT {_S} + c_custkey AS root, {_S} + c_custkey AS node, 0 AS depth, NULL AS category FROM customer
 UNION ALL SELECT DISTINCT src, dst, 1, CASE dst WHEN {9 * _S + 1} THEN 'Done' ELSE 'Pending' END FROM ({_CALLED}) WHERE dst <> {9 * _S + 2}"""


def _tree(spark, sf, **options):
    return A.call_graph(P.programs(spark, sf), ".*Customer#.*", depth=3, heuristics=_SINKS, **options)


@register(f"SELECT root, node, CAST(depth AS BIGINT) AS depth, category FROM ({_TREE})")
def q_call_graph(spark, sf):
    return _tree(spark, sf).select("root", "node", F.col("depth").cast("long").alias("depth"), "category")


@register(f"SELECT root, node, CAST(depth AS BIGINT) AS depth, category FROM ({_TREE}) WHERE root IN (SELECT root FROM ({_TREE}) WHERE depth = 1)")
def q_call_graph_interesting(spark, sf):
    """Only roots and branches from which a category is reached."""
    return _tree(spark, sf, interesting_only=True).select("root", "node", F.col("depth").cast("long").alias("depth"), "category")


@register(f"""SELECT category, CASE category WHEN 'Done' THEN 'sys:Order:F' ELSE 'app:Order:P' END AS sink, count(DISTINCT c_name) AS entries, min(c_name || ' (' || c_mktsegment || ')') AS first_entry
 FROM ({_TREE}) JOIN customer ON root = {_S} + c_custkey WHERE depth = 1 GROUP BY 1""")
def q_security_summary(spark, sf):
    out = A.security_summary(_tree(spark, sf))
    return out.select("category", "sink", F.size("entries").cast("long").alias("entries"), F.get("entries", F.lit(0)).alias("first_entry"))


@register(f"SELECT root, CAST(count(*) FILTER (depth = 1) AS BIGINT) AS interesting FROM ({_TREE}) GROUP BY 1")
def q_interesting_counts(spark, sf):
    return A.interesting_counts(_tree(spark, sf)).select("root", F.col("interesting").cast("long").alias("interesting"))


@register(f"SELECT {9 * _S + 1} AS id, 0 AS distance UNION ALL SELECT {8 * _S + 1}, 0 UNION ALL SELECT DISTINCT src, 1 FROM ({_CALLED}) WHERE dst <> {9 * _S + 2}")
def q_sink_distance(spark, sf):
    return A.sink_distance(P.programs(spark, sf), _SINKS).select("id", F.col("distance").cast("long").alias("distance"))


_F = f"f AS (SELECT o_orderkey, o_custkey, o_orderkey % 2 = 0 AS even FROM orders WHERE o_orderstatus = 'F')"


@register(f"""WITH {_F} SELECT {3 * _S} + o_orderkey AS id, true AS is_sink, false AS is_origin, false AS is_param_use FROM f
 UNION ALL SELECT {6 * _S} + o_orderkey, false, even, even FROM f UNION ALL SELECT DISTINCT {2 * _S} + o_custkey, false, true, false FROM f""")
def q_data_flow_slice(spark, sf):
    nodes, _ = A.data_flow_slice(P.programs(spark, sf), "F", 3)
    return nodes.select("id", "is_sink", "is_origin", "is_param_use")


@register(f"""WITH {_F} SELECT {6 * _S} + o_orderkey AS src, {3 * _S} + o_orderkey AS dst FROM f UNION ALL SELECT {2 * _S} + o_custkey, {6 * _S} + o_orderkey FROM f WHERE even""")
def q_data_flow_slice_edges(spark, sf):
    return A.data_flow_slice(P.programs(spark, sf), "F", 3)[1].select("src", "dst")


@register(f"""SELECT {2 * _S} + c_custkey AS object, c_mktsegment AS name, count(*) AS calls, string_agg(DISTINCT o_orderstatus || '1', ',' ORDER BY o_orderstatus || '1') AS passed_to
 FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 2 = 0 GROUP BY 1, 2 HAVING count(*) >= 2""")
def q_usage_slice(spark, sf):
    out = A.usage_slice(P.programs(spark, sf), 2)
    return out.select("object", "name", "calls", F.array_join(F.transform("passed_to", lambda x: F.concat(x["callee"], x["position"].cast("string"))), ",").alias("passed_to"))


@register(f"SELECT {2 * _S} + c_custkey AS id FROM customer WHERE regexp_matches(c_mktsegment, '^(BUILD|AUTO).*')")
def q_scan_parameter(spark, sf):
    return _ids(P.programs(spark, sf), Parameter("(BUILD|AUTO).*"))


@register(f"SELECT {4 * _S} + o_orderkey AS id FROM orders WHERE o_orderpriority = '1-URGENT'")
def q_scan_return(spark, sf):
    return _ids(P.programs(spark, sf), Return())


@register(f"SELECT {_S} + c_custkey AS id FROM customer WHERE c_name LIKE '%7' AND c_mktsegment = 'MACHINERY'")
def q_scan_method(spark, sf):
    """By name and parameter."""
    return _ids(P.programs(spark, sf), Method(name=".*7", parameter="MACHINERY"))


@register(f"SELECT {_S} + c_custkey AS id FROM customer WHERE c_nationkey < 5 AND c_mktsegment LIKE 'H%'")
def q_scan_annotated_method(spark, sf):
    return _ids(P.programs(spark, sf), Method(annotation="H.*"))


_EXPRESSIONS = f"""SELECT {3 * _S} + o_orderkey AS id FROM orders UNION ALL SELECT {4 * _S} + o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' UNION ALL SELECT {6 * _S} + o_orderkey FROM orders"""


@register(f"{_EXPRESSIONS} UNION ALL SELECT {2 * _S} + c_custkey FROM customer")
def q_scan_expression(spark, sf):
    return _ids(P.programs(spark, sf), Var("$X"))


@register(f"""{_EXPRESSIONS} UNION ALL SELECT {_S} + c_custkey FROM customer UNION ALL SELECT {2 * _S} + c_custkey FROM customer UNION ALL SELECT {5 * _S} + c_custkey FROM customer WHERE c_nationkey < 5
 UNION ALL SELECT unnest([{9 * _S + 1}, {9 * _S + 2}, {9 * _S + 3}, {8 * _S + 1}, {8 * _S + 2}])""")
def q_scan_all(spark, sf):
    return _ids(P.programs(spark, sf), Any())


def _ids(g, pattern):
    return pattern.ids(g).select("id").distinct()
