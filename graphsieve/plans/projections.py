"""Views of tabular data as property graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..graph import Graph

#: Ids of the trade graph: kind times SPAN plus key.
SPAN = 10**13


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str, chain: bool = True) -> Graph:
    """A method for each user, a call for each event, flow to the user's next event."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", "props").withColumn("pos", F.row_number().over(w))
    user = -(F.col("user_id") + 1)
    name = F.concat(F.lit("user_"), F.col("user_id").cast("string"))
    calls = e.select(F.col("event_id").alias("id"), F.lit("CALL").alias("label"), F.col("event_type").alias("name"), F.concat(F.lit("event."), "event_type").alias("method_full_name"), F.col("props").alias("code"), user.alias("method_id"), F.col("pos").cast("int").alias("line"), name.alias("filename"))
    methods = e.select("user_id").distinct().select(user.alias("id"), F.lit("METHOD").alias("label"), name.alias("name"), name.alias("full_name"), name.alias("filename"), F.lit(False).alias("is_external"))
    step = e.select(F.lag("event_id").over(w).alias("src"), F.col("event_id").alias("dst")).where("src is not null")
    edges = step.withColumn("label", F.lit("DDG")).unionByName(step.withColumn("label", F.lit("CFG")))
    nodes = calls.unionByName(methods, allowMissingColumns=True)
    return Graph(nodes, edges, e.select(F.col("event_id").alias("id"), F.col("user_id").alias("chain"), "pos") if chain else None, root="")


def conversations(spark: SparkSession, sf_dir: str) -> Graph:
    """A method for each conversation, a call named by role for each turn, control flow to the next turn."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", (F.col("conv_id") * 1000 + F.col("turn")).alias("id"))
    method = -(F.col("conv_id") + 1)
    calls = c.select("id", F.lit("CALL").alias("label"), F.col("role").alias("name"), method.alias("method_id"), F.col("turn").cast("int").alias("line"))
    methods = c.select("conv_id").distinct().select(method.alias("id"), F.lit("METHOD").alias("label"), F.concat(F.lit("conv_"), F.col("conv_id").cast("string")).alias("name"))
    w = Window.partitionBy("conv_id").orderBy("turn")
    step = c.select(F.lag("id").over(w).alias("src"), F.col("id").alias("dst"), F.lit("CFG").alias("label")).where("src is not null")
    return Graph(calls.unionByName(methods, allowMissingColumns=True), step, root="")


def order_calls(spark: SparkSession, sf_dir: str) -> Graph:
    """An order is a call named by status; its lines are literal arguments by line number, the customer its receiver."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_partkey", "l_suppkey").withColumn("id", -F.abs(F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus")))
    c = table(spark, sf_dir, "customer").select((SPAN + F.col("c_custkey")).alias("id"), "c_mktsegment", "c_custkey")
    calls = o.select(F.col("o_orderkey").alias("id"), F.lit("CALL").alias("label"), F.col("o_orderstatus").alias("name"), F.concat(F.lit("order."), "o_orderstatus").alias("method_full_name"), F.col("o_orderpriority").alias("code"))
    lines = li.select("id", F.lit("LITERAL").alias("label"), F.col("l_returnflag").alias("code"), F.col("l_linestatus").alias("name"))
    people = c.select("id", F.lit("IDENTIFIER").alias("label"), F.concat(F.lit("segment."), "c_mktsegment").alias("type_full_name"))
    nodes = calls.unionByName(lines, allowMissingColumns=True).unionByName(people, allowMissingColumns=True)
    args = li.select(F.col("l_orderkey").alias("src"), F.col("id").alias("dst"), F.lit("ARGUMENT").alias("label"), F.col("l_linenumber").cast("int").alias("idx"))
    receiver = o.select(F.col("o_orderkey").alias("src"), (SPAN + F.col("o_custkey")).alias("dst"), F.lit("ARGUMENT").alias("label"), F.lit(0).alias("idx"))
    return Graph(nodes, args.unionByName(receiver), root="")


def fields(spark: SparkSession, sf_dir: str) -> Graph:
    """Field accesses nation.segment.priority: each order of each customer of each nation."""
    n, c, o = (table(spark, sf_dir, t) for t in ("nation", "customer", "orders"))
    access, field = F.lit("<operator>.fieldAccess"), F.lit("FIELD_IDENTIFIER")
    nations = n.select((2 * SPAN + F.col("n_nationkey")).alias("id"), F.lit("IDENTIFIER").alias("label"), F.col("n_name").alias("name"), F.col("n_name").alias("code"))
    segments = c.select((SPAN + F.col("c_custkey")).alias("id"), F.lit("CALL").alias("label"), access.alias("name"))
    segment_names = c.select((3 * SPAN + F.col("c_custkey")).alias("id"), field.alias("label"), F.col("c_mktsegment").alias("code"))
    priorities = o.select(F.col("o_orderkey").alias("id"), F.lit("CALL").alias("label"), access.alias("name"))
    priority_names = o.select((4 * SPAN + F.col("o_orderkey")).alias("id"), field.alias("label"), F.col("o_orderpriority").alias("code"))
    nodes = nations
    for df in (segments, segment_names, priorities, priority_names):
        nodes = nodes.unionByName(df, allowMissingColumns=True)

    def arg(df: DataFrame, src, dst, idx: int) -> DataFrame:
        return df.select(src.cast("long").alias("src"), dst.cast("long").alias("dst"), F.lit("ARGUMENT").alias("label"), F.lit(idx).alias("idx"))

    ck, ok = F.col("c_custkey"), F.col("o_orderkey")
    edges = arg(c, SPAN + ck, 2 * SPAN + F.col("c_nationkey"), 1).unionByName(arg(c, SPAN + ck, 3 * SPAN + ck, 2))
    edges = edges.unionByName(arg(o, ok, SPAN + F.col("o_custkey"), 1)).unionByName(arg(o, ok, 4 * SPAN + ok, 2))
    return Graph(nodes, edges, root="")


def trade(spark: SparkSession, sf_dir: str) -> Graph:
    """region -> nation -> customer -> order by CALL and AST edges; methods all."""
    r, n, c, o = (table(spark, sf_dir, t) for t in ("region", "nation", "customer", "orders"))
    kinds = (
        (r.select(F.col("r_regionkey").cast("long").alias("k"), F.col("r_name").alias("name")), 1),
        (n.select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_name").alias("name")), 2),
        (c.select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name")), 3),
        (o.select(F.col("o_orderkey").alias("k"), F.concat(F.lit("Order#"), F.col("o_orderkey").cast("string")).alias("name")), 4),
    )
    nodes = None
    for df, kind in kinds:
        part = df.select((kind * SPAN + F.col("k")).alias("id"), F.lit("METHOD").alias("label"), "name", F.col("name").alias("full_name"), F.lit(False).alias("is_external"))
        nodes = part if nodes is None else nodes.unionByName(part)

    def edge(df: DataFrame, a: str, ka: int, b: str, kb: int) -> DataFrame:
        return df.select((ka * SPAN + F.col(a)).alias("src"), (kb * SPAN + F.col(b)).alias("dst"))

    steps = edge(n, "n_regionkey", 1, "n_nationkey", 2).unionByName(edge(c, "c_nationkey", 2, "c_custkey", 3)).unionByName(edge(o, "o_custkey", 3, "o_orderkey", 4))
    edges = steps.withColumn("label", F.lit("DDG")).unionByName(steps.withColumn("label", F.lit("AST")))
    return Graph(nodes, edges, root="")


def programs(spark: SparkSession, sf_dir: str) -> Graph:
    """A method for each customer with its segment as parameter, a call for each order.

    Calls go to external methods by status; ``P`` has an internal one of its class, ``O``
    a namesake in another class.  Every second order passes the parameter on, the others
    something else; urgent ones return; customers of the first nations are annotated.
    """
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority").join(c.select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey")
    ck, ok, owner, even = F.col("c_custkey"), F.col("o_orderkey"), SPAN + F.col("o_custkey"), F.col("o_orderkey") % 2 == 0
    methods = c.select((SPAN + ck).alias("id"), F.lit("METHOD").alias("label"), F.col("c_name").alias("name"), F.concat(F.lit("app:"), "c_mktsegment", F.lit(":"), "c_name").alias("full_name"), F.col("c_mktsegment").alias("filename"), F.lit(False).alias("is_external"))
    others = spark.createDataFrame([(9 * SPAN + 1, "F", "sys:Order:F", True), (9 * SPAN + 2, "O", "sys:Order:O", True), (9 * SPAN + 3, "P", "sys:Order:P", True), (8 * SPAN + 1, "P", "app:Order:P", False), (8 * SPAN + 2, "O", "app:Other:O", False)], "id long, name string, full_name string, is_external boolean").withColumn("label", F.lit("METHOD"))
    params = c.select((2 * SPAN + ck).alias("id"), F.lit("METHOD_PARAMETER_IN").alias("label"), F.col("c_mktsegment").alias("name"), (SPAN + ck).alias("method_id"), F.lit(1).alias("ord"))
    calls = o.select((3 * SPAN + ok).alias("id"), F.lit("CALL").alias("label"), F.col("o_orderstatus").alias("name"), F.concat(F.lit("order."), "o_orderstatus").alias("method_full_name"), F.lower("o_orderpriority").alias("code"), owner.alias("method_id"), (ok % 7).cast("int").alias("line"))
    returns = o.where("o_orderpriority = '1-URGENT'").select((4 * SPAN + ok).alias("id"), F.lit("RETURN").alias("label"), F.col("o_orderstatus").alias("code"), owner.alias("method_id"))
    notes = c.where("c_nationkey < 5").select((5 * SPAN + ck).alias("id"), F.lit("ANNOTATION").alias("label"), F.col("c_mktsegment").alias("name"), F.concat(F.lit("@"), "c_mktsegment").alias("code"))
    passed = o.select((6 * SPAN + ok).alias("id"), F.lit("IDENTIFIER").alias("label"), F.when(even, F.col("c_mktsegment")).otherwise("x").alias("name"), owner.alias("method_id"))
    nodes = methods
    for df in (others, params, calls, returns, notes, passed):
        nodes = nodes.unionByName(df, allowMissingColumns=True)

    def edge(df: DataFrame, src, dst, label: str, idx: int | None = None) -> DataFrame:
        return df.select(src.cast("long").alias("src"), dst.cast("long").alias("dst"), F.lit(label).alias("label"), F.lit(idx).cast("int").alias("idx"))

    target = F.when(F.col("o_orderstatus") == "F", 9 * SPAN + 1).when(F.col("o_orderstatus") == "O", 9 * SPAN + 2).otherwise(9 * SPAN + 3)
    edges = edge(o, 3 * SPAN + ok, target, "CALL").unionByName(edge(o, 3 * SPAN + ok, 6 * SPAN + ok, "ARGUMENT", 1))
    edges = edges.unionByName(edge(o.where(even), 6 * SPAN + ok, 2 * SPAN + F.col("o_custkey"), "REF")).unionByName(edge(o.where(even), 2 * SPAN + F.col("o_custkey"), 6 * SPAN + ok, "DDG"))
    return Graph(nodes, edges.unionByName(edge(c.where("c_nationkey < 5"), SPAN + ck, 5 * SPAN + ck, "ANNOTATED_BY")), root="")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, hrefs of web pages: controller and action of an endpoint."""
    p = table(spark, sf_dir, "pages")
    host = F.regexp_extract("url", "^https?://([^/]+)", 1)
    path = F.regexp_extract("url", "^https?://[^/]+(/[^?#]*)", 1)
    return p.select("page_id", host.alias("host"), path.alias("path"), F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1)).alias("hrefs"))
