"""De-duplication, top lists and counters over matches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .dominance import latest


def deduplicate(matches: DataFrame, *by: str) -> DataFrame:
    """One match for each place, source method and bindings.

    Sources that are not the receiver come first, then longer code, then the smaller id.
    """
    pairs = F.array_join(F.transform(F.array_sort(F.map_entries("bindings")), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("")))), "\x01")
    keyed = matches.withColumn("_line", F.coalesce("line", F.lit(0))).withColumn("_method", F.coalesce("source_method", F.lit("unknown"))).withColumn("_pairs", pairs)
    this = F.coalesce(F.col("source_code").contains("this"), F.lit(False)).cast("int")
    return latest(keyed, [*by, "file", "_line", "_method", "_pairs"], this, F.length("code").desc_nulls_last(), "node_id", "source_id").drop("_line", "_method", "_pairs")


def deduplicate_report(matches: DataFrame) -> DataFrame:
    """One match for each pair of sink place and source place; the longest code stays."""
    return latest(matches, ["file", "line", "source_file", "source_line"], F.length("code").desc_nulls_last(), "node_id", "source_id")


def top_findings(matches: DataFrame, most: int = 3, by: tuple[str, ...] = ("rule", "file")) -> DataFrame:
    """The first ``most`` of each group by code length, with the number that it hides."""
    order = Window.partitionBy(*by).orderBy(F.length("code").desc_nulls_last(), "node_id")
    out = matches.withColumn("rank", F.row_number().over(order)).withColumn("total", F.count("*").over(Window.partitionBy(*by)))
    return out.where(F.col("rank") <= most).withColumn("hidden", F.greatest(F.lit(0), F.col("total") - most)).drop("total")


def executive_summary(findings: DataFrame) -> DataFrame:
    """Findings and files by rule and severity, with totals, in one pass."""
    return findings.rollup("rule", "severity").agg(F.count("*").alias("findings"), F.countDistinct("file").alias("files"))


def steps_of(trace: DataFrame) -> DataFrame:
    """Steps of each match with labels 1..n and SINK; the longest code of a line stands for it.

    trace: match, k, file, line, code, is_sink.
    """
    per = trace.groupBy("match", "file", "line").agg(F.min("k").alias("k"), F.max_by("code", F.length("code")).alias("code"), F.bool_or("is_sink").alias("is_sink"))
    order = Window.partitionBy("match").orderBy("k")
    label = F.when(F.col("is_sink"), "SINK").otherwise(F.sum((~F.col("is_sink")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("string"))
    return per.withColumn("step", label)


def blocks(lines: DataFrame, by: list[str], gap: int = 10) -> DataFrame:
    """Lines at most ``gap`` apart form a block: first line, last line and count."""
    order = Window.partitionBy(*by).orderBy("line")
    new = F.when(F.col("line") - F.lag("line").over(order) > gap, 1).otherwise(0)
    marked = lines.withColumn("_new", new)
    marked = marked.withColumn("block", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*by, "block").agg(F.min("line").alias("first_line"), F.max("line").alias("last_line"), F.count("*").alias("lines"))


def runs(steps: DataFrame, by: list[str], order: str = "k") -> DataFrame:
    """Consecutive steps of one file, line and method; within a run, codes that another contains go."""
    w = Window.partitionBy(*by).orderBy(order)
    here = F.struct("file", "line", "method")
    new = F.when(F.lag(here).over(w).eqNullSafe(here), 0).otherwise(1)
    marked = steps.withColumn("_new", new).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs_ = marked.groupBy(*by, "run", "file", "line", "method").agg(F.min(order).alias(order), F.array_distinct(F.collect_list("code")).alias("codes"))
    kept = F.filter("codes", lambda c: ~F.exists(F.col("codes"), lambda o: (o != c) & F.contains(o, c)))
    return runs_.withColumn("codes", kept)


def degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, indegree, outdegree of every node."""
    i = edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("indegree"))
    o = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("outdegree"))
    return nodes.select("id").join(i, "id", "left").join(o, "id", "left").fillna(0, ["indegree", "outdegree"])


def group_codes(calls: DataFrame, most: int = 3) -> DataFrame:
    """Calls by full name with up to ``most`` distinct codes, sorted."""
    return calls.groupBy("full_name").agg(F.slice(F.sort_array(F.collect_set("code")), 1, most).alias("codes"), F.count("*").alias("calls"))


def group_simple(methods: DataFrame) -> DataFrame:
    """Full names by simple name, sorted."""
    return methods.groupBy("name").agg(F.sort_array(F.collect_set("full_name")).alias("full_names"))


def budget_prefix(files: DataFrame, budget: int, used: int = 0) -> DataFrame:
    """Files in order of score and path until the first would overflow the budget.

    files: path, score, tokens.  The order is cut into ranges of score and path, so files
    of one score share no task; totals of ranges come first, and ranges beyond the budget
    are not summed in order.
    """
    from ..storage import Scratch

    # scores may be costly to compute: they are written once, the other columns join at the end
    scratch = Scratch(files.sparkSession, "budget")
    scores = scratch.save(files.select("path", "score", "tokens"), "scores")
    order = (F.col("score").desc(), F.col("path"))
    small = scratch.save(scores.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    totals = small.groupBy("_range").agg(F.sum("tokens").alias("n"))  # one row a partition
    before = totals.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    edge = before.where(F.col("before") + used <= budget)
    w = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = small.join(edge.select("_range", "before"), "_range").withColumn("used", F.col("before") + F.sum("tokens").over(w) + used)
    chosen = out.where(F.col("used") <= budget).select("path", "score", "tokens", "used")
    others = [c for c in files.columns if c not in ("score", "tokens")]
    return chosen if others == ["path"] else files.select(*others).join(chosen, "path")
