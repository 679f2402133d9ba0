"""Packing the files of a repository that matter for security into a token budget."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.text import first_category, token_estimate
from .graph import Graph
from .operators.analyses import discover_wrappers, method_calls, sink_distance
from .operators.findings import budget_prefix
from .operators.scans import run_scans
from .operators.scoring import distance_boost, score_files
from .rules import library


def dynamic_boosts(g: Graph, language: str | None, depth: int = 12) -> DataFrame:
    """path, boost, reasons from calls, flows and wrappers; the largest boost of a file counts.

    150 at a sink, 120 - 20 d at distance d, half for a caller's file; 100 on a flow; 80 for a wrapper.
    """
    heuristics = library.discovery_heuristics(language)
    empty = g.spark.createDataFrame([], "path string, boost int, reasons array<string>")
    if not heuristics:
        return empty
    methods = g.label("METHOD").select("id", "filename", "full_name", F.coalesce("is_external", F.lit(False)).alias("external"))
    calls = g.label("CALL").withColumn("category", first_category("method_full_name", heuristics)).where("category is not null")
    near = sink_distance(g, heuristics, depth).join(methods, "id").withColumn("category", first_category("full_name", heuristics))
    # a method that calls a library sink is one step from it
    direct = calls.select(F.col("method_id").alias("id"), "category").distinct().join(methods, "id").withColumn("distance", F.lit(1))
    own = near.select("id", "filename", "distance", "category").unionByName(direct.select("id", "filename", "distance", F.lit(None).cast("string").alias("category")))
    boost = distance_boost(F.col("distance"), F.col("category"))
    why = F.when(F.col("category").isNotNull(), F.concat(F.lit("Security Sink ("), "category", F.lit(")"))).otherwise(F.concat(F.lit("Security Gravity (dist "), F.col("distance").cast("string"), F.lit(" to sink)")))
    scored = own.select("id", F.col("filename").alias("path"), boost.alias("boost"), why.alias("reason"))
    callers = method_calls(g).select(F.col("src").alias("caller"), F.col("dst").alias("id")).join(scored.select("id", "boost", "reason"), "id").join(methods.select(F.col("id").alias("caller"), F.col("filename").alias("path")), "caller")
    out = scored.select("path", "boost", "reason").unionByName(callers.select("path", F.floor(F.col("boost") / 2).cast("int").alias("boost"), F.concat(F.lit("Caller of "), "reason").alias("reason")))
    found = run_scans(g, library.scan_rules(language))
    flow = found.select(F.col("file").alias("path"), F.lit(100).alias("boost"), F.concat(F.lit("Finding: "), "rule").alias("reason"))
    wrappers = discover_wrappers(g, heuristics).select(F.col("file").alias("path"), F.lit(80).alias("boost"), F.lit("Security wrapper").alias("reason"))
    every = out.unionByName(flow).unionByName(wrappers).where("path is not null and path not in ('', '<empty>', 'external')")
    return every.groupBy("path").agg(F.max("boost").alias("boost"), F.array_sort(F.collect_set("reason")).alias("reasons"))


def tree_text(paths: list[str]) -> str:
    """The folder tree of paths."""
    root: dict = {}
    for p in paths:
        at = root
        for part in p.split("/"):
            at = at.setdefault(part, {})
    out: list[str] = []

    def walk(node: dict, depth: int) -> None:
        for name in sorted(node, key=lambda n: (not node[n], n)):
            out.append("  " * depth + name + ("/" if node[name] else ""))
            walk(node[name], depth + 1)

    walk(root, 0)
    return "\n".join(out)


def rank(files: DataFrame, graph: Graph | None = None, language: str | None = None, tokens=None) -> DataFrame:
    """path, content, score, reasons, tokens of files (path, content); ``tokens`` is a Column function of the text."""
    boosts = dynamic_boosts(graph, language) if graph is not None else None
    return score_files(files, boosts).withColumn("tokens", (tokens or token_estimate)(F.col("content")))


def pack(files: DataFrame, budget: int = 100_000, graph: Graph | None = None, language: str | None = None, tokens=None) -> str:
    """One text: the tree of all files, then the best files until the budget is used."""
    ranked = rank(files, graph, language, tokens)
    tree = tree_text([r["path"] for r in ranked.select("path").orderBy("path").collect()])
    head = -(-len(tree) // 4)
    chosen = budget_prefix(ranked.where("score > 0"), budget, head).orderBy(F.col("score").desc(), "path")
    parts = [f"# Files\n{tree}\n"]
    # the budget bounds what is collected
    for r in chosen.select("path", "score", "reasons", "content").collect():
        parts.append(f"# {r['path']} (score {r['score']}: {'; '.join(r['reasons'])})\n{r['content']}\n")
    return "\n".join(parts)
