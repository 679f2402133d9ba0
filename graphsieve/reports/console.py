"""Findings, slices and call trees as text. All rows here are limited before they are collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.findings import deduplicate_report, executive_summary, top_findings
from ..rules.model import Severity


class Reporter:
    """Subclass to report findings another way."""

    def report(self, findings: DataFrame) -> str:
        raise NotImplementedError


class ConsoleReporter(Reporter):
    """The first findings of each rule and file with steps, and a summary."""

    def __init__(self, most: int = 3):
        self.most = most

    def report(self, findings: DataFrame) -> str:
        shown = top_findings(deduplicate_report(findings), self.most).orderBy(F.col("severity").desc(), "rule", "file", "rank").collect()
        out, rule, file = [], None, None
        for r in shown:
            if r["rule"] != rule:
                out += ["", f"[{Severity(r['severity']).name.upper()}] {r['rule']}"]
                rule, file = r["rule"], None
            if r["file"] != file:
                file = r["file"]
                out.append(f"  {file}" + (f" ({r['hidden']} more)" if r["hidden"] else ""))
            code = " ".join((r["code"] or "").split())
            out.append(f"    {r['line']}: {code[:117] + '...' if len(code) > 120 else code}")
            if r["source_code"]:
                out.append(f"      from {r['source_file']}:{r['source_line']} {' '.join(r['source_code'].split())[:80]}")
            for k, s in enumerate(r["trace"] if "trace" in shown[0].__fields__ and r["trace"] else [], 1):
                last = k == len(r["trace"])
                out.append(f"      {'SINK' if last else k}: {s['file']}:{s['line']} {' '.join((s['code'] or '').split())[:80]}")
        out += ["", summary_text(findings)]
        return "\n".join(out)


def summary_text(findings: DataFrame) -> str:
    rows = executive_summary(findings).collect()
    total = next((r for r in rows if r["rule"] is None), None)
    out = [f"Findings: {total['findings'] if total else 0} in {total['files'] if total else 0} files"]
    for r in sorted((r for r in rows if r["rule"] is not None and r["severity"] is not None), key=lambda r: (-r["severity"], r["rule"])):
        out.append(f"  {Severity(r['severity']).name:9}{r['rule']}: {r['findings']} in {r['files']} files")
    return "\n".join(out)


class SliceReporter(Reporter):
    """Sinks of a backward slice with paths from their origins, shortest first."""

    def __init__(self, max_sinks: int = 10, max_paths: int = 10, max_depth: int = 12):
        self.max_sinks, self.max_paths, self.max_depth = max_sinks, max_paths, max_depth

    def paths(self, nodes: DataFrame, edges: DataFrame) -> DataFrame:
        """sink, path, origin: paths back from each sink, at most ``max_paths`` each.

        Literals and constants make way for other origins, and parameters come first, as
        long as something is left.
        """
        from pyspark.sql import Window

        from ..operators.closure import reach

        ends = nodes.where("is_sink")
        if ends.isEmpty():  # without a marked sink: nodes that nothing follows
            ends = nodes.join(edges.select(F.col("src").alias("id")), "id", "left_anti")
        ends = ends.orderBy("filename", "line", "id").limit(self.max_sinks)
        back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        found = reach(back, ends.select(F.col("id").alias("root"), F.col("id").alias("node")), self.max_depth, trace=True)
        n = nodes.select(F.col("id").alias("node"), "label", "code", "is_origin", "method_id")
        sink_method = nodes.select(F.col("id").alias("root"), F.col("method_id").alias("sink_method"))
        first = back.select(F.col("src").alias("node")).distinct().withColumn("_more", F.lit(True))
        starts = found.join(n, "node").join(first, "node", "left").join(sink_method, "root").where("is_origin or _more is null")
        constant = (F.col("label") == "LITERAL") | F.col("code").rlike("^[A-Z][A-Z0-9_]*$")
        rank = F.struct(constant.cast("int").alias("a"), (F.col("label") != "METHOD_PARAMETER_IN").cast("int").alias("b"), (F.col("method_id") != F.col("sink_method")).cast("int").alias("c"), "depth", "node")
        w = Window.partitionBy("root").orderBy(rank)
        kept = starts.withColumn("k", F.row_number().over(w)).withColumn("_best", F.min(constant.cast("int")).over(Window.partitionBy("root")))
        kept = kept.where((F.col("k") <= self.max_paths) & (constant.cast("int") <= F.col("_best")))
        return kept.select(F.col("root").alias("sink"), "k", F.reverse("path").alias("path"), F.col("node").alias("origin"))

    def report_slice(self, nodes: DataFrame, edges: DataFrame) -> str:
        rows = self.paths(nodes, edges).orderBy("sink", "k").collect()
        ids = sorted({i for r in rows for i in r["path"]})
        at = {r["id"]: r for r in nodes.where(F.col("id").isin(ids)).select("id", "filename", "line", "code", "label").collect()} if ids else {}
        out = []
        for sink in dict.fromkeys(r["sink"] for r in rows):
            s = at[sink]
            out.append(f"SINK {s['filename']}:{s['line']} {' '.join((s['code'] or '').split())[:100]}")
            for r in (r for r in rows if r["sink"] == sink):
                steps, last = [], None
                for i in r["path"]:
                    x = at.get(i)
                    text = " ".join(((x["code"] if x else "") or "").split())
                    if text and text != last:
                        steps.append(f"{text[:60]} (L{x['line']})")
                        last = text
                out.append("  " + " -> ".join(steps))
        return "\n".join(out) or "No slice."


def usage_text(usages: DataFrame, most: int = 200) -> str:
    out = []
    for r in usages.orderBy("file", "line", "name").limit(most).collect():
        out.append(f"{r['file']}:{r['line']} {r['name']}: {r['defined_by'] or ''}")
        out += [f"  calls {c}" for c in r["invoked"]] + [f"  passed to {c['callee']}({c['position']})" for c in r["passed_to"]]
    return "\n".join(out)


def tree_text(tree: DataFrame, most_same: int = 5) -> str:
    """Call trees, children by name; more than ``most_same`` children of one name are counted."""
    rows = tree.collect()
    by: dict[tuple, list] = {}
    for r in rows:
        by.setdefault((r["root"], tuple(r["path"][:-1])), []).append(r)
    out: list[str] = []

    def show(r, depth: int) -> None:
        marks = [f"[{r['category']}]"] if r["category"] else []
        if "barriers" in r.__fields__ and r["barriers"]:
            marks.append(f"barriers: {', '.join(r['barriers'])}")
        if "is_dominated" in r.__fields__ and r["is_dominated"]:
            marks.append("behind a barrier")
        out.append("  " * depth + " ".join([r["full_name"], *marks]))
        seen: dict[str, int] = {}
        for c in sorted(by.get((r["root"], tuple(r["path"])), []), key=lambda c: c["full_name"]):
            seen[c["name"]] = seen.get(c["name"], 0) + 1
            if seen[c["name"]] <= most_same:
                show(c, depth + 1)
        out.extend("  " * (depth + 1) + f"({n - most_same} more {k})" for k, n in seen.items() if n > most_same)

    for r in sorted((r for r in rows if r["depth"] == 0), key=lambda r: (-sum(x["category"] is not None for x in rows if x["root"] == r["root"]), r["full_name"])):
        show(r, 0)
    return "\n".join(out)
