"""Command line: scan, slice, discover, call-graph, list-methods, method-details, find-calls, query, pack-repo."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import functions as F

from .engine import LANGUAGES, Engine
from .operators.endpoints import render
from .operators.findings import group_codes, group_simple
from .reports import sarif
from .reports.console import ConsoleReporter, SliceReporter, tree_text, usage_text
from .rules import library
from .rules.model import Confidence, Severity
from .rules.values import CALL_GRAPH_EXCLUDES


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="graphsieve", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)

    def add(name: str, text: str) -> argparse.ArgumentParser:
        p = sub.add_parser(name, help=text)
        p.add_argument("path", help="source file or folder, or a saved graph")
        p.add_argument("--language", choices=sorted(LANGUAGES), default="python")
        p.add_argument("--graph", action="store_true", help="path is a saved graph")
        p.add_argument("--no-cache", action="store_true")
        return p

    p = add("scan", "run the rules")
    p.add_argument("--coverage", choices=("precision", "broad"), default="precision")
    p.add_argument("--severity", type=Severity.parse, default=None)
    p.add_argument("--confidence", type=Confidence.parse, default=None)
    p.add_argument("--sarif", help="write SARIF to this file")
    p.add_argument("--summary", action="store_true", help="without the steps of flows, which is faster")
    p.add_argument("--surface-only", action="store_true")
    p.add_argument("--max-findings", type=int, default=3)
    p.add_argument("--depth", type=int, default=10)
    p = add("slice", "what reaches a sink")
    p.add_argument("--sink")
    p.add_argument("--rule")
    p.add_argument("--list-rules", action="store_true")
    p.add_argument("--coverage", choices=("precision", "broad", "all"), default="precision")
    p.add_argument("--depth", type=int, default=12)
    p.add_argument("--max-sinks", type=int, default=6)
    p.add_argument("--max-paths", type=int, default=4)
    p.add_argument("--usages", action="store_true")
    add("discover", "wrappers of dangerous calls and the interfaces in use")
    p = add("call-graph", "callees or callers as a tree")
    p.add_argument("--pattern", default=".*")
    p.add_argument("--direction", choices=("callee", "caller"), default="callee")
    p.add_argument("--depth", type=int, default=5)
    p.add_argument("--exclude", action="append", default=[])
    p.add_argument("--interesting", action="store_true")
    p.add_argument("--barriers", action="store_true")
    p.add_argument("--conditions", action="store_true")
    p = add("list-methods", "methods by name")
    p.add_argument("--pattern", default=".*")
    p.add_argument("--internal", action="store_true")
    p.add_argument("--entry-points", action="store_true")
    p.add_argument("--file-pattern")
    add("method-details", "one method").add_argument("full_name")
    p = add("find-calls", "call sites")
    p.add_argument("pattern")
    p.add_argument("--grouped", action="store_true")
    add("query", "SQL over {nodes} and {edges}").add_argument("text")
    p = add("pack-repo", "files that matter, within a budget of tokens")
    p.add_argument("--budget", type=int, default=100_000)
    p.add_argument("--output")
    p.add_argument("--static", action="store_true", help="without the graph")
    return top


def main(argv: list[str] | None = None, engine: Engine | None = None) -> int:
    a = parser().parse_args(argv)
    if a.command == "slice" and a.list_rules:
        print("\n".join(library.format_rules(library.slice_rules(a.language, a.coverage))))
        return 0
    with engine or Engine() as e:
        if a.graph:
            e.load_graph(a.path)
        elif not (a.command == "pack-repo" and a.static):
            e.load_code(a.path, a.language, use_cache=not a.no_cache)
        if a.command == "scan":
            print(render(e.endpoints(a.language, a.depth).collect()))
            if a.surface_only:
                return 0
            rules = library.scan_rules(a.language, a.coverage)
            found = e.scan(a.language, severity=a.severity, confidence=a.confidence, rules=rules, trace=not a.summary)
            print(ConsoleReporter(a.max_findings).report(found))
            if a.sarif:
                with open(a.sarif, "w", encoding="utf-8") as f:
                    f.write(sarif.document(found, rules))
        elif a.command == "slice":
            rule = library.slice_rule(a.rule, a.language, "all") if a.rule else None
            sink = a.sink or (rule.sink_pattern if rule else None)
            if sink is None:
                print("give --sink or the --rule of --list-rules", file=sys.stderr)
                return 2
            nodes, edges = e.data_flow_slice(sink, a.depth)
            print(SliceReporter(a.max_sinks, a.max_paths).report_slice(nodes, edges))
            if a.usages:
                print(usage_text(e.usage_slice()))
        elif a.command == "discover":
            for r in e.discover_wrappers(a.language).orderBy(F.col("score").desc(), "full_name").collect():
                print(f"{r['score']:3} {r['full_name']} ({r['file']}:{r['line']}) " + ", ".join(f"{c['category']}: {c['full_name']}" for c in r["calls"]))
            for r in e.api_summary().orderBy("module").collect():
                print(f"{r['module']}: {', '.join(r['names'])}")
        elif a.command == "call-graph":
            heuristics = library.discovery_heuristics(a.language)
            patterns = [p for h in library.barrier_heuristics(a.language) for p in h.patterns] if a.barriers else []
            tree = e.call_graph(a.pattern, direction=a.direction, depth=a.depth, exclude=a.exclude or CALL_GRAPH_EXCLUDES, heuristics=heuristics, barrier_patterns=patterns, interesting_only=a.interesting, conditions=a.conditions)
            print(tree_text(tree))
        elif a.command == "list-methods":
            rows = e.list_methods(a.pattern, internal_only=a.internal, entry_points_only=a.entry_points, file_pattern=a.file_pattern)
            for r in group_simple(rows).orderBy("name").collect():
                print(f"{r['name']}: {', '.join(r['full_names'])}")
        elif a.command == "method-details":
            for r in e.method_details(a.full_name).collect():
                print(f"{r['full_name']} ({r['file']}:{r['line']})\n  parameters: {[p['name'] for p in r['params'] or []]}\n  calls: {[c['full_name'] for c in r['calls_out'] or []]}\n  callers: {r['callers'] or []}\n{r['code']}")
        elif a.command == "find-calls":
            rows = e.find_calls(a.pattern).orderBy("file", F.col("line").asc_nulls_last(), "name")
            if a.grouped:
                for r in group_codes(rows).orderBy("full_name").collect():
                    print(f"{r['full_name']} ({r['calls']}): " + " | ".join(r["codes"]))
            else:
                for r in rows.collect():
                    print(f"{r['file']}:{r['line']} {r['full_name']} in {r['caller']}: {' '.join((r['code'] or '').split())}")
        elif a.command == "query":
            e.sql(a.text).show(200, truncate=False)
        elif a.command == "pack-repo":
            text = e.pack(a.path, a.budget, a.language)
            if a.output:
                with open(a.output, "w", encoding="utf-8") as f:
                    f.write(text)
            else:
                print(text)
    return 0


if __name__ == "__main__":
    sys.exit(main())


