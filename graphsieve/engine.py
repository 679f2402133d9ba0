"""One object for a session: load code or a graph, ask, scan, report."""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from . import packer
from .graph import Graph
from .operators import analyses, endpoints, query, scans
from .operators.findings import deduplicate
from .rules import library
from .rules.model import Confidence, ScanRule, Severity
from .sources import files
from .sources.python_frontend import import_python

SUFFIXES = {"python": (".py",)}
LANGUAGES = {"python": "python", "java": "java", "csharp": "csharp", "javascript": "javascript"}


class EngineError(RuntimeError):
    """What the engine cannot do, in words."""


class Engine:
    """``with Engine() as e: e.load_code(path); e.scan()``."""

    def __init__(self, spark: SparkSession | None = None, cache: str | None = None):
        self.own = spark is None
        self.spark = spark or SparkSession.builder.appName("graphsieve").getOrCreate()
        self.cache, self._graph, self.errors, self.path = cache, None, None, None

    def __enter__(self) -> Engine:
        return self

    def __exit__(self, *_) -> None:
        if self.own:
            self.spark.stop()

    @property
    def graph(self) -> Graph:
        if self._graph is None:
            raise EngineError("no graph: call load_code, load_graph or use_graph first")
        return self._graph

    # sources
    def load_code(self, path: str, language: str = "python", parse_args: Sequence[str] = (), use_cache: bool = True) -> Engine:
        """Python is read here; graphs of other languages come from their own frontends by load_graph."""
        if language not in SUFFIXES:
            raise EngineError(f"no frontend for {language!r} here: import its nodes and edges with load_graph")

        def build() -> Graph:
            import os

            if os.path.isfile(path):
                with open(path, encoding="utf-8") as f:
                    table = self.spark.createDataFrame([(os.path.basename(path), f.read())], "path string, content string")
            else:
                table = files.read_repository(self.spark, path if "://" in path else f"file://{os.path.abspath(path)}", SUFFIXES[language], noise=False)
            graph, self.errors = import_python(table)
            return graph

        self.path = path
        folder = self.cache or tempfile.gettempdir() + "/graphsieve-cache"
        self._graph = files.load_or_build(self.spark, path, build, folder, language, parse_args) if use_cache else build()
        return self

    def load_graph(self, path: str) -> Engine:
        self._graph = Graph.load(self.spark, path)
        return self

    def save_graph(self, path: str) -> None:
        self.graph.save(path)

    def build_graph(self, source: str, target: str, language: str = "python") -> None:
        self.load_code(source, language, use_cache=False).save_graph(target)

    def use_graph(self, graph: Graph) -> Engine:
        self._graph = graph
        return self

    # questions
    def execute(self, q: query.Query) -> DataFrame:
        out = deduplicate(query.execute(self.graph, q))
        return query.with_trace(self.graph, out) if q.trace else out

    def sql(self, text: str) -> DataFrame:
        return self.graph.sql(text)

    def list_calls(self, pattern: str = ".*") -> DataFrame:
        return analyses.list_calls(self.graph, pattern)

    def list_methods(self, pattern: str = ".*", **options) -> DataFrame:
        return analyses.list_methods(self.graph, pattern, **options)

    def method_details(self, full_name: str) -> DataFrame:
        return analyses.method_details(self.graph, full_name)

    def find_calls(self, pattern: str) -> DataFrame:
        return analyses.find_calls(self.graph, pattern)

    def data_flow_slice(self, sink_pattern: str, depth: int = 40) -> tuple[DataFrame, DataFrame]:
        return analyses.data_flow_slice(self.graph, sink_pattern, depth)

    def usage_slice(self, min_calls: int = 1, exclude_operators: bool = True) -> DataFrame:
        return analyses.usage_slice(self.graph, min_calls, exclude_operators)

    def api_summary(self) -> DataFrame:
        return analyses.api_summary(self.graph)

    def discover_wrappers(self, language: str = "python") -> DataFrame:
        return analyses.discover_wrappers(self.graph, library.discovery_heuristics(language))

    def call_graph(self, pattern: str = ".*", **options) -> DataFrame:
        return analyses.call_graph(self.graph, pattern, **options)

    def endpoints(self, language: str | None = None, depth: int = 10) -> DataFrame:
        return endpoints.get_endpoints(self.graph, language, depth)

    def scan(self, language: str | None = "python", coverage: str = "precision", severity: Severity | None = None, confidence: Confidence | None = None, rules: Sequence[ScanRule] | None = None, trace: bool = False) -> DataFrame:
        return scans.run_scans(self.graph, rules if rules is not None else library.scan_rules(language, coverage), severity, confidence, trace)

    def pack(self, root: str, budget: int = 100_000, language: str | None = "python") -> str:
        import os

        ignore = os.path.join(root, ".gitignore")
        lines = open(ignore).read().splitlines() if os.path.exists(ignore) else []
        table = files.read_repository(self.spark, f"file://{os.path.abspath(root)}", gitignore=lines)
        return packer.pack(table, budget, self._graph, language)
