"""Findings as SARIF 2.1.0."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import sarif_level, sarif_rank

SCHEMA = "https://json.schemastore.org/sarif-2.1.0.json"


def results(findings: DataFrame) -> DataFrame:
    """One ``result`` document for each finding, as JSON."""
    region = F.struct(F.col("line").alias("startLine"), F.col("col").alias("startColumn"), F.col("line_end").alias("endLine"), F.struct(F.col("code").alias("text")).alias("snippet"))
    place = F.struct(F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    columns = [
        F.col("rule_id").alias("ruleId"),
        sarif_level(F.col("severity")).alias("level"),
        sarif_rank(F.col("severity")).alias("rank"),
        F.struct(F.concat(F.col("rule"), F.lit(": "), F.coalesce("method", F.lit("")))).alias("message"),
        F.array(place).alias("locations"),
    ]
    if "trace" in findings.columns:
        step = lambda t: F.struct(
            F.struct(F.struct(F.struct(t["file"].alias("uri")).alias("artifactLocation"), F.struct(t["line"].alias("startLine"), F.struct(t["code"].alias("text")).alias("snippet")).alias("region")).alias("physicalLocation")).alias("location")
        )
        flows = F.when(F.size("trace") > 0, F.array(F.struct(F.array(F.struct(F.transform("trace", step).alias("locations"))).alias("threadFlows"))))
        columns.append(flows.alias("codeFlows"))
    text = F.to_json(F.struct(*columns))
    return findings.select("rule_id", "file", "line", F.regexp_replace(text, r'"message":\{"col1":', '"message":{"text":').alias("result"))


def document(findings: DataFrame, rules=(), tool: str = "graphsieve", version: str = "0.1.0") -> str:
    """The whole log. Results are collected: a report is read by people."""
    rows = results(findings).orderBy("rule_id", "file", "line").collect()
    described = [{"id": r.rule_id, "name": r.name, "shortDescription": {"text": r.description or r.name}, "fullDescription": {"text": r.root_cause or r.name}, "help": {"text": r.impact or ""}, "defaultConfiguration": {"level": "error" if r.severity >= 4 else "warning" if r.severity == 3 else "note"}} for r in rules]
    run = {"tool": {"driver": {"name": tool, "version": version, "rules": described}}, "results": [json.loads(r["result"]) for r in rows]}
    return json.dumps({"$schema": SCHEMA, "version": "2.1.0", "runs": [run]}, indent=2)


def write(findings: DataFrame, path: str) -> None:
    """One result a line, written by the executors: for logs too large to collect."""
    results(findings).select("result").write.mode("overwrite").text(path)
