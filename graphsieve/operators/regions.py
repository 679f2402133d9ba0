"""Where a reported snippet really stands in a file, and which file a name means."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import base_name


def file_lines(files: DataFrame) -> DataFrame:
    """path, line (from 1), text of files (path, content)."""
    return files.select("path", F.posexplode(F.split("content", "\n")).alias("k", "text")).select("path", (F.col("k") + 1).alias("line"), "text")


def resolve_regions(reports: DataFrame, lines: DataFrame) -> DataFrame:
    """reports (key, path, line, snippet) with found_line and found_col.

    The reported line, then those one and two lines off, then the first in the file that
    contains the snippet; null if none does.  An equi-join by path, so only lines of
    reported files move.
    """
    here = lines.join(reports.select("path").distinct(), "path", "left_semi")
    hit = reports.join(here.withColumnRenamed("line", "at"), "path").where(F.instr("text", F.col("snippet")) > 0)
    off = F.abs(F.col("at") - F.col("line"))
    rank = F.struct(F.when(off <= 2, off).otherwise(3).alias("near"), F.col("at"))
    best = hit.groupBy("key").agg(F.min_by(F.struct("at", F.instr("text", F.col("snippet")).alias("col")), rank).alias("b"))
    return reports.join(best, "key", "left").select(*reports.columns, F.col("b.at").alias("found_line"), F.col("b.col").alias("found_col"))


def locate_files(names: DataFrame, files: DataFrame) -> DataFrame:
    """names (name) with the path of the file: the same path, else the first of the same base name."""
    exact = files.select(F.col("path").alias("name"), F.col("path").alias("exact"))
    by_base = files.groupBy(base_name(F.col("path")).alias("base")).agg(F.min("path").alias("like"))
    out = names.withColumn("base", base_name(F.col("name"))).join(exact, "name", "left").join(by_base, "base", "left")
    return out.select(*names.columns, F.coalesce("exact", "like").alias("path"))
