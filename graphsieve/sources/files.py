"""Files of a repository, their fingerprint, and graphs kept by fingerprint."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import glob_to_regex
from ..graph import Graph
from ..rules.scoring import NOISE_PATTERNS

SKIPPED = (".git", "__pycache__", "node_modules")


def ignore_rules(patterns: Iterable[str]) -> list[tuple[bool, str]]:
    """gitignore lines as (keep, regular expression), the last match of a path decides."""
    out = []
    for line in patterns:
        p = line.rstrip("\n")
        if not p.strip() or p.startswith("#"):
            continue
        keep = p.startswith("!")
        p = p[1:] if keep else p
        p = p.strip()
        folder = p.endswith("/")
        p = p.rstrip("/")
        rooted = "/" in p
        p = p.lstrip("/")
        body = "/".join("(?:.*)" if part == "**" else glob_to_regex(part).replace(".*", "[^/]*") for part in p.split("/"))
        head = "" if rooted else "(?:.*/)?"
        tail = "/.*" if folder else "(?:/.*)?"
        out.append((keep, f"{head}{body}{tail}"))
    return out


def ignored(path: str, rules: Sequence[tuple[bool, str]]) -> bool:
    hit = False
    for keep, regex in rules:
        if re.fullmatch(regex, path, re.S):
            hit = not keep
    return hit


def read_repository(spark: SparkSession, root: str, suffixes: Sequence[str] = (), gitignore: Sequence[str] = (), noise: bool = True) -> DataFrame:
    """path (relative) and content of the files below a folder that are text and not ignored.

    Files are read by the executors; a file that is not UTF-8 is left out.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if len(suffixes) == 1:
        reader = reader.option("pathGlobFilter", f"*{suffixes[0]}")
    raw = reader.load(root)
    base = F.lit(re.sub(r"^file:/*", "/", root.rstrip("/")) + "/")
    full = F.regexp_replace("path", "^file:/*", "/")
    path = F.when(full.startswith(base), F.substring(full, F.length(base) + 1, F.length(full))).otherwise(full)
    out = raw.select(path.alias("path"), "content")
    if suffixes:
        out = out.where(F.col("path").rlike("(" + "|".join(re.escape(s) for s in suffixes) + ")$"))
    for keep, regex in ignore_rules([*(NOISE_PATTERNS if noise else ()), *gitignore]):
        hit = F.col("path").rlike(rf"\A(?:{regex})\z")
        if not keep:
            out = out.where(~hit)
    return out.where(F.is_valid_utf8(F.col("content").cast("string"))).select("path", F.col("content").cast("string").alias("content"))


def fingerprint(path: str) -> str:
    """md5 of relative path, size and time of each file in sorted order; of one file: its name, size and time."""
    h = hashlib.md5()
    if os.path.isfile(path):
        s = os.stat(path)
        h.update(f"{os.path.basename(path)}:{s.st_size}:{s.st_mtime}\n".encode())
        return h.hexdigest()
    for folder, names, files in sorted(os.walk(path)):
        names[:] = sorted(n for n in names if n not in SKIPPED)
        if any(part in SKIPPED for part in os.path.relpath(folder, path).split(os.sep)):
            continue
        for f in sorted(files):
            full = os.path.join(folder, f)
            try:
                s = os.stat(full)
            except OSError:
                continue
            h.update(f"{os.path.relpath(full, path)}:{s.st_size}:{s.st_mtime}\n".encode())
    return h.hexdigest()


def cache_key(path: str, language: str | None = None, args: Sequence[str] = ()) -> str:
    return hashlib.md5(f"{fingerprint(path)}:{language or 'any'}:{','.join(sorted(args))}".encode()).hexdigest()


def load_or_build(spark: SparkSession, path: str, build, folder: str, language: str | None = None, args: Sequence[str] = ()) -> Graph:
    """The graph that was kept for these files, else a new one, which is kept."""
    target = os.path.join(folder, cache_key(path, language, args))
    if os.path.isdir(os.path.join(target, "edges")):
        return Graph.load(spark, f"file://{os.path.abspath(target)}")
    g = build()
    g.save(f"file://{os.path.abspath(target)}")
    return Graph.load(spark, f"file://{os.path.abspath(target)}")
