"""Scalar functions on names, paths and code, as native expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def full_match(column: Column | str, pattern: str) -> Column:
    """The whole value matches the regular expression; a line feed at the end counts."""
    c = F.col(column) if isinstance(column, str) else column
    if pattern in (".*", "(?s).*"):
        return c.isNotNull()
    return c.rlike(rf"\A(?:{pattern})\z")


def any_match(column: Column | str, patterns: list[str]) -> Column:
    """One fused expression for a list of whole-value patterns."""
    if not patterns:
        return F.lit(False)
    return full_match(column, "|".join(f"(?:{p})" for p in patterns))


def first_category(column: Column | str, heuristics) -> Column:
    """Category of the first heuristic of which a pattern matches; null for none."""
    out = None
    for h in heuristics:
        hit = any_match(column, h.patterns)
        out = F.when(hit, F.lit(h.category)) if out is None else out.when(hit, F.lit(h.category))
    return F.lit(None).cast("string") if out is None else out


def lenient_int(column: Column) -> Column:
    """Whole numbers and their texts; all else is null."""
    return column.cast("string").try_cast("int")


def absent(column: Column) -> Column:
    """Null for the sentinels of missing values."""
    return F.when(column.isin("", "<empty>", "<unknown>", "ANY", "N/A", "<unknownFullName>"), None).otherwise(column)


def is_operator(column: Column) -> Column:
    return F.coalesce(column.startswith("<operator>"), F.lit(False))


def noise(name: Column) -> Column:
    """Operators and names that hold code."""
    return is_operator(name) | name.contains("\n") | name.contains("{")


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"\.[^.]+$", "")


_FILE = r"\.(?:js|ts|jsx|tsx|py|java|cs|mjs|cjs)$"


def class_name(type_decl: Column, filename: Column, method_name: Column, method_full_name: Column) -> Column:
    """Class of a method: its type declaration, else what its full name says."""
    decl = absent(type_decl)
    head = F.regexp_replace(F.split_part(method_full_name, F.lit("("), F.lit(1)), r"::program.*$", "")
    parts = F.split(head, ":")
    module = F.when(F.element_at(parts, 1).rlike(_FILE) | (F.size(parts) < 2), F.element_at(parts, -1)).otherwise(F.get(parts, F.size(parts) - 2))
    dotted = F.split(module, r"\.")
    parsed = F.when(F.size(dotted) > 1, F.get(dotted, F.size(dotted) - 2)).otherwise(F.get(dotted, F.lit(0)))
    trimmed = F.when(decl.endswith(F.concat(F.lit("."), method_name)), F.expr("null")).otherwise(decl)
    strip = F.regexp_replace(decl, r"[.:][^.:]+$", "")
    return F.when(decl.endswith("::program") | (decl == "program"), stem(F.coalesce(F.regexp_replace(decl, "::program$", ""), filename))).otherwise(F.coalesce(trimmed, F.when(decl.isNotNull(), strip), parsed))


def short_method(full_name: Column) -> Column:
    """``Class.method`` of a full name, without signature and module."""
    head = F.split_part(full_name, F.lit("("), F.lit(1))
    last = F.element_at(F.split(head, ":"), -1)
    parts = F.split(last, r"\.")
    return F.when(F.size(parts) > 1, F.concat_ws(".", F.get(parts, F.size(parts) - 2), F.element_at(parts, -1))).otherwise(last)


def strip_quotes(column: Column) -> Column:
    return F.regexp_replace(column, "[\"'`]", "")


def join_path(prefix: Column, route: Column) -> Column:
    """Prefix and route with one slash between; the root is ``/``."""
    p = F.regexp_replace(F.coalesce(prefix, F.lit("")), "/+$", "")
    r = F.regexp_replace(F.coalesce(route, F.lit("")), "^/+", "")
    out = F.when(r == "", p).otherwise(F.concat(p, F.lit("/"), r))
    return F.when(out == "", F.lit("/")).when(out.startswith("/"), out).otherwise(F.concat(F.lit("/"), out))


def module_path(column: Column) -> Column:
    """A module's path without ``./``, extension and ``/index``."""
    out = F.regexp_replace(F.regexp_replace(column, r"^(?:\.{1,2}/)+", ""), r"\.(?:js|ts|jsx|tsx|mjs|cjs)$", "")
    return F.regexp_replace(out, "/index$", "")


def version_suffix(column: Column) -> Column:
    return F.regexp_extract(column, r"(v\d+)$", 1)


def one_line(column: Column, most: int = 60) -> Column:
    """White space single, trimmed, cut with dots."""
    out = F.trim(F.regexp_replace(column, r"\s+", " "))
    return F.when(F.length(out) > most, F.concat(F.left(out, F.lit(most - 3)), F.lit("..."))).otherwise(out)


def normalize_step(code: Column) -> Column:
    """Code of a flow step for comparison: one line, no trailing semicolon, no outer parentheses."""
    out = F.trim(F.regexp_replace(code, r"\s+", " "))
    out = F.regexp_replace(out, r"\s*;+\s*$", "")
    return F.regexp_replace(out, r"^\((.*)\)$", "$1")


def interpolated(code: Column) -> Column:
    """Names in braces."""
    return F.regexp_extract_all(code, F.lit(r"\{(\w+)\}"), F.lit(1))


#: Words that are no candidate unless they are the whole code.
PLAIN_WORDS = ("SELECT", "FROM", "WHERE", "AND", "OR", "LIKE", "ORDER", "BY", "LIMIT", "INSERT", "INTO", "VALUES", "UPDATE", "SET", "DELETE", "NULL", "IS")


def candidates(code: Column) -> Column:
    """Texts to look for in a file where a code snippet is not found as it is: longest first, then as they come.

    The snippet, the parts between its commas without quotes, what follows its first
    equals sign, whole calls with their arguments, and dotted names; of three characters
    at least, words of SQL only if they are all there is.
    """
    whole = F.trim(code)
    parts = F.when(F.contains(whole, F.lit(",")), F.transform(F.split(whole, ","), lambda x: F.regexp_replace(F.trim(x), "^[\"'`]+|[\"'`]+$", "")))
    after = F.when(F.contains(whole, F.lit("=")), F.array(F.trim(F.regexp_replace(whole, r"(?s)^[^=]*=", ""))))
    calls = F.regexp_extract_all(whole, F.lit(r"[A-Za-z_][\w.]*\s*\([^)]*\)"), F.lit(0))
    names = F.regexp_extract_all(whole, F.lit(r"[A-Za-z_][\w.]*"), F.lit(0))
    none = F.array().cast("array<string>")
    every = F.transform(F.concat(F.array(whole), F.coalesce(parts, none), F.coalesce(after, none), calls, names), lambda x: F.trim(x))
    kept = F.filter(F.array_distinct(every), lambda x: (F.length(x) > 2) & ~(F.upper(x).isin(*PLAIN_WORDS) & (F.length(x) < F.length(whole))))
    ordered = F.array_sort(F.transform(kept, lambda x, i: F.struct((-F.length(x)).alias("n"), i.alias("i"), x.alias("v"))))
    return F.transform(ordered, lambda x: x["v"])


def occurrences(text: Column, word: str) -> Column:
    """Occurrences that do not overlap; texts without the word cost one search and no copy."""
    gone = F.octet_length(text) - F.octet_length(F.replace(text, F.lit(word), F.lit("")))
    return F.when(F.contains(text, F.lit(word)), (gone / len(word.encode())).cast("int")).otherwise(0)


def is_literal_code(code: Column) -> Column:
    return code.rlike(r"""^\s*(?:[rbfu]{0,2}["'`].*["'`]|-?\d+(?:\.\d+)?|True|False|None|true|false|null)\s*$""")


def is_assignment(name: Column) -> Column:
    return F.coalesce(name.startswith("<operator>.assignment"), F.lit(False))


def token_estimate(text: Column) -> Column:
    """Tokens of a text where no tokenizer is given: a quarter of its characters, rounded up."""
    return F.ceil(F.length(text) / 4).cast("long")


def glob_to_regex(pattern: str) -> str:
    """A file-name pattern with * ? and [] as a regular expression."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and (j := pattern.find("]", i + 1)) > 0:
            inner = pattern[i + 1 : j]
            out += "[" + ("^" + inner[1:] if inner.startswith("!") else inner) + "]"
            i = j
        else:
            out += re.escape(c)
        i += 1
    return out


def sarif_level(severity: Column) -> Column:
    """Severity 1..5 as a level."""
    return F.when(severity >= 4, "error").when(severity == 3, "warning").otherwise("note")


def sarif_rank(severity: Column) -> Column:
    return F.when(severity == 5, 95.0).when(severity == 4, 80.0).when(severity == 3, 50.0).when(severity == 2, 25.0).otherwise(10.0)


def step_text(file: Column, line: Column, code: Column) -> Column:
    return F.concat_ws(":", file, line.cast("string"), F.concat(F.lit(" "), code))
