"""Scalar functions, files and ignore rules."""

import os

import pytest
from graphsieve.functions import text as X
from graphsieve.operators import findings, regions, scoring
from graphsieve.sources import files
from pyspark.sql import functions as F


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "c string").select(make(F.col("c")).alias("r")).collect()[0]["r"]


@pytest.mark.parametrize(
    "make, value, want",
    [
        (lambda c: X.full_match(c, "ab"), "ab", True),
        (lambda c: X.full_match(c, "ab"), "ab\n", False),
        (lambda c: X.full_match(c, "a|b"), "b", True),
        (X.lenient_int, "12", 12),
        (X.lenient_int, "1.5", None),
        (X.lenient_int, "x", None),
        (X.strip_quotes, "\"a'b`", "ab"),
        (lambda c: X.join_path(F.lit("/api/"), c), "/x", "/api/x"),
        (lambda c: X.join_path(F.lit(""), c), "", "/"),
        (X.module_path, "./routers/v1/index.js", "routers/v1"),
        (X.version_suffix, "api/v12", "v12"),
        (lambda c: X.one_line(c, 10), " a\n b   cdefghijk", "a b cde..."),
        (X.normalize_step, "(a +\n b) ;", "a + b"),
        (X.interpolated, "f'{a} {b_1} {c.d}'", ["a", "b_1"]),
        (lambda c: X.occurrences(c, "aa"), "aaaaa", 2),
        (lambda c: X.occurrences(c, "é"), "éxé", 2),
        (X.is_literal_code, "'x'", True),
        (X.is_literal_code, "x", False),
        (X.short_method, "f.py:A.b(int)", "A.b"),
        (X.token_estimate, "abcde", 2),
        (X.candidates, 'run("some text", name)\nmore', ['run("some text", name)\nmore', 'run("some text", name)', 'run("some text', "name)\nmore", "some", "text", "name", "more", "run"]),
    ],
)
def test_scalar(spark, make, value, want):
    got = one(spark, value, make)
    assert sorted(got, key=str) == sorted(want, key=str) if isinstance(want, list) else got == want


def test_class_names(spark):
    df = spark.createDataFrame([("a.B", "f.py", "m", "f.py:B.m"), (None, "f.js", "m", "f.js::program:K.m"), ("src/x.js::program", "src/x.js", "m", "z"), ("<empty>", "f", "m", "pkg.Q.m(int)")], "d string, f string, n string, m string")
    got = [r[0] for r in df.select(X.class_name(F.col("d"), F.col("f"), F.col("n"), F.col("m"))).collect()]
    assert got == ["a.B", got[1], "x", "Q"]


def test_ignore_rules():
    rules = files.ignore_rules(["# note", "*.log", "build/", "/top.txt", "docs/**/x.md", "!keep.log"])
    cases = {"a.log": True, "d/a.log": True, "keep.log": False, "build/x": True, "d/build/x": True, "buildx": False, "top.txt": True, "d/top.txt": False, "docs/a/b/x.md": True, "a.py": False}
    assert {p: files.ignored(p, rules) for p in cases} == cases


def test_fingerprint(tmp_path):
    (tmp_path / "a.py").write_text("1")
    (tmp_path / "node_modules").mkdir()
    first = files.fingerprint(str(tmp_path))
    (tmp_path / "node_modules/x.js").write_text("2")
    assert files.fingerprint(str(tmp_path)) == first
    os.utime(tmp_path / "a.py", (1, 1))
    assert files.fingerprint(str(tmp_path)) != first
    assert files.cache_key(str(tmp_path), "python", ["b", "a"]) == files.cache_key(str(tmp_path), "python", ["a", "b"]) != files.cache_key(str(tmp_path))


def test_score(spark):
    rows = [("src/auth.py", "login " * 30), ("frontend/x.py", "plain"), ("a.tsx", "checkpermission"), ("z.txt", "")]
    df = scoring.score_files(spark.createDataFrame(rows, "path string, content string"), spark.createDataFrame([("z.txt", 50, ["r"]), ("z.txt", 70, ["q"])], "path string, boost int, reasons array<string>"))
    got = {r["path"]: (r["score"], r["reasons"]) for r in df.collect()}
    assert got["src/auth.py"][0] == 30 + 5 - 40 and got["frontend/x.py"][0] == -60
    assert got["a.tsx"][0] == 5 + 15 - 40 and got["z.txt"] == (70, ["q", "r"])


def test_budget_stops_at_the_first_overflow(spark):
    df = spark.createDataFrame([("a", 9, 60), ("b", 9, 30), ("c", 5, 20), ("d", 1, 5)], "path string, score int, tokens int")
    assert {r["path"]: r["used"] for r in findings.budget_prefix(df, 100).collect()} == {"a": 60, "b": 90}


def test_budget_within_one_score(spark):
    sizes = [(f"f{i:04d}", 0 if i < 900 else 1, i * 7 % 11) for i in range(1000)]
    rows, total = {}, 5
    for path, _, n in sorted(sizes, key=lambda r: (-r[1], r[0])):
        total += n
        if total <= 2000:
            rows[path] = total
    df = spark.createDataFrame(sizes, "path string, score int, tokens int").repartition(4)
    assert {r["path"]: r["used"] for r in findings.budget_prefix(df, 2000, 5).collect()} == rows


def test_files_and_regions(spark):
    named = regions.locate_files(spark.createDataFrame([("src/a.py",), ("x/b.py",), ("none",)], "name string"), spark.createDataFrame([("src/a.py",), ("lib/b.py",)], "path string"))
    assert {r["name"]: r["path"] for r in named.collect()} == {"src/a.py": "src/a.py", "x/b.py": "lib/b.py", "none": None}
    lines = regions.file_lines(spark.createDataFrame([("f", "x\nhit\n\nhit\nhit")], "path string, content string"))
    got = regions.resolve_regions(spark.createDataFrame([(1, "f", 4, "hit"), (2, "f", 1, "hit"), (3, "f", 1, "no"), (4, "f", 99, "hit")], "key int, path string, line int, snippet string"), lines)
    assert {r["key"]: r["found_line"] for r in got.collect()} == {1: 4, 2: 2, 3: None, 4: 2}


def test_runs_drop_what_others_contain(spark):
    df = spark.createDataFrame([(1, 1, "f", 1, "m", "a"), (1, 2, "f", 1, "m", "g(a)"), (1, 3, "f", 2, "m", "b")], "id int, k int, file string, line int, method string, code string")
    got = {r["run"]: r["codes"] for r in findings.runs(df, ["id"]).collect()}
    assert got == {1: ["g(a)"], 2: ["b"]}
