"""Scores of files for security review, as column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import base_name, full_match, glob_to_regex
from ..rules.scoring import AUTH_GUARD_KEYWORDS, BACKEND_PATH_HINTS, CRITICAL_FILE_PATTERNS, FRONTEND_PATH_HINTS, FRONTEND_SUFFIXES, SECURITY_KEYWORDS


def keyword_counts(text: Column) -> Column:
    """array<int>: occurrences of each keyword.

    One loop over an array of the keywords: dozens of unrolled searches would make a
    generated method that is too large for the JVM to compile.
    """

    def count(word: Column) -> Column:
        gone = F.octet_length(text) - F.octet_length(F.replace(text, word, F.lit("")))
        return F.when(F.contains(text, word), (gone / F.octet_length(word)).cast("int")).otherwise(0)

    return F.transform(F.array(*[F.lit(k) for k in SECURITY_KEYWORDS]), count)


def is_frontend(path: Column) -> Column:
    """The path has a front-end hint and no back-end hint."""
    p = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    front = F.lit(False)
    for h in FRONTEND_PATH_HINTS:
        front = front | p.contains(h)
    back = F.lit(False)
    for h in BACKEND_PATH_HINTS:
        back = back | p.contains(h)
    return front & ~back


def score_files(files: DataFrame, boosts: DataFrame | None = None) -> DataFrame:
    """path, score, reasons of files (path, content); boosts: path, boost, reasons.

    Pattern 30; boost as given; 5 a keyword up to 50, less 2 a repetition up to 40 where
    repetitions dominate; 15 a guard signal up to 45; front-end code -60, else front-end
    file types -40.
    """
    files = files.withColumn("_text", F.lower("content"))
    text = F.col("_text")
    files = files.withColumn("_counts", keyword_counts(text))
    hits, total = F.size(F.filter("_counts", lambda c: c > 0)), F.aggregate("_counts", F.lit(0), lambda a, c: a + c)
    name = F.lower(base_name(F.col("path")))
    pattern = None
    for p in CRITICAL_FILE_PATTERNS:
        hit = full_match(name, f"(?s){glob_to_regex(p)}")
        pattern = F.when(hit, F.lit(p)) if pattern is None else pattern.when(hit, F.lit(p))
    guards = F.size(F.filter(F.array(*[F.lit(k) for k in AUTH_GUARD_KEYWORDS]), lambda k: F.contains(text, k)))
    out = files.select("*", hits.alias("_hits"), total.alias("_total"), guards.alias("_guards"), pattern.alias("_pattern"), is_frontend(F.col("path")).alias("_front"), F.lower("path").rlike(rf"\.({'|'.join(FRONTEND_SUFFIXES)})$").alias("_type"))
    if boosts is not None:
        best = boosts.groupBy("path").agg(F.max("boost").alias("_boost"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("reasons")))).alias("_why"))
        out = out.join(best, "path", "left")
    else:
        out = out.withColumn("_boost", F.lit(0)).withColumn("_why", F.expr("cast(array() as array<string>)"))
    excess = F.col("_total") - F.col("_hits")
    repeats = (F.col("_hits") > 0) & (excess >= 10) & (F.col("_total") >= 3 * F.col("_hits"))
    score = (
        F.when(F.col("_pattern").isNotNull(), 30).otherwise(0)
        + F.coalesce("_boost", F.lit(0))
        + F.least(5 * F.col("_hits"), F.lit(50))
        - F.when(repeats, F.least(2 * excess, F.lit(40))).otherwise(0)
        + F.least(15 * F.col("_guards"), F.lit(45))
        - F.when(F.col("_front"), 60).when(F.col("_type"), 40).otherwise(0)
    )
    why = F.array_compact(
        F.concat(
            F.array(F.when(F.col("_pattern").isNotNull(), F.concat(F.lit("Matches pattern '"), "_pattern", F.lit("'")))),
            F.coalesce("_why", F.expr("cast(array() as array<string>)")),
            F.array(
                F.when(F.col("_hits") > 0, F.concat(F.lit("Contains "), F.col("_hits").cast("string"), F.lit(" security keywords"))),
                F.when(repeats, F.concat(F.lit("Keyword repetition penalty ("), excess.cast("string"), F.lit(" repeats)"))),
                F.when(F.col("_guards") > 0, F.concat(F.lit("Auth/permission guard signals ("), F.col("_guards").cast("string"), F.lit(")"))),
                F.when(F.col("_front"), "Frontend code penalty").when(F.col("_type"), "Frontend file type penalty"),
            ),
        )
    )
    return out.withColumn("score", score.cast("int")).withColumn("reasons", why).drop("_text", "_counts", "_hits", "_total", "_guards", "_pattern", "_front", "_type", "_boost", "_why")


def distance_boost(distance: Column, category: Column) -> Column:
    """Boost of a file by its method's distance to a sink: 150 at the sink, 120 - 20 d nearby, else 40."""
    return F.when(category.isNotNull(), 150).when(distance < 5, 120 - 20 * distance).otherwise(40).cast("int")
