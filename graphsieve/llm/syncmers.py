"""Document fingerprints from closed syncmers, in native expressions only.

Symbols are words.  A k-mer of ``K`` words is selected when the smallest of its
``K - S + 1`` inner S-mers stands at its first or last place.  Whether it is selected
depends on its own words alone, so an edit moves no anchors but those that touch it,
and two texts can be matched by the positions of the anchors they share.

A fingerprint is the ``SKETCH`` smallest distinct hashes of the selected k-mers (a
bottom sketch, 32 bits each, ascending, eight hex digits each); the likeness of two
is their estimate of the Jaccard similarity of the two texts' anchors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_CLASS, Scratch, partitions

K, S, SKETCH = 6, 3, 128


def _hashes(text: Column) -> Column:
    """Hash of each word; white space at an end makes an empty word there."""
    return F.transform(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS), lambda w: F.xxhash64(w))


def anchors(text: Column, k: int = K, s: int = S) -> Column:
    """array<struct<at, hash>> of the closed syncmers: place of the first word, from 0, and hash.

    A text in which no k-mer is closed, or of fewer than k words, has one anchor, all of its words.
    """
    span = k - s + 1
    symbols = _hashes(text)
    # the symbols and their S-mers are bound by one-element arrays, so that they are computed once
    def select(h: Column, inner: Column) -> Column:
        def place(i: Column) -> Column:
            at = [F.get(inner, i + j) for j in range(span)]
            low = F.least(*at)
            closed = (low == at[0]) | (low == at[-1])
            cover = sorted({*range(0, span, s), span - 1})  # S-mers that hold all words of the k-mer
            return F.when(closed, F.struct(i.alias("at"), F.xxhash64(*[at[j] for j in cover]).alias("hash")))

        return F.filter(F.transform(F.sequence(F.lit(0), F.size(h) - k), place), lambda x: x.isNotNull())

    def whole(h: Column) -> Column:
        return F.array(F.struct(F.lit(0).alias("at"), F.aggregate(h, F.lit(0).cast("long"), lambda a, x: F.xxhash64(a, x)).alias("hash")))

    def both(h: Column) -> Column:
        def some(found: Column) -> Column:
            return F.when(F.size(found) > 0, found).otherwise(whole(h))

        inner = F.transform(F.sequence(F.lit(0), F.size(h) - s), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(s)]))
        found = F.transform(F.array(inner), lambda m: select(h, m))
        return F.when(F.size(h) >= k, F.element_at(F.transform(found, some), 1)).otherwise(whole(h))

    return F.element_at(F.transform(F.array(symbols), both), 1)


def sketch(found: Column, size: int = SKETCH) -> Column:
    """array<bigint>: the smallest distinct 32-bit hashes of anchors, ascending."""
    low = F.transform(found, lambda a: F.shiftrightunsigned(a["hash"], 32))
    return F.slice(F.sort_array(F.array_distinct(low)), 1, size)


def fingerprint(found: Column) -> Column:
    """A sketch as text, eight hex digits a hash."""
    return F.array_join(F.transform(found, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def likeness(a: Column, b: Column, size: int = SKETCH) -> Column:
    """Share of the smallest hashes of both sketches together that both have."""
    both = F.slice(F.sort_array(F.array_union(a, b)), 1, size)
    return F.when(a == b, F.lit(1.0)).otherwise(F.size(F.array_intersect(F.array_intersect(both, a), b)) / F.size(both))


def shared_anchors(a: DataFrame, b: DataFrame, id_a: str, id_b: str, text: str = "text") -> DataFrame:
    """id_a, at_a, id_b, at_b for anchors that texts of both sides share, joined by hash."""
    left = a.select(F.col(id_a), F.explode(anchors(F.col(text))).alias("x")).select(id_a, F.col("x.at").alias("at_a"), F.col("x.hash").alias("hash"))
    right = b.select(F.col(id_b), F.explode(anchors(F.col(text))).alias("y")).select(id_b, F.col("y.at").alias("at_b"), F.col("y.hash").alias("hash"))
    return left.join(right, "hash").drop("hash")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text: the last quarter replaced by the beginning of the next.

    Documents follow each other by ascending id, then by text; the last is followed by
    the first, a single one by itself.  Null texts are empty and null ids come first.
    Empty tables give no rows; other columns are not read.

    Neighbours are found within ranges of ids.  The first document of each range also
    goes to the range before, as the neighbour of its last, so that texts move once.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "syncmers")
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"))
    n = 6 * partitions(spark)
    key = F.coalesce(F.col("id"), F.lit(-(1 << 63)))
    # the sampled ranges of a range partitioning, of which each task's first id comes here: n numbers at most
    dealt = scratch.save(base.select(key.alias("key")), "ids").repartitionByRange(n, "key")
    firsts = sorted(r["first"] for r in dealt.groupBy(F.spark_partition_id().alias("p")).agg(F.min("key").alias("first")).collect())
    before = {k: i - 1 if i else len(firsts) - 1 for i, k in enumerate(firsts)}  # the first of all goes to the last range
    part = _range_of(key, firsts[1:])
    rows = base.withColumn("part", part)
    if before:
        pairs = spark.createDataFrame([(int(k), int(v)) for k, v in before.items()], "first long, ghost int")
        rows = rows.join(F.broadcast(pairs), key == F.col("first"), "left").drop("first")
    else:
        rows = rows.withColumn("ghost", F.lit(None).cast("int"))
    here = F.struct(F.col("part").cast("int").alias("p"), F.lit(0).alias("g"))
    there = F.struct(F.col("ghost").alias("p"), F.lit(1).alias("g"))
    spread = rows.withColumn("n_chars", F.char_length("text").cast("long")).withColumn("fp", sketch(anchors(F.col("text"))))
    spread = spread.withColumn("to", F.explode(F.when(F.col("ghost").isNull(), F.array(here)).otherwise(F.array(here, there))))
    spread = spread.select(F.col("to.p").alias("p"), F.col("to.g").alias("g"), "id", "text", "n_chars", "fp")
    w = Window.partitionBy("p").orderBy("g", F.col("id").asc_nulls_first(), "text")
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    head = F.expr("left(text, cast(floor(lag_n / 4) as int))")
    seen = spread.withColumn("lag_n", F.lag("n_chars").over(w)).withColumn("head", F.when(F.col("lag_n").isNotNull(), head))
    seen = seen.withColumn("next_head", F.lead("head").over(w)).withColumn("next_fp", F.lead("fp").over(w)).where("g = 0")
    keep = F.col("text").substr(F.lit(1), (F.col("n_chars") - quarter).cast("int"))
    edited = seen.select("id", "n_chars", "fp", "next_fp", F.concat(keep, F.coalesce("next_head", F.lit(""))).alias("edited"))
    edited = edited.select("id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fp", "next_fp", sketch(anchors(F.col("edited"))).alias("edited_fp"))
    return edited.select(F.col("id").alias(id_col), "n_chars", "edited_sha256", fingerprint(F.col("fp")).alias("fingerprint"), fingerprint(F.col("edited_fp")).alias("edited_fingerprint"), likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"))


def _range_of(key: Column, cuts: list[int]) -> Column:
    """How many of the ascending cuts are at or below the key, counted in two steps of about their root."""
    if not cuts:
        return F.lit(0)
    step = max(1, int(len(cuts) ** 0.5))
    groups = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    heads = F.array(*[F.lit(g[0]).cast("long") for g in groups])
    inner = F.array(*[F.array(*[F.lit(c).cast("long") for c in g]) for g in groups])
    full = F.size(F.filter(heads, lambda h: h <= key)) - 1
    return F.when(key < cuts[0], 0).otherwise(full * step + F.size(F.filter(F.get(inner, full), lambda c: c <= key))).cast("int")
