"""Mixing sources to target weights by pivotal dependent rounding.

A source with ``S`` words and target ``T`` asks for ``r = T / S`` copies of each of
its documents.  ``floor(r)`` copies are certain; the fraction is rounded by the
pivotal method: two undecided parties exchange *words* (probability times size)
until one of them is at 0 or 1, the direction drawn so that each probability keeps
its expectation.  Within a chunk a document is paired with the pool of the smaller
ones, which share one probability; leftovers of chunks are paired one to one.  The words taken stay equal to the target through every exchange;
only the last undecided document of a source is rounded by a plain draw.  Each
task rounds one chunk of a source and leaves at most one undecided document; the
leftovers meet in chunks again, a reduction tree, until each source has one.

All draws are hashes of (seed, document), so reruns agree on any cluster.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, partitions, ship, word_count

CHUNK = 8192
LOT = 65536  # equal rows that one task deals out
MOST_COPIES = 3.0
CYCLE = (5.0, 2.0, 1.0)


def targets(sizes: dict[str | None, int], weights: dict[str | None, float], most: float = MOST_COPIES) -> dict[str | None, float]:
    """Share all words by weight; a target stops at ``most`` times its source's words.

    The excess goes to the other sources by weight until none is above its limit.
    """
    left, open_, out = float(sum(sizes.values())), {k for k, n in sizes.items() if n > 0}, dict.fromkeys(sizes, 0.0)
    while open_:
        total = sum(weights[k] for k in open_)
        full = [k for k in open_ if left * weights[k] / total > most * sizes[k]] if total > 0 else []
        if not full:
            out.update({k: left * weights[k] / total if total > 0 else 0.0 for k in open_})
            break
        for k in full:
            out[k] = most * sizes[k]
        left -= sum(out[k] for k in full)
        open_ -= set(full)
    return out


def cycle_weights(sources: Iterable[str | None], cycle: tuple[float, ...] = CYCLE) -> dict[str | None, float]:
    """Sources by code point, null last, take the weights of the cycle in turn."""
    ordered = sorted(sources, key=lambda s: (s is None, s or ""))
    return {s: cycle[i % len(cycle)] for i, s in enumerate(ordered)}


def pivot(p: np.ndarray, size: np.ndarray, draw: np.ndarray) -> tuple[np.ndarray, int]:
    """Round probabilities one after the other; the index of the undecided one, or -1.

    ``draw`` has a uniform number for each element.  Elements of size 0 must not occur.
    """
    p, held = p.astype(float).copy(), -1
    for i in range(len(p)):
        if p[i] <= 1e-9 or p[i] >= 1 - 1e-9:
            p[i] = round(p[i])
            continue
        if held < 0:
            held = i
            continue
        a, b, sa, sb = p[held], p[i], size[held], size[i]
        up = min((1 - a) * sa, b * sb)  # words that may go from i to held
        down = min(a * sa, (1 - b) * sb)
        if draw[i] * (up + down) < down:
            a, b = a + up / sa, b - up / sb
        else:
            a, b = a - down / sa, b + down / sb
        p[held], p[i] = a, b
        if 1e-9 < b < 1 - 1e-9:
            p[held] = round(a)
            held = i
        else:
            p[i] = round(b)
            if not 1e-9 < a < 1 - 1e-9:
                p[held] = round(a)
                held = -1
    return p, held


def pivot_pool(q: float, size: np.ndarray, draw: np.ndarray) -> tuple[np.ndarray, int]:
    """Round documents that share the probability q, the largest first; the undecided one or -1.

    Each document exchanges words with the pool of all that follow, whose common
    probability moves, until the document or the pool is integral.  So large documents
    are settled against many small ones, and what stays undecided is small.
    """
    n = len(size)
    after = np.cumsum(size[::-1])[::-1] - size
    out = np.zeros(n)
    for i in range(n):
        if q <= 1e-12 or q >= 1 - 1e-12:
            out[i:] = round(q)
            return out, -1
        s, rest = size[i], after[i]
        if rest <= 0:
            out[i] = q
            return out, i
        up, down = min((1 - q) * s, q * rest), min(q * s, (1 - q) * rest)
        if draw[i] * (up + down) < down:
            mine, q = q + up / s, q - up / rest
        else:
            mine, q = q - down / s, q + down / rest
        q = min(1.0, max(0.0, q))
        if 1e-9 < mine < 1 - 1e-9:  # the pool is integral
            out[i], out[i + 1 :] = mine, round(q)
            return out, i
        out[i] = round(mine)
    return out, -1


def _round_chunk(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["size", "h", "key"], ascending=[False, True, True], kind="stable", ignore_index=True)
    draw = ((pdf["h"].to_numpy(np.int64).view(np.uint64) >> np.uint64(11)).astype(float)) / float(1 << 53)
    size = pdf["size"].to_numpy(np.float64)
    p = pdf["p"].to_numpy(np.float64).copy()
    some = size > 0
    if some.any():
        shared = p[some]
        p[some], held = pivot_pool(shared[0], size[some], draw[some]) if (shared == shared[0]).all() else pivot(shared, size[some], draw[some])
    else:
        held = -1
    p[~some] = (draw[~some] < p[~some]).astype(float)
    open_ = np.zeros(len(p), bool)
    if held >= 0:
        open_[np.flatnonzero(some)[held]] = True
    pdf["p"], pdf["open"] = p, open_
    return pdf[["src", "chunk", "key", "h", "size", "p", "open"]]


_ROUNDED = "src int, chunk long, key long, h long, size long, p double, open boolean"


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: dict[str | None, float] | None = None, most: float = MOST_COPIES, seed: int = 7, size: Column | None = None) -> DataFrame:
    """One row for each row of ``docs``: id, size, source_size, target, taken, copies.

    Null texts have size 0; documents without words take nothing that counts.  A null
    source is a source of its own, last in order.  Null or repeated ids are rows like
    others (draws also use the text's hash; equal rows are numbered, and draw by number).
    An empty table gives an empty plan.  Other columns are ignored, whatever their
    names.  The table of sources meets on the driver: one row a source, as many as
    there are weights to set.
    """
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "mix")
    base = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), (word_count(F.col(text_col)) if size is None else size.cast("long")).alias("size"), F.xxhash64(F.col(id_col), F.col(text_col), F.lit(seed)).alias("row"))
    # equal rows are counted and dealt out again by number, so that they go to different chunks and draw for themselves
    counted = base.groupBy("id", "source", "size", "row").agg(F.count("*").alias("n"))
    many = counted.withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / LOT)))).repartition(partitions(spark), "row", "lot")
    several = F.sequence(F.col("lot") * LOT, F.least(F.col("n"), (F.col("lot") + 1) * LOT) - 1)
    base = many.select("id", "source", "size", "row", F.explode(several).alias("i"))
    base = base.select("id", "source", "size", "row", F.when(F.col("i") == 0, F.col("row")).otherwise(F.xxhash64("row", "i")).alias("h"))
    base = scratch.save(base.withColumn("key", F.monotonically_increasing_id()), "sizes")
    stats = base.groupBy("source").agg(F.sum("size").alias("n"), F.count("*").alias("rows")).toPandas()
    names = [None if pd.isna(s) else s for s in stats["source"]]
    sizes = dict(zip(names, (int(x) for x in stats["n"])))
    rows = dict(zip(names, (int(x) for x in stats["rows"])))
    weights = weights if weights is not None else cycle_weights(names)
    goal = targets(sizes, {k: weights.get(k, 0.0) for k in sizes}, most)
    order = sorted(names, key=lambda s: (s is None, s or ""))
    table = pd.DataFrame({"_s": order, "src": range(len(order)), "source_size": [sizes[s] for s in order], "target": [goal[s] for s in order], "chunks": [max(1, -(-rows[s] // CHUNK)) for s in order]})
    small = spark.createDataFrame(table, "_s string, src int, source_size long, target double, chunks long")
    # the source table: one row for each weight that a person sets
    full = base.join(F.broadcast(small), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    full = full.withColumn("r", ratio).withColumn("whole", F.floor("r").cast("long"))
    todo = full.select("src", F.pmod(F.xxhash64("h", F.lit(seed + 1)), F.col("chunks")).alias("chunk"), "key", "h", "size", (F.col("r") - F.col("whole")).alias("p"))
    level = scratch.save(todo.groupBy("src", "chunk").applyInPandas(_round_chunk, _ROUNDED), "level0")
    left, settled, k = level.where("open"), None, 0
    while True:
        n = dict(left.groupBy("src").count().toPandas().itertuples(index=False, name=None))
        if not n or max(n.values()) <= 1:
            break
        k += 1
        most_rows = max(n.values())
        again = left.select("src", F.pmod(F.xxhash64("h", F.lit(seed + 2 + k)), F.lit(-(-most_rows // CHUNK))).alias("chunk"), "key", "h", "size", "p")
        here = scratch.save(again.groupBy("src", "chunk").applyInPandas(_round_chunk, _ROUNDED), f"level{k}")
        done = here.where("not open").select("key", F.col("p").alias("late"))
        settled = done if settled is None else settled.unionByName(done)
        left = here.where("open")
    draw = (F.shiftrightunsigned(F.xxhash64("h", F.lit(seed + 999)), 11).cast("double")) / F.lit(float(1 << 53))
    final = left.select("key", (draw < F.col("p")).cast("double").alias("late"))
    settled = final if settled is None else settled.unionByName(final)
    # leftovers only: one row for each chunk of the first level
    taken = level.join(settled, "key", "left").select("key", F.coalesce(F.when(F.col("open"), F.col("late")), F.col("p")).alias("extra"))
    copies = (F.col("whole") + F.coalesce(F.round("extra"), F.lit(0.0)).cast("long")).cast("long")
    out = full.join(taken, "key").select(F.col("id").alias(id_col), "source", "size", "source_size", "target", copies.alias("copies"), "row")
    return out.select(id_col, "source", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "row")


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7, **options) -> DataFrame:
    """The documents of the mix, each repeated as often as the plan takes it; columns as in ``docs``.

    Equal rows share what the plan gives to them, the first by the hash of all their
    columns take what does not divide.
    """
    plan = mix_plan(docs, id_col, text_col, source_col, seed=seed, **options)
    per = plan.groupBy(F.col("row").alias("__gs_ph"), F.hash(id_col, "size").alias("__gs_ph2")).agg(F.sum("copies").alias("__gs_all"), F.count("*").alias("__gs_rows"))
    marked = docs.withColumn("__gs_h", F.xxhash64(F.col(id_col), F.col(text_col), F.lit(seed))).withColumn("__gs_h2", F.hash(F.col(id_col), word_count(F.col(text_col))))
    marked = marked.withColumn("__gs_all_columns", F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))
    # a merge join deals both sides by the key that the window needs: text moves once
    joined = marked.join(per.where("__gs_all > 0").hint("merge"), (F.col("__gs_h") == F.col("__gs_ph")) & (F.col("__gs_h2") == F.col("__gs_ph2")))
    turn = F.row_number().over(Window.partitionBy("__gs_h", "__gs_h2").orderBy("__gs_all_columns"))
    n = (F.floor(F.col("__gs_all") / F.col("__gs_rows")) + (F.col("__gs_turn") <= F.col("__gs_all") % F.col("__gs_rows")).cast("long")).cast("int")
    joined = joined.withColumn("__gs_turn", turn).withColumn("__gs_n", n)
    return joined.where("__gs_n > 0").withColumn("__gs_i", F.explode(F.sequence(F.lit(1), F.col("__gs_n")))).select(*[F.col(f"`{c}`") for c in docs.columns])
