"""Sharding by a hierarchical weighted hash tree.

A topology is a tree of regions, racks and shards with weights; a node weighs what
its shards weigh.  A row descends the tree: at each level every child gets a draw
``-ln(u) / weight`` with ``u`` a hash of (row key, child's name), and the smallest
wins.  A changed weight moves rows only into or out of the subtree that has it.
Expressions are native, rows are never shuffled to choose a shard.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, running, ship

SHARDS_A_RACK, RACKS_A_REGION = 4, 2


@dataclass(frozen=True)
class Shard:
    number: int
    region: int
    rack: int
    weight: float = 1.0


def topology(n: int, built: int | None = None) -> tuple[Shard, ...]:
    """``n`` equal shards, of which the first ``built`` (all, if not given) were laid out at once.

    Those are racks of four and regions of two racks; what is left over there, and each
    shard that was added later, is a region of its own.  So ``grow(topology(n, built))``
    is ``topology(n + 1, built)``, and rows move only into the new shard.  A tree that was
    laid out anew for another number of shards is another tree: a cluster keeps its
    ``built``.  Sixteen shards are two regions of two racks of four.
    """
    whole = SHARDS_A_RACK * RACKS_A_REGION
    built = n if built is None else built
    base = min(n, built) // whole * whole
    out = [Shard(s, s // whole, s // SHARDS_A_RACK) for s in range(base)]
    return tuple(out + [Shard(s, base // whole + s - base, base // SHARDS_A_RACK + s - base) for s in range(base, n)])


def grow(tree: tuple[Shard, ...], weight: float = 1.0) -> tuple[Shard, ...]:
    """One more shard in a region and rack of its own: rows move only into it."""
    return (*tree, Shard(max((s.number for s in tree), default=-1) + 1, max((s.region for s in tree), default=-1) + 1, max((s.rack for s in tree), default=-1) + 1, weight))


def _draw(key: Column, level: str, node: int, weight: float) -> Column:
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(level), F.lit(node)), 12).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))
    return -F.log(u) / F.lit(float(weight))


def _choose(key: Column, level: str, children: dict[int, float]) -> Column:
    live = {k: w for k, w in children.items() if w > 0}
    if len(live) == 1:
        return F.lit(next(iter(live)))
    return F.least(*[F.struct(_draw(key, level, k, w).alias("d"), F.lit(k).alias("k")) for k, w in sorted(live.items())])["k"]


def place(key: Column, tree: tuple[Shard, ...]) -> Column:
    """The shard of a key: one weighted draw a level."""
    regions: dict[int, dict[int, dict[int, float]]] = {}
    for s in tree:
        if s.weight > 0:
            regions.setdefault(s.region, {}).setdefault(s.rack, {})[s.number] = s.weight
    if not regions:
        raise ValueError("a topology needs a shard with a weight above 0")
    total = {r: {k: sum(v.values()) for k, v in racks.items()} for r, racks in regions.items()}

    def case(value: Column, options: dict[int, Column]) -> Column:
        items = sorted(options.items())
        out = None
        for k, v in items[:-1]:
            out = F.when(value == k, v) if out is None else out.when(value == k, v)
        return items[-1][1] if out is None else out.otherwise(items[-1][1])

    region = _choose(key, "region", {r: sum(t.values()) for r, t in total.items()})
    rack = case(region, {r: _choose(key, "rack", t) for r, t in total.items()})
    racks = {k: v for r in regions.values() for k, v in r.items()}
    return case(rack, {k: _choose(key, "shard", v) for k, v in racks.items()}).cast("int")


def shard_documents(docs: DataFrame, n: int = 16, id_col: str = "doc_id", text_col: str = "text", tree: tuple[Shard, ...] | None = None) -> DataFrame:
    """id, size, text_crc32, law, shard, slot, grown_shard for each row.

    size: UTF-8 bytes plus 1 (null: 1); text_crc32 of a null text is that of "".  A null
    id is a key of its own.  slot counts a shard's rows from 0 by id, then crc, then
    order of reading.  Equal ids share a shard; equal rows have slots of their own.
    Empty tables give no rows; other columns are not read.
    """
    spark = docs.sparkSession
    ship(spark)
    tree = topology(n) if tree is None else tree
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"))
    rows = rows.select("*", place(F.col("id"), tree).alias("shard"), place(F.col("id"), grow(tree)).alias("grown_shard"), F.lit(1).cast("long").alias("one"))
    scratch = Scratch(spark, "shards")
    out = running(scratch.save(rows, "placed"), scratch, "ranked", ["shard", "id", "text_crc32"], {"slot": "one"}, group="shard")
    return out.select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
