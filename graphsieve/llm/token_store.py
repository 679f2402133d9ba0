"""A content-addressed store of token ids.

Layout below one folder, all Parquet with binary columns, written by Spark so that
any store Spark writes to will do:

* ``staged/recipe=false``, the chunks: digest (blake2b-128 of the payload), n, payload (little-endian ids,
  16 bits where all ids allow, else 32).  A chunk is stored once.  The other
  part of ``staged`` is what the recipes are ordered from.
* ``recipes``: ordinal, doc_id, start, n_tokens, digests, root.  One row a document
  in ascending doc_id order; ``digests`` lists its chunks, ``root`` is the Merkle
  root over them, over doc_id and over n_tokens.
* ``manifest``: the Merkle root of the recipes of each ``RANGE`` ordinals, with the
  number of documents and ids in it, and under ``first`` -1 the root of all.

All of it follows from the documents alone: ranges are of ordinals, not of files or
partitions, so any layout gives the same roots.

Reading verifies what it reads.  A chunk is held against its digest; a recipe's root is
computed again from its digests, id and length; a range's root, first ordinal, counts and sums
from its recipes; the root of all from the ranges.  A document is verified if all of
them hold: a payload, recipe or manifest that was changed, swapped or dropped shows.

Chunks are cut where a rolling hash over ``WINDOW`` ids has its low bits at zero, so
equal passages cut alike wherever they stand; cuts nearer than ``LEAST`` to the one
before are passed over, and a chunk ends at ``MOST`` ids at the latest.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, lean, partitions, running, ship
from .tokens import Encoder

WINDOW, LEAST, MOST, MASK = 12, 96, 2048, np.uint64(511)
RANGE = 4096  # ordinals under one root of the manifest, and roots under one root of the next level
MANIFEST = "level int, at long, documents long, ids long, root binary"
_GEAR = np.random.Generator(np.random.PCG64(77)).integers(0, 1 << 63, 1 << 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def cuts(ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chunk ends and the text of each chunk. A text without ids has no chunk."""
    n = len(ids)
    with np.errstate(over="ignore"):
        g = _GEAR[ids & np.uint32(0xFFFF)] ^ (ids.astype(np.uint64) >> np.uint64(16))
        h = g.copy()
        for j in range(1, min(WINDOW, n)):
            h[j:] += g[:-j] << np.uint64(j)
        h ^= h >> np.uint64(29)
    wanted = np.flatnonzero(((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) & MASK == 0) + 1
    ends, docs = [], []
    lo = np.searchsorted(wanted, bounds[:-1], "left")
    hi = np.searchsorted(wanted, bounds[1:], "left")
    wanted = wanted.tolist()
    for d, (a, b, i, j) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), lo.tolist(), hi.tolist())):
        last = a
        for w in wanted[i:j]:
            # a window that reaches over the text's start does not count
            if w - a < WINDOW or w - last < LEAST:
                continue
            while w - last > MOST:
                last += MOST
                ends.append(last)
                docs.append(d)
            if w - last >= LEAST and w < b:
                ends.append(w)
                docs.append(d)
                last = w
        while b - last > MOST:
            last += MOST
            ends.append(last)
            docs.append(d)
        if b > last:
            ends.append(b)
            docs.append(d)
    return np.array(ends, np.int64), np.array(docs, np.int64)


def merkle(leaves: list[bytes]) -> bytes:
    """Root of a binary tree of blake2b-128; an odd node goes up as it is; no leaf: zeros."""
    if not leaves:
        return bytes(16)
    while len(leaves) > 1:
        leaves = [blake2b(b"\1" + leaves[i] + leaves[i + 1], digest_size=16).digest() if i + 1 < len(leaves) else leaves[i] for i in range(0, len(leaves), 2)]
    return leaves[0]


def recipe_root(doc_id: int | None, n_tokens: int, digests: list[bytes]) -> bytes:
    """Root of a document: its id, its length and the Merkle root of its chunks."""
    name = bytes(9) if doc_id is None else b"\1" + struct.pack("<q", doc_id)
    return blake2b(b"\2" + name + struct.pack("<q", n_tokens) + merkle(digests), digest_size=16).digest()


def _placed(at: int, documents: int, ids: int, root: bytes) -> bytes:
    """A leaf of the manifest's trees: a root with its place and what it stands for."""
    return blake2b(b"\3" + struct.pack("<qqq", at, documents, ids) + root, digest_size=16).digest()


def _levels(recipes: DataFrame, scratch: Scratch, least: int = 1) -> DataFrame:
    """The manifest of recipes (ordinal, start, n_tokens, root): one fold a level until one root is left.

    A task folds ranges of at most ``RANGE`` leaves; nothing meets on the driver.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            roots = [merkle([_placed(x["at"], x["documents"], x["ids"], x["root"]) for x in leaves]) for leaves in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(roots, pa.binary())], ["at", "documents", "ids", "root"])

    # a recipe stands for itself: its leaf has the ids before it
    level = recipes.select(F.col("ordinal").alias("at"), F.lit(1).cast("long").alias("documents"), F.col("n_tokens").alias("ids"), F.col("start").alias("before"), "root")
    rows = recipes.count()
    out, k = None, 0
    while rows and (k < least or rows > 1):
        k += 1
        stands = "ids" if k > 1 else "before"
        leaf = F.struct("at", "documents", F.col(stands).alias("ids"), "root")
        sums = level.groupBy(F.floor(F.col("at") / RANGE).alias("at")).agg(F.sum("documents").alias("documents"), F.sum("ids").alias("ids"), F.sort_array(F.collect_list(leaf)).alias("leaves"))
        level = scratch.save(sums.select("at", "documents", "ids", "leaves").mapInArrow(lean(fold), "at long, documents long, ids long, root binary"), f"level{k}")
        rows = -(-rows // RANGE)
        here = level.select(F.lit(k).alias("level"), "at", "documents", "ids", "root")
        out = here if out is None else out.unionByName(here)
    return out if out is not None else recipes.sparkSession.createDataFrame([], MANIFEST)


def _multiply(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product of reflected polynomials modulo that of CRC-32."""
    a, b = a.astype(np.uint32).copy(), b.astype(np.uint32).copy()
    p = np.zeros_like(a)
    for k in range(31, -1, -1):
        p ^= np.where((a >> np.uint32(k)) & np.uint32(1), b, np.uint32(0))
        b = np.where(b & np.uint32(1), (b >> np.uint32(1)) ^ np.uint32(0xEDB88320), b >> np.uint32(1))
    return p


def _shifts() -> np.ndarray:
    """x to the power 32 n modulo the polynomial, for n up to MOST."""
    out = np.empty(MOST + 1, np.uint32)
    one, x32 = np.array([0x80000000], np.uint32), None
    x32 = one.copy()
    for _ in range(32):
        x32 = np.where(x32 & np.uint32(1), (x32 >> np.uint32(1)) ^ np.uint32(0xEDB88320), x32 >> np.uint32(1))
    out[0] = one[0]
    for i in range(1, MOST + 1):
        out[i] = _multiply(out[i - 1 : i], x32)[0]
    return out


def crc_join(crcs: np.ndarray, lengths: np.ndarray, bounds: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """CRC-32 of joined chunks, from each chunk's CRC and its number of 32-bit ids."""
    out = np.zeros(len(bounds) - 1, np.uint32)
    count = np.diff(bounds)
    for k in range(int(count.max(initial=0))):
        live = np.flatnonzero(count > k)
        at = bounds[:-1][live] + k
        out[live] = _multiply(shifts[lengths[at]], out[live]) ^ crcs[at]
    return out


def write_store(docs: DataFrame, path: str, vocabulary: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", lead: bool = True, wide: bool = False) -> None:
    """Encode every whole text and write the store at ``path``.

    Null and empty texts hold the end id alone.  Rows with equal ids are documents of
    their own, in the order of their contents; a null id sorts first.  An empty table
    writes an empty store.  Other columns are not read.  Ids above 65535 need ``wide``;
    without it they are an error.
    """
    spark = docs.sparkSession
    ship(spark)
    kind = "<u4" if wide else "<u2"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, seen = Encoder.load(vocabulary, lead), set()
        schema = pa.schema([("recipe", pa.bool_()), ("digest", pa.binary()), ("id", pa.int64()), ("n", pa.int64()), ("payload", pa.binary()), ("root", pa.binary())])
        for batch in batches:
            ids_col = batch.column(0).to_pylist()
            for i, j, ids, bounds in encoder.batches(batch.column(1), end_id):
                ends, of = cuts(ids, bounds)
                starts = np.append(0, ends[:-1])
                if not wide and len(ids) and int(ids.max()) > 0xFFFF:
                    raise ValueError("ids above 65535: write and read this store with wide=True")
                raw, width = ids.astype(kind).tobytes(), np.dtype(kind).itemsize
                rows: list[tuple] = []
                lists: list[list[bytes]] = [[] for _ in range(j - i)]
                for s, e, d in zip(starts.tolist(), ends.tolist(), of.tolist()):
                    payload = raw[s * width : e * width]
                    digest = blake2b(payload, digest_size=16).digest()
                    lists[d].append(digest)
                    if digest not in seen:
                        seen.add(digest)
                        rows.append((False, digest, None, e - s, payload, None))
                for d, digests in enumerate(lists):
                    rows.append((True, None, ids_col[i + d], int(bounds[d + 1] - bounds[d]), b"".join(digests), recipe_root(ids_col[i + d], int(bounds[d + 1] - bounds[d]), digests)))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                if len(seen) > 2_000_000:  # a bound on memory: a chunk seen again is sent again
                    seen.clear()

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Equal digests meet in one task; the first is kept. Recipes pass."""
        seen: set[bytes] = set()
        for b in batches:
            keep = []
            for recipe, digest in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                keep.append(recipe or digest not in seen)
                if not recipe:
                    seen.add(digest)
            yield b.filter(pa.array(keep, pa.bool_()))

    out = "recipe boolean, digest binary, id long, n long, payload binary, root binary"
    pairs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    spread = F.coalesce("digest", F.col("root"))
    dealt = pairs.mapInArrow(lean(encode), out).repartition(partitions(spark), F.when(F.col("recipe"), F.xxhash64("id", spread)).otherwise(F.xxhash64("digest")))
    dealt.mapInArrow(lean(once), out).write.mode("overwrite").option("compression", "zstd").partitionBy("recipe").parquet(f"{path}/staged")
    staged = spark.read.schema(out).parquet(f"{path}/staged")
    scratch = Scratch(spark, "store")
    recipes = running(staged.where("recipe").select("id", F.col("n").alias("n_tokens"), F.col("payload").alias("digests"), "root", F.lit(1).cast("long").alias("one")), scratch, "recipes", ["id", "root"], {"start": "n_tokens", "ordinal": "one"})
    recipes.select("ordinal", F.col("id").alias("doc_id"), "start", "n_tokens", "digests", "root").write.mode("overwrite").parquet(f"{path}/recipes")
    written = spark.read.parquet(f"{path}/recipes").select("ordinal", "start", "n_tokens", "root")
    _levels(written, scratch).write.mode("overwrite").parquet(f"{path}/manifest")
    scratch.drop()


def _chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("recipe boolean, digest binary, id long, n long, payload binary, root binary").parquet(f"{path}/staged").where("not recipe").select("digest", "n", "payload")


def _recipes(spark: SparkSession, path: str) -> DataFrame:
    """Recipes with their root computed again and whether it is the stored one."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            roots = [recipe_root(i, n, [d[k : k + 16] for k in range(0, len(d), 16)]) for i, n, d in zip(*(b.column(k).to_pylist() for k in (1, 3, 4)))]
            good = [x == y for x, y in zip(roots, b.column(5).to_pylist())]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(4)), pa.array(roots, pa.binary()), pa.array(good, pa.bool_())], ["ordinal", "doc_id", "start", "n_tokens", "root", "sound"])

    rows = spark.read.parquet(f"{path}/recipes").select("ordinal", "doc_id", "start", "n_tokens", "digests", "root")
    return rows.mapInArrow(lean(check), "ordinal long, doc_id long, start long, n_tokens long, root binary, sound boolean")


def _sound_ranges(recipes: DataFrame, path: str, scratch: Scratch) -> DataFrame:
    """at, held for each range of recipes: whether its root and all above it are those of the manifest."""
    spark = recipes.sparkSession
    stated = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    top = stated.agg(F.max("level")).first()[0] or 1
    made = scratch.save(_levels(recipes, scratch, top), "made")
    top = max(top, made.agg(F.max("level")).first()[0] or 1)
    same = made.join(stated.withColumnRenamed("root", "stated").select("level", "at", "documents", "ids", "stated").distinct(), ["level", "at", "documents", "ids"], "left")
    same = scratch.save(same.select("level", "at", F.coalesce(F.col("root") == F.col("stated"), F.lit(False)).alias("held")), "same")
    # a range that only the manifest has, or has twice, is a range that was lost or put in
    whole = stated.join(made, ["level", "at"], "left_anti").isEmpty() and stated.count() == stated.select("level", "at").distinct().count()
    held = same.where(F.col("level") == top).select("at", (F.col("held") & F.lit(whole)).alias("held"))
    for k in range(top - 1, 0, -1):
        above = held.withColumnRenamed("at", "up").withColumnRenamed("held", "above")
        held = same.where(F.col("level") == k).join(above, F.floor(F.col("at") / RANGE) == F.col("up")).select("at", (F.col("held") & F.col("above")).alias("held"))
    return held


def read_crcs(spark: SparkSession, path: str, wide: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, verified, n_chunks for each document, from the files.

    Every stored chunk is read once, held against its digest and summed; a document's
    CRC is composed from those of its chunks in recipe order, so payloads do not move.
    ``verified``: its chunks are there and sound, they have as many ids as it says, its
    recipe gives its root, and its range of recipes gives the roots of the manifest.
    """
    ship(spark)
    scratch = Scratch(spark, "verify")
    kind = "<u4" if wide else "<u2"

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            payloads, digests = b.column(2).to_pylist(), b.column(0).to_pylist()
            crc = [zlib.crc32(np.frombuffer(p, kind).astype("<u4").tobytes()) for p in payloads]
            good = [blake2b(p, digest_size=16).digest() == d for p, d in zip(payloads, digests)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(crc, pa.int64()), pa.array(good, pa.bool_())], ["digest", "n", "crc", "good"])

    chunks = _chunks(spark, path).mapInArrow(lean(sums), "digest binary, n long, crc long, good boolean")
    recipes = spark.read.parquet(f"{path}/recipes")
    k = F.expr("case when length(digests) >= 16 then sequence(0, cast(length(digests) / 16 as int) - 1) end")
    parts = recipes.select("ordinal", F.explode(k).alias("k"), "digests").select("ordinal", "k", F.expr("substring(digests, k * 16 + 1, 16)").alias("digest"))
    lists = parts.join(chunks, "digest", "left").groupBy("ordinal").agg(F.sort_array(F.collect_list(F.struct("k", "n", "crc", F.coalesce("good", F.lit(False)).alias("good")))).alias("parts"))

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shifts = _shifts()
        for b in batches:
            parts = b.column(1)
            flat = parts.flatten()
            bounds = np.append(0, np.cumsum(parts.value_lengths().to_numpy(zero_copy_only=False))).astype(np.int64)
            n = flat.field("n").fill_null(0).to_numpy(zero_copy_only=False)
            crc = flat.field("crc").fill_null(0).to_numpy(zero_copy_only=False).astype(np.uint32)
            good = flat.field("good").to_numpy(zero_copy_only=False)
            total = np.add.reduceat(n, bounds[:-1]) if len(n) else np.zeros(0, np.int64)
            fine = np.logical_and.reduceat(good, bounds[:-1]) if len(n) else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(crc_join(crc, n, bounds, shifts).astype(np.int64)), pa.array(total.astype(np.int64)), pa.array(fine), pa.array(np.diff(bounds).astype(np.int64))], ["ordinal", "ids_crc32", "found", "fine", "n_chunks"])

    done = lists.mapInArrow(lean(compose), "ordinal long, ids_crc32 long, found long, fine boolean, n_chunks long")
    checked = scratch.save(_recipes(spark, path), "recipes")
    held = _sound_ranges(checked, path, scratch)
    out = checked.join(done, "ordinal", "left").join(held.withColumnRenamed("at", "range"), F.floor(F.col("ordinal") / RANGE) == F.col("range"), "left")
    sound = F.col("fine") & (F.col("found") == F.col("n_tokens")) & F.col("sound") & F.col("held")
    return out.select("doc_id", "start", "n_tokens", F.coalesce("ids_crc32", F.lit(0)).alias("ids_crc32"), F.coalesce(sound, F.lit(False)).alias("verified"), F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"))


def read_documents(spark: SparkSession, path: str, wide: bool = False) -> DataFrame:
    """doc_id and ids (array of int) of each document, rebuilt from recipes and chunks."""
    ship(spark)
    kind = "<u4" if wide else "<u2"
    recipes = spark.read.parquet(f"{path}/recipes")
    k = F.expr("case when length(digests) >= 16 then sequence(0, cast(length(digests) / 16 as int) - 1) end")
    parts = recipes.select("ordinal", F.explode(k).alias("k"), "digests").select("ordinal", "k", F.expr("substring(digests, k * 16 + 1, 16)").alias("digest"))
    lists = parts.join(_chunks(spark, path), "digest").groupBy("ordinal").agg(F.sort_array(F.collect_list(F.struct("k", "payload"))).alias("parts"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [np.frombuffer(b"".join(p["payload"] for p in x), kind).astype(np.int32) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], ["ordinal", "ids"])

    return recipes.select("ordinal", "doc_id").join(lists.mapInArrow(lean(join), "ordinal long, ids array<int>"), "ordinal").select("doc_id", "ids")
