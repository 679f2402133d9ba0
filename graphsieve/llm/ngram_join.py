"""Exact n-gram Jaccard join by T-occurrence search.

A document's set holds its distinct shingles of five words (lower-cased A-Z).  Equal
sets form a class; classes link when ``100 |x & y| >= 75 |x | y|``.

1. Every class sends its shingle hashes to tasks by hash range, packed, six bytes
   each.  A task sees the whole inverted list of each of its shingles and sends back
   those of two classes or more, with their lengths.
2. A class with fewer shared shingles than its own bound ``T = ceil(0.75 n)`` can have
   no partner and leaves.  The others keep their shared shingles, rare first.
3. Two linked classes share one of their first ``n - T + 1`` shingles in that order.
   Stars over those lists give cells; no link leaves a cell.
4. Within a cell, T-occurrence search: DivideSkip sets aside the longest lists of a
   query, merges the short ones, and probes the long ones by binary search for
   what the short ones leave possible.  Cells of many shingles are dealt out as pairs
   of blocks.  A task returns spanning links and link counts, not pairs.

Every count covers all documents; nothing is capped or sampled.  Hash collisions: a
shingle is 48 bits within its range, a class 64 bits, checked against a second 64.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, Words, buffers, fresh, lean, mix, partitions, ship, slices, windows
from .components import components, find_roots

WIDTH = 5
FLUSH = 2_000_000  # shingles that a task holds before it sends them
BLOCK = 1_500_000  # shingles of a cell that one block may hold
MEMBERS = 192  # classes of a cell that one block may hold
LOW = np.uint64((1 << 48) - 1)
_ROWS = "kind int, part int, id long, n long, k1 long, k2 long, keys binary, counts binary, body binary, extra binary"
_SCHEMA = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("id", pa.int64()), ("n", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary()), ("body", pa.binary()), ("extra", pa.binary())])
DOC, CLASS, LIST = 0, 1, 2


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of consecutive texts and where each text's begin; sorted within a text."""
    words = Words(data, offsets, lower=True)
    n = len(offsets) - 1
    h, at = windows(words, width)
    doc = words.doc[at]
    counts = words.counts()
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        first = np.searchsorted(words.doc, short)
        with np.errstate(over="ignore"):
            s = np.full(len(short), 0x51ED270B9F3C1D17, np.uint64)
            for j in range(width - 1):
                live = counts[short] > j
                s[live] = mix(s[live] * np.uint64(0xD6E8FEB86659FD93) + words.hash[first[live] + j])
            s = mix(s + counts[short].astype(np.uint64))
        h, doc = np.concatenate([h, s]), np.concatenate([doc, short])
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    if len(h):
        keep = np.append(True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]))
        h, doc = h[keep], doc[keep]
    return h, np.searchsorted(doc, np.arange(n + 1))


def _six(tokens: np.ndarray) -> bytes:
    return np.ascontiguousarray(tokens.astype("<u8").view("<u2").reshape(-1, 4)[:, :3]).tobytes()


def _eight(raw: bytes) -> np.ndarray:
    part = np.frombuffer(raw, "<u2").reshape(-1, 3)
    out = np.zeros((len(part), 4), "<u2")
    out[:, :3] = part
    return out.reshape(-1).view("<u8")


def _packed(bucket: np.ndarray, owner: np.ndarray, keys: np.ndarray, *columns: np.ndarray) -> Iterator[tuple]:
    """For each bucket: owners' keys, how many rows each has, and the columns' rows; owner must not decrease."""
    order = np.argsort(bucket, kind="stable")
    bucket, owner = bucket[order], owner[order]
    columns = tuple(c[order] for c in columns)
    edge = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, int)
    for s, e in zip(edge.tolist(), np.append(edge[1:], len(bucket)).tolist() if len(edge) else []):
        o = owner[s:e]
        cut = np.flatnonzero(np.append(True, o[1:] != o[:-1]))
        yield int(bucket[s]), keys[o[cut]], np.diff(np.append(cut, e - s)).astype("<u4"), *(c[s:e] for c in columns)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _SCHEMA)], schema=_SCHEMA)


def _sender(parts: int, width: int, salt: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        volume = 0

        def flush() -> Iterator[pa.RecordBatch]:
            tokens = np.concatenate([h[0] for h in held])
            counts = np.concatenate([h[1] for h in held])
            keys = np.concatenate([h[2] for h in held])
            owner = np.repeat(np.arange(len(keys)), counts)
            bucket = (((tokens >> np.uint64(48)) * np.uint64(parts)) >> np.uint64(16)).astype(np.uint16)
            for b, k, c, t in _packed(bucket, owner, keys, tokens):
                yield _batch([(LIST, b, None, None, None, None, k.astype("<u8").tobytes(), c.tobytes(), _six(t & LOW), None)])
            cb = (((keys >> np.uint64(40)) * np.uint64(parts)) >> np.uint64(24)).astype(np.uint16)
            yield from (_batch([(CLASS, b, None, None, None, None, k.astype("<u8").tobytes(), n.astype("<u4").tobytes(), None, None)]) for b, k, _, n in _packed(cb, np.arange(len(keys)), keys, counts))

        for batch in batches:
            ids = batch.column(0).to_pylist()
            data, offsets = buffers(batch.column(1))
            for i, j in slices(offsets):
                h, at = shingle_sets(data, offsets[i : j + 1], width)
                n = np.diff(at)
                full = np.flatnonzero(n)
                k1, k2 = np.zeros(j - i, np.uint64), np.zeros(j - i, np.uint64)
                if len(full):
                    with np.errstate(over="ignore"):
                        k1[full] = mix(np.add.reduceat(mix(h + np.uint64(salt)), at[full]) + n[full].astype(np.uint64))
                        k2[full] = mix(np.add.reduceat(mix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)), at[full]) ^ n[full].astype(np.uint64))
                place = ((mix(k2 + np.arange(i, j).astype(np.uint64)) >> np.uint64(48)) * np.uint64(parts)) >> np.uint64(16)
                yield _batch([(DOC, int(p), x, int(m), a, b, None, None, None, None) for p, x, m, a, b in zip(place, ids[i:j], n, k1.view(np.int64).tolist(), k2.view(np.int64).tolist())])
                fresh = []
                for d in full.tolist():
                    key = int(k1[d])
                    if key not in seen:
                        seen.add(key)
                        fresh.append(d)
                if fresh:
                    f = np.array(fresh)
                    take = np.repeat(at[f], n[f]) + np.arange(int(n[f].sum())) - np.repeat(np.cumsum(n[f]) - n[f], n[f])
                    held.append((h[take], n[f], k1[f]))
                    volume += len(take)
                if volume >= FLUSH:
                    yield from flush()
                    held, volume = [], 0
        if held:
            yield from flush()

    return send


def _lists(batches: Iterator[pa.RecordBatch]) -> tuple[list[pa.RecordBatch], dict[int, list[tuple]]]:
    """Rows that pass, and per part the packed rows of kind LIST."""
    rest, found = [], {}
    for b in batches:
        kind = b.column(0).to_numpy(zero_copy_only=False)
        if (kind != LIST).any():
            rest.append(b.filter(pa.array(kind != LIST)))
        for r in np.flatnonzero(kind == LIST).tolist():
            found.setdefault(b.column(1)[r].as_py(), []).append(tuple(b.column(c)[r].as_py() for c in (6, 7, 8, 9)))
    return rest, found


def _unpack(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class keys (each once), owner index and token of each row; equal (owner, token) rows once."""
    raw = np.concatenate([np.frombuffer(k, "<u8") for k, _, _, _ in rows])
    counts = np.concatenate([np.frombuffer(c, "<u4") for _, c, _, _ in rows]).astype(np.int64)
    tokens = np.concatenate([_eight(t) for _, _, t, _ in rows])
    keys, which = np.unique(raw, return_inverse=True)
    return keys, np.repeat(which, counts), tokens


def _lister(parts: int):
    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, found = _lists(batches)
        yield from rest
        for part, rows in found.items():
            keys, owner, token = _unpack(rows)
            order = np.lexsort((owner, token))
            owner, token = owner[order], token[order]
            again = np.append(False, (token[1:] == token[:-1]) & (owner[1:] == owner[:-1]))
            owner, token = owner[~again], token[~again]
            start = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
            df = np.diff(np.append(start, len(token)))
            keep = np.repeat(df >= 2, df)
            owner, token, df = owner[keep], token[keep] | (np.uint64(part) << np.uint64(48)), np.repeat(df, df)[keep]
            order = np.argsort(owner, kind="stable")
            owner, token, df = owner[order], token[order], df[order]
            cb = (((keys >> np.uint64(40)) * np.uint64(parts)) >> np.uint64(24)).astype(np.uint16)
            for b, k, c, t, d in _packed(cb[owner], owner, keys, token, df):
                yield _batch([(LIST, b, None, None, None, None, k.astype("<u8").tobytes(), c.tobytes(), t.astype("<u8").tobytes(), d.astype("<u4").tobytes())])

    return shared


def _gather(percent: int):
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per class with enough shared shingles: a number, its size, its shingles rare first, and the prefix length."""
        from pyspark import TaskContext

        size: dict[int, int] = {}
        lists: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        for b in batches:
            for kind, k, c, t, d in zip(*(b.column(i).to_pylist() for i in range(5))):
                keys = np.frombuffer(k, "<u8")
                if kind == CLASS:
                    size.update(zip(keys.tolist(), np.frombuffer(c, "<u4").tolist()))
                else:
                    lists.append((np.repeat(keys, np.frombuffer(c, "<u4")), np.frombuffer(t, "<u8"), np.frombuffer(d, "<u4")))
        if not lists:
            return
        owner, token, df = (np.concatenate([x[i] for x in lists]) for i in range(3))
        order = np.lexsort((token, df, owner))
        owner, token = owner[order], token[order]
        start = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        number, rows = TaskContext.get().partitionId() << 40, []
        for s, e in zip(start.tolist(), np.append(start[1:], len(owner)).tolist()):
            key = int(owner[s])
            n, m = size[key], e - s
            need = -(-percent * n // 100)
            if m < need:
                continue
            rows.append((number, key - (1 << 64) if key >> 63 else key, n, m - need + 1, token[s:e].tobytes()))
            number += 1
        for i in range(0, len(rows), 512):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 512]), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["sid", "k1", "n", "prefix", "tokens"])

    return gather


def _prefix_sender(parts: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sid = b.column(0).to_numpy(zero_copy_only=False).astype(np.uint64)
            heads = [np.frombuffer(t, "<u8")[:p] for p, t in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            if not heads:
                continue
            tokens = np.concatenate(heads)
            owner = np.repeat(np.arange(len(heads)), [len(h) for h in heads])
            spread = mix(tokens)
            bucket = (((spread >> np.uint64(48)) * np.uint64(parts)) >> np.uint64(16)).astype(np.uint16)
            for p, k, c, t in _packed(bucket, owner, sid, tokens):
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([k.astype("<u8").tobytes()]), pa.array([c.tobytes()]), pa.array([t.tobytes()])], ["part", "keys", "counts", "body"])

    return send


def _star(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges from the first class of each prefix list to its others, folded into a forest."""
    owners, tokens = [], []
    for b in batches:
        for k, c, t in zip(*(b.column(i).to_pylist() for i in (1, 2, 3))):
            owners.append(np.repeat(np.frombuffer(k, "<u8"), np.frombuffer(c, "<u4")))
            tokens.append(np.frombuffer(t, "<u8"))
    if not owners:
        return
    owner, token = np.concatenate(owners).astype(np.int64), np.concatenate(tokens)
    order = np.lexsort((owner, token))
    owner, token = owner[order], token[order]
    start = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
    hub = np.repeat(owner[start], np.diff(np.append(start, len(token))))
    far = owner != hub
    if far.any():
        nodes, root = find_roots(owner[far], hub[far])
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(root)], ["a", "b"])


def t_occurrence(sets: list[np.ndarray], n: np.ndarray, side: np.ndarray, weight: np.ndarray, percent: int = 75, mu: float = 0.0085) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links (x, y) of all pairs that reach the overlap, and each set's weighted number of links.

    Pairs of the same nonzero-sum side are left out: side is 0 where all pairs count,
    else 1 or 2 and only pairs across count.  Shingles that only one set has may be
    missing from ``sets``; ``n`` counts them.
    """
    order = np.argsort(n, kind="stable")
    sets, n, side = [sets[i] for i in order], n[order], side[order]
    lengths = np.array([len(s) for s in sets])
    _, token = np.unique(np.concatenate(sets), return_inverse=True)
    doc = np.repeat(np.arange(len(sets)), lengths)
    bounds = np.append(0, np.cumsum(lengths))
    by = np.argsort(token, kind="stable")  # lists, each by ascending size of set
    postings = doc[by]
    sizes = np.bincount(token)
    head = np.append(0, np.cumsum(sizes))
    lo = np.searchsorted(n, np.ceil(n * percent / 100).astype(np.int64), "left")
    xs, ys = [], []
    for x in range(len(sets)):
        if lo[x] >= x:
            continue
        own = token[bounds[x] : bounds[x + 1]]
        need = -(-percent * int(n[x]) // 100)  # no smaller partner needs less
        if len(own) < need:
            continue
        size = sizes[own]
        longest = int(size.max())
        aside = min(need - 1, int(need / (mu * math.log2(max(2, longest)) * need + 1)) if longest > 8 else 0, len(own) - 1)
        if aside > 0:
            rank = np.argpartition(size, len(own) - aside)
            short, long = own[rank[: len(own) - aside]], own[rank[len(own) - aside :]]
        else:
            short, long = own, own[:0]
        k = sizes[short]
        at = np.repeat(head[short] - (np.cumsum(k) - k), k) + np.arange(int(k.sum()))
        merged = postings[at]
        merged = merged[(merged >= lo[x]) & (merged < x)]
        if not len(merged):
            continue
        count = np.bincount(merged - lo[x], minlength=x - lo[x])
        hit = np.flatnonzero(count >= need - len(long))
        overlap, hit = count[hit], hit + lo[x]
        if side[x]:
            over = side[hit] != side[x]
            hit, overlap = hit[over], overlap[over]
        for t in long.tolist():
            if not len(hit):
                break
            inverted = postings[head[t] : head[t + 1]]
            i = np.searchsorted(inverted, hit)
            overlap = overlap + (inverted[np.minimum(i, len(inverted) - 1)] == hit)
        good = (100 + percent) * overlap >= percent * (n[x] + n[hit])
        if good.any():
            ys.append(order[hit[good]])
            xs.append(np.full(int(good.sum()), order[x]))
    a = np.concatenate(xs) if xs else np.zeros(0, np.int64)
    b = np.concatenate(ys) if ys else np.zeros(0, np.int64)
    links = np.bincount(a, weights=weight[b], minlength=len(n)) + np.bincount(b, weights=weight[a], minlength=len(n))
    return a, b, links.astype(np.int64)


def _searcher(percent: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def finish(rows: list[tuple]) -> pa.RecordBatch | None:
            if len(rows) < 2:
                return None
            sid = np.array([r[3] for r in rows])
            sets = [np.frombuffer(r[7], "<u8") for r in rows]
            x, y, links = t_occurrence(sets, np.array([r[4] for r in rows]), np.array([r[6] for r in rows]), np.array([r[5] for r in rows]), percent)
            if not len(x):
                return None
            nodes, root = find_roots(sid[x], sid[y])
            count = dict(zip(sid.tolist(), links.tolist()))
            return pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(root), pa.array([count[s] for s in nodes.tolist()], pa.int64())], ["a", "b", "links"])

        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(8))):
                if held and row[:3] != held[0][:3]:
                    if (out := finish(held)) is not None:
                        yield out
                    held = []
                held.append(row)
        if (out := finish(held)) is not None:
            yield out

    return search


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = 75, block: int = BLOCK, salt: int = 1) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links, class_size for each row.

    n_links counts the rows that the row links with, equal sets included.  Null and
    empty texts have no shingles, no links, and are their own component.  A text of
    fewer words is one shingle.  Rows with equal ids are rows of their own; a
    component's id is its smallest id.  An empty table gives none.  Other columns are
    not read.
    """
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "ngrams")
    parts = min(partitions(spark), 60_000)
    pairs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sent = pairs.mapInArrow(lean(_sender(parts, width, salt)), _ROWS).repartitionById(parts, F.col("part"))
    staged = scratch.save(sent.mapInArrow(lean(_lister(parts)), _ROWS), "staged", "kind")
    scratch.settle()
    rows = staged.where(F.col("kind") == DOC).select("id", "n", "k1", "k2")
    classes = scratch.save(rows.where("n > 0").groupBy("k1").agg(F.count("*").alias("w"), F.min("id").alias("rep"), F.min("k2").alias("lo"), F.max("k2").alias("hi")), "classes")
    if not classes.where("lo != hi").isEmpty():
        return jaccard_components(docs, id_col, text_col, width, percent, block, salt + 1)
    lists = staged.where(F.col("kind") != DOC).select("part", "kind", "keys", "counts", "body", "extra").repartitionById(parts, F.col("part")).select("kind", "keys", "counts", "body", "extra")
    sets = scratch.save(lists.mapInArrow(lean(_gather(percent)), "sid long, k1 long, n long, prefix long, tokens binary"), "sets")
    heads = sets.select("sid", "prefix", "tokens").mapInArrow(lean(_prefix_sender(parts)), "part int, keys binary, counts binary, body binary").repartitionById(parts, F.col("part"))
    cells = components(heads.mapInArrow(lean(_star), "a long, b long"), scratch, "cells").withColumnsRenamed({"node": "sid", "label": "cell"})
    volume = sets.select("sid", "k1", "n", (F.octet_length("tokens") / 8).cast("long").alias("m")).join(cells, "sid")
    total = volume.groupBy("cell").agg(F.greatest(F.lit(1), F.ceil(F.sum("m") / block), F.ceil(F.count("*") / MEMBERS)).cast("int").alias("blocks"))
    about = volume.join(total, "cell").join(classes.select("k1", "w"), "k1").select("sid", "cell", "blocks", "w", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int").alias("own"))
    dealt = sets.select("sid", "n", "tokens").join(about, "sid").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("own") == F.col("other"), 0).otherwise(F.when(F.col("own") < F.col("other"), 1).otherwise(2))
    i, j = F.least("own", "other"), F.greatest("own", "other")
    # the block pairs of a cell go to tasks in turn, from a place that its hash gives
    place = F.pmod(F.pmod(F.xxhash64("cell"), F.lit(parts)) + i.cast("long") * F.col("blocks") + j, F.lit(parts)).cast("int")
    grouped = dealt.select("cell", i.alias("i"), j.alias("j"), "sid", "n", "w", side.cast("int").alias("side"), "tokens", place.alias("place"))
    grouped = grouped.repartitionById(parts, F.col("place")).drop("place").sortWithinPartitions("cell", "i", "j", "sid")
    found = scratch.save(grouped.mapInArrow(lean(_searcher(percent)), "a long, b long, links long"), "links")
    label = components(found.select("a", "b").where("a != b"), scratch, "linked").withColumnsRenamed({"node": "sid"})
    count = found.groupBy(F.col("a").alias("sid")).agg(F.sum("links").alias("links"))
    named = sets.select("sid", "k1").join(label, "sid").join(count, "sid", "left").join(classes.select("k1", "rep"), "k1")
    low = named.groupBy("label").agg(F.min("rep").alias("component"))
    linked = scratch.save(named.join(low, "label").select("k1", "component", "links"), "named")
    final = scratch.save(classes.join(linked, "k1", "left").select("k1", "w", F.coalesce("component", "rep").alias("component"), F.coalesce("links", F.lit(0)).alias("links")), "final")
    out = rows.where("n > 0").join(final, "k1").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), (F.col("links") + F.col("w") - 1).alias("n_links"), F.col("w").alias("class_size"))
    none = rows.where("n = 0").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("id").alias("component_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("class_size"))
    return out.unionByName(none)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One document of each component, that of the smallest id; columns as in ``docs``.

    Documents without words stay.  Rows are told apart by id and text, so rows with equal
    or null ids are documents of their own: ids tie by the hash of id and text, null ids
    come last.  Of rows with equal id and text one stays, by the hash of all its columns.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "kept")
    key, mine = fresh(docs, "_key"), F.xxhash64(F.col(id_col), F.col(text_col))
    keyed = docs.withColumn(key, mine)
    found = jaccard_components(keyed, key, text_col, **options).where("n_shingles > 0").select(F.col(key).alias("key"), F.col("component_id").alias("component"))
    found = scratch.save(found.groupBy("key", "component").agg(F.count("*").alias("rows")), "found")
    ids = keyed.select(F.col(key).alias("key"), F.col(id_col).alias("id")).distinct()
    named = scratch.save(found.join(ids, "key"), "named")
    # written, so that a large component's rows may be split where they meet it
    first = scratch.save(named.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key"))["key"].alias("first")), "first")
    gone = named.join(first, "component").where("key != first").select(F.col("key").alias("__gs_key"), F.col("id").alias("__gs_id"))
    kept = keyed.join(gone, (F.col(key) == F.col("__gs_key")) & F.col(id_col).eqNullSafe(F.col("__gs_id")), "left_anti")
    twice = scratch.save(named.where("rows > 1").select(F.col("key").alias("__gs_twice")).distinct(), "twice")
    if twice.isEmpty():
        return kept.drop(key)
    marked = kept.join(twice, F.col(key) == F.col("__gs_twice"), "left")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    whole = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])
    several = marked.where(F.col("__gs_twice").isNotNull()).groupBy(key, id_col).agg(F.min_by(row, whole).alias("__gs_row")).select("__gs_row.*")
    return marked.where(F.col("__gs_twice").isNull()).select(*[F.col(f"`{c}`") for c in docs.columns]).unionByName(several)
