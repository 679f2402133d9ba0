"""Best-fit packing by patterns and non-negative least squares.

Lengths are counted; a pattern is a few lengths that fill a sequence exactly: the
whole length, every pair, and patterns drawn as the histogram has lengths, whose last
length fills what is left.  Repeat counts of patterns are fitted to the histogram by
non-negative least squares, rounded, and what remains is fitted again until ``SHARE``
of all pieces have a place; the rest is packed best fit, longest first, a run of equal
sequences at a time.  All of that works on at most ``capacity`` numbers on the driver,
whatever the number of documents.  A piece finds its sequence by its rank among the
pieces of its length.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, lean, running, ship
from .tokens import Encoder

CAPACITY = 2048
DRAWN, MOST = 6000, 16  # patterns drawn in a round, lengths in a pattern
FAR, SLACK = 0.05, 64  # a fit of full patterns that misses this share of the pieces is made again with pairs that leave up to a 64th free
ROUNDS, SHARE, LEAST = 12, 0.9, 0.02  # rounds end with this share of the pieces placed, or when one places less than the least
FRACTIONS = (0.8, 0.6, 0.4, 0.3, 0.2, 0.1, 0.05, 0.02)  # of repeat counts, at which rounding up may end
PIECES = "id long, piece int, start long, length long, ids_crc32 long"


def enumerate_patterns(histogram: np.ndarray, capacity: int, seed: int = 0, slack: int = 0) -> np.ndarray:
    """Patterns that fill a sequence exactly, one a row, longest length first, zeros after the last.

    The whole length, all pairs, and of ``DRAWN`` draws those that come out full: lengths
    follow one another by their frequency among those that fit, and one that comes near
    enough to filling the sequence is exchanged for the length that does (how near, each
    draw has its own measure).  No pattern holds more of a length than there is.
    """
    h = histogram[: capacity + 1].astype(np.int64)
    h[0] = 0
    total, here, present = np.cumsum(h), h > 0, np.flatnonzero(h)
    if not len(present):
        return np.zeros((0, MOST), np.int64)
    rng = np.random.Generator(np.random.PCG64(seed))
    drawn, room = np.zeros((DRAWN, MOST), np.int64), np.full(DRAWN, capacity)
    near = capacity / 2 ** (8 * rng.random(DRAWN))
    for k in range(MOST):
        at = np.flatnonzero((room > 0) & (total[room] > 0))
        r = room[at]
        d = np.minimum(np.searchsorted(total, np.floor(rng.random(len(at)) * total[r]), "right"), r)
        drawn[at, k] = np.where(here[r] & (r - d <= near[at]), r, d)
        room[at] -= drawn[at, k]
    known = [(capacity, 0)] if here[capacity] else []
    for free in (0, *(1 << k for k in range(slack.bit_length()))):
        long = present[2 * present >= capacity - free]
        long = long[(long < capacity - free) & here[np.maximum(capacity - free - long, 0)]]
        known += zip(long.tolist(), (capacity - free - long).tolist())
    pairs = np.zeros((len(known), MOST), np.int64)
    pairs[:, :2] = np.array(known, np.int64).reshape(-1, 2)
    out = np.unique(-np.sort(-np.concatenate([pairs, drawn[room == 0]]), axis=1), axis=0)
    enough = np.ones(len(out), bool)
    for k in range(MOST):
        enough &= (out[:, k] == 0) | ((out == out[:, k : k + 1]).sum(1) <= h[out[:, k]])
    return out[enough]


def fit(patterns: np.ndarray, histogram: np.ndarray, steps: int = 1500, near: float = 0.001) -> np.ndarray:
    """Repeat counts x >= 0 that minimise the squared distance of all patterns' lengths to the histogram.

    Accelerated projected gradients, restarted where they overshoot, until the distance
    is ``near`` of all pieces or after ``steps``.
    """
    goal = histogram.astype(float)
    goal[0] = 0
    flat, width = patterns.ravel(), patterns.shape[1]

    def lengths(x: np.ndarray) -> np.ndarray:
        made = np.bincount(flat, weights=np.repeat(x, width), minlength=len(goal))
        made[0] = 0
        return made

    def back(rest: np.ndarray) -> np.ndarray:
        return rest[patterns].sum(1)

    v = np.ones(len(patterns))
    for _ in range(30):  # the largest eigenvalue bounds the step
        v = back(lengths(v))
        largest = float(np.linalg.norm(v))
        v /= largest
    x = np.zeros(len(patterns))
    y, pace = x, 1.0
    for k in range(steps):
        rest = lengths(y) - goal
        if k % 50 == 0 and np.abs(lengths(x) - goal).sum() <= near * goal.sum():
            break
        new = np.maximum(0.0, y - back(rest) / (1.02 * largest))
        faster = (1 + math.sqrt(1 + 4 * pace * pace)) / 2
        if (new - x) @ (y - new) > 0:
            y, pace = new, 1.0
        else:
            y, pace = new + (pace - 1) / faster * (new - x), faster
        x = new
    return x


def distance(patterns: np.ndarray, x: np.ndarray, histogram: np.ndarray) -> float:
    """Pieces by which the patterns' lengths differ from the histogram."""
    made = np.bincount(patterns.ravel(), weights=np.repeat(x, patterns.shape[1]), minlength=len(histogram))
    return float(np.abs(made - histogram)[1:].sum())


def fitted(histogram: np.ndarray, capacity: int = CAPACITY) -> tuple[list[tuple[tuple[int, ...], int]], np.ndarray]:
    """Patterns with counts, rounded from the fit, and the histogram of what they leave.

    Full patterns are fitted; where they cannot come near the histogram (``FAR``), nearly
    full pairs are added.  Whole counts are taken first, then fractions are rounded up from the largest to the
    smallest while there are pieces.  How far that goes is decided by the result: of the
    ``FRACTIONS`` at which rounding may end, the one after which patterns and residual
    need the fewest sequences, the furthest if they tie.
    """
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    whole = int(left.sum())
    out: list[tuple[tuple[int, ...], int]] = []
    used, best = 0, (np.inf, 0, left)
    for attempt in range(ROUNDS):
        before = int(left.sum())
        if before <= (1 - SHARE) * whole:
            break
        for slack in (0, capacity // SLACK):
            patterns = enumerate_patterns(left, capacity, attempt, slack)
            x = fit(patterns, left) if len(patterns) else np.zeros(0)
            if distance(patterns, x, left) <= FAR * before:
                break
        if not len(patterns):
            break
        floor = np.floor(x + 1e-6)
        part = x - floor
        for least, most in zip((1.0, *FRACTIONS), (np.inf, 1.0, *FRACTIONS)):
            weight = x if least == 1.0 else part
            for i in np.flatnonzero((weight >= least) & (weight < most))[np.argsort(-weight[(weight >= least) & (weight < most)], kind="stable")].tolist():
                n = int(floor[i]) if least == 1.0 else 1
                p = tuple(v for v in patterns[i].tolist() if v)
                for v in set(p):
                    n = min(n, int(left[v]) // p.count(v)) if n else 0
                if n:
                    out.append((p, n))
                    used += n
                    for v in p:
                        left[v] -= n
            needed = used + sum(n for _, n in residual(left, capacity))
            if needed <= best[0]:
                best = (needed, len(out), left.copy())
        if before - int(left.sum()) < LEAST * whole:
            break
    return out[: best[1]], best[2]


def plan(histogram: np.ndarray, capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns with counts that hold each length exactly as often as the histogram has it."""
    out, left = fitted(histogram, capacity)
    return out + residual(left, capacity)


def residual(left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first: equal sequences are filled together, as many as the scarcest length allows."""
    left, out = left.copy(), []
    present = [int(v) for v in np.flatnonzero(left) if v]
    while present:
        a = present[-1]
        p, room, used = [a], capacity - a, {a: 1}
        i = len(present) - 1
        while room > 0:
            while i >= 0 and (present[i] > room or left[present[i]] <= used.get(present[i], 0)):
                i -= 1
            if i < 0:
                break
            v = present[i]
            p.append(v)
            used[v] = used.get(v, 0) + 1
            room -= v
        n = min(int(left[v]) // k for v, k in used.items())
        out.append((tuple(p), n))
        for v, k in used.items():
            left[v] -= n * k
            if left[v] == 0:
                present.remove(v)
    return out


class Places:
    """Where the r-th piece of a length goes: arrays that a task searches."""

    def __init__(self, patterns: list[tuple[tuple[int, ...], int]], capacity: int):
        self.rank: dict[int, list[int]] = {}
        self.first: dict[int, list[int]] = {}
        self.offset: dict[int, list[int]] = {}
        used: dict[int, int] = {}
        base = 0
        for p, n in patterns:
            at = 0
            for v in p:
                self.rank.setdefault(v, []).append(used.get(v, 0))
                self.first.setdefault(v, []).append(base)
                self.offset.setdefault(v, []).append(at)
                used[v] = used.get(v, 0) + n
                at += v
            base += n
        self.sequences = base

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        for v in np.unique(length):
            at = np.flatnonzero(length == v)
            r = np.array(self.rank[int(v)], np.int64)
            i = np.searchsorted(r, rank[at], "right") - 1
            sequence[at] = np.array(self.first[int(v)], np.int64)[i] + rank[at] - r[i]
            offset[at] = np.array(self.offset[int(v)], np.int64)[i]
        return sequence, offset


def pieces(docs: DataFrame, vocabulary: str, end_id: int, capacity: int, id_col: str, text_col: str, lead: bool = False) -> DataFrame:
    """Encode whole texts and cut those longer than ``capacity``; sums of the ids, not the ids."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.load(vocabulary, lead)
        for batch in batches:
            names = batch.column(0).to_pylist()
            for i, j, ids, bounds in encoder.batches(batch.column(1), end_id):
                raw, rows = ids.astype("<u4").tobytes(), []
                for d, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
                    for k, s in enumerate(range(a, b, capacity)):
                        e = min(s + capacity, b)
                        rows.append((names[i + d], k, s - a, e - s, zlib.crc32(raw[4 * s : 4 * e])))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(lean(cut), PIECES)


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int = 0, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", lead: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for each piece.

    A null or empty text is the end id alone.  Rows with equal ids are packed as rows
    of their own.  An empty table gives no pieces; other columns are not read.
    """
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "pack")
    made = scratch.save(pieces(docs, vocabulary, end_id, capacity, id_col, text_col, lead).withColumn("one", F.lit(1).cast("long")), "pieces")
    counts = np.zeros(capacity + 1, np.int64)
    for v, n in made.groupBy("length").count().collect():  # at most ``capacity`` rows
        counts[v] = n
    places = Places(plan(counts, capacity), capacity)
    ranked = running(made, scratch, "ranked", ["length", "id", "piece", "ids_crc32"], {"rank": "one"}, group="length")

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s, o = places.find(b.column(3).to_numpy(zero_copy_only=False), b.column(5).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(5)], pa.array(s), pa.array(o)], ["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    out = ranked.select("id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(lean(settle), PIECES + ", sequence_id long, offset long")
    return out.withColumnRenamed("id", id_col)
