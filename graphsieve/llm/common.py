"""What the operators share: scratch tables, word scanning over byte buffers, ranks.

Words are maximal runs of ``[^\\x20\\x09-\\x0D]``.  All scanners work on UTF-8 bytes
of a whole Arrow batch at a time, cut into slices of at most ``SLICE_BYTES``
(a longer text is a slice of its own), so memory follows the longest text and
not the batch.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage
from ..storage import Scratch, partitions, shared_dir

__all__ = ["Scratch", "Words", "buffers", "fresh", "lean", "mix", "partitions", "running", "shared_dir", "ship", "slices", "windows", "word_count"]

SLICE_BYTES = 2 << 20
BATCH_BYTES = 4 << 20
SPACE_CLASS = r"[\x20\x09-\x0D]+"



def ship(spark: SparkSession) -> None:
    """Send the package to the executors, and bound the bytes of a batch that a Python worker gets."""
    storage.ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def release() -> None:
    """Give freed memory back to the system: workers live on between tasks, beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def lean(f):
    """A function over batches that leaves no freed memory behind in its worker."""

    def run(batches):
        try:
            yield from f(batches)
        finally:
            release()

    return run


# ------------------------------------------------------------------ native expressions
def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text; null counts as none."""
    parts = F.split(F.coalesce(text, F.lit("")), SPACE_CLASS)
    edge = (F.element_at(parts, 1) == "").cast("int") + ((F.size(parts) > 1) & (F.element_at(parts, -1) == "")).cast("int")
    return (F.size(parts) - edge).cast("long")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    while name in df.columns:
        name = f"_{name}"
    return name


# ------------------------------------------------------------------ byte scanning
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LETTER = np.zeros(256, bool)
_LETTER[list(range(65, 91)) + list(range(97, 123))] = True
_MARK = np.zeros(256, bool)
_MARK[list(b".,;:!?%&$*#()")] = True
_rng = np.random.Generator(np.random.PCG64(20240521))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = 0x9E3779B97F4A7C15
_POWERS = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        with np.errstate(over="ignore"):
            out = np.full(max(n, 256), _STEP, np.uint64)
            out[0] = 1
            _POWERS = np.cumprod(out, dtype=np.uint64)
    return _POWERS


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words with full avalanche."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary array; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    column = column.cast(pa.large_binary())
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``most`` bytes, one row at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


class Words:
    """The words of consecutive texts: byte bounds, hash and text number of each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lead: bool = False, lower: bool = False, marks: bool = False):
        """lead: a word also takes the white space before it, and trailing white space is a word.

        lower: A-Z count as a-z in hashes. marks: a mark of ``_MARK`` right after A-Z or a-z begins a word.
        """
        base, end = int(offsets[0]), int(offsets[-1])
        self.data = data = data[base:end]
        self.offsets = offsets = offsets - base
        n = len(data)
        if n == 0:
            self.starts = self.ends = self.doc = np.zeros(0, np.int64)
            self.hash = np.zeros(0, np.uint64)
            return
        space = _SPACE[data]
        first = np.zeros(n, bool)
        first[offsets[:-1][offsets[:-1] < n]] = True
        if lead:
            begins = first.copy()
            begins[1:] |= space[1:] & ~space[:-1]
            if marks:
                begins[1:] |= _MARK[data[1:]] & _LETTER[data[:-1]]
            self.starts = np.flatnonzero(begins)
            self.ends = np.append(self.starts[1:], n)
        else:
            begins = ~space
            begins[1:] &= space[:-1] | first[1:]
            stops = ~space
            stops[:-1] &= space[1:] | first[1:]
            if marks:
                inner = _MARK[data[1:]] & _LETTER[data[:-1]]
                begins[1:] |= inner
                stops[:-1] |= inner
            self.starts = np.flatnonzero(begins)
            self.ends = np.flatnonzero(stops) + 1
        self.doc = np.searchsorted(offsets, self.starts, "right") - 1
        if not len(self.starts):
            self.hash = np.zeros(0, np.uint64)
            return
        if lower:
            upper = (data >= 65) & (data <= 90)
            data = np.where(upper, data + np.uint8(32), data)
        lengths = self.ends - self.starts
        longest = int(lengths.max())
        with np.errstate(over="ignore"):
            # bytes between words belong to nobody: they are zeroed and fall to the word before
            value = _BYTE[data]
            if not lead:
                value[space] = 0
            at = np.arange(self.starts[0], n, dtype=np.int64)
            spans = np.diff(np.append(self.starts, n))
            at -= np.repeat(self.starts, spans)
            np.minimum(at, longest - 1 if longest > 1 else 0, out=at)
            value = value[self.starts[0] :] * _powers(longest)[at]
            self.hash = mix(np.add.reduceat(value, self.starts - self.starts[0]) + lengths.astype(np.uint64))

    def counts(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=len(self.offsets) - 1)


def windows(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``width`` words within a text, and the index of its first word."""
    h, doc = words.hash, words.doc
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(doc[:n] == doc[width - 1 :])
    with np.errstate(over="ignore"):
        out = np.zeros(len(at), np.uint64)
        for j in range(width):
            out = out * np.uint64(0xD6E8FEB86659FD93) + h[at + j]
        return mix(out), at


# ------------------------------------------------------------------ ordered ranks
def running(df: DataFrame, scratch: Scratch, table: str, order: Sequence[str], sizes: dict[str, str], group: str | None = None) -> DataFrame:
    """Exclusive running sums in the given order, restarting at each value of ``group``.

    ``sizes`` maps new columns to the long columns they sum.  ``order`` must begin
    with ``group``.  Rows are dealt by range of the whole order, so that a frequent
    group spreads over tasks; each task sums its own rows and only the tasks' totals
    (as many as partitions and groups) meet on the driver.
    """
    spark = df.sparkSession
    names, sources = list(sizes), list(sizes.values())
    schema = df.schema
    columns = df.columns
    part, g = "_part", group
    out_schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in schema] + [f"{part} int"] + [f"`{x}` long" for x in names])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pid, last, carry = TaskContext.get().partitionId(), object(), [0] * len(names)
        for b in batches:
            if not b.num_rows:
                continue
            keys = np.zeros(b.num_rows, np.int64) if g is None else b.column(columns.index(g)).to_numpy(zero_copy_only=False)
            cut = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            new = []
            for k, s in enumerate(sources):
                v = b.column(columns.index(s)).to_numpy(zero_copy_only=False).astype(np.int64)
                total = np.cumsum(v)
                before = total - v
                base = before[cut].copy()
                if keys[0] == last:
                    base[0] -= carry[k]
                rel = before - np.repeat(base, np.diff(np.append(cut, len(keys))))
                carry[k] = int(rel[-1] + v[-1])
                new.append(pa.array(rel))
            last = keys[-1]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, pid, np.int32)), *new], [*columns, part, *names])

    n = partitions(spark)
    dealt = df.repartitionByRange(n, *[F.col(c) for c in order]).sortWithinPartitions(*order)
    saved = scratch.save(dealt.mapInArrow(lean(scan), out_schema), table)
    keys = [part] + ([g] if g else [])
    totals = saved.groupBy(*keys).agg(*[F.sum(s).alias(f"_t{i}") for i, s in enumerate(sources)]).toPandas()
    totals = totals.sort_values([g, part] if g else [part]).reset_index(drop=True)
    if not len(totals):
        return saved.drop(part)
    for i in range(len(names)):
        by = totals.groupby(g, sort=False)[f"_t{i}"] if g else totals[f"_t{i}"]
        totals[f"_b{i}"] = by.cumsum() - totals[f"_t{i}"]
    bases = spark.createDataFrame(totals[[*keys, *[f"_b{i}" for i in range(len(names))]]])
    out = saved.join(F.broadcast(bases), keys)  # rows: partitions plus groups
    return out.select(*columns, *[(F.col(x) + F.col(f"_b{i}")).cast("long").alias(x) for i, x in enumerate(names)])
