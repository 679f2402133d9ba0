"""Quality rules with risk-controlled thresholds.

Base rules have fixed limits.  The method's own rules compare a score of the text
with a cutoff that labelled documents justify: for each stratum (language) and rule,
a cutoff is admissible if the upper confidence bound on its false rejections, exact
by the binomial law (Clopper-Pearson), stays within the rule's share of the allowed
risk.  Multiple testing: the level is divided by strata x rules (Bonferroni), and the
cutoffs of one rule are tested from lenient to strict, stopping at the first that
fails (fixed sequence), so with probability 1 - delta no stratum rejects more than
``risk`` of its good documents.  Among admissible cutoffs the one with the largest
gain (bad ones rejected minus ``price`` times good ones) is taken, the most lenient
if they tie; where fewer than ``least_bad`` bad ones (10) go, the rule does not act in that
stratum, at any size of the data: a cutoff that a few examples carry is chance.

Counts over all labelled documents go into a table of strata x rules x cutoffs, whose
size does not follow the data.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, Words, buffers, fresh, lean, ship, slices, windows

RULES = ("symbol_ratio", "upper_ratio", "repeat_line_ratio")
#: Cutoffs from strict to lenient; a score at or above the cutoff rejects.
GRID = tuple(round(0.02 * 1.122**k, 6) for k in range(34))
COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, " + ", ".join(f"{r} double" for r in RULES)


def measure(column: pa.Array) -> list[pa.Array]:
    """The base counts and rule scores of each text of a batch."""
    data, offsets = buffers(column)
    out: list[list[np.ndarray]] = [[] for _ in range(5 + len(RULES))]
    for i, j in slices(offsets):
        part = offsets[i : j + 1]
        n = j - i
        words = Words(data, part)
        raw, off = words.data, words.offsets
        n_words = words.counts()

        def per_doc(mask: np.ndarray, off: np.ndarray = off) -> np.ndarray:
            total = np.append(0, np.cumsum(mask, dtype=np.int64))
            return total[off[1:]] - total[off[:-1]]

        points = (raw & 0xC0) != 0x80
        blank = np.isin(raw, np.frombuffer(b" \t\n\v\f\r", np.uint8))
        word_chars = per_doc(points & ~blank)
        n_symbols = per_doc(np.isin(raw, np.frombuffer(b"#*$%&|<>", np.uint8)))
        upper, lower = per_doc((raw >= 65) & (raw <= 90)), per_doc((raw >= 97) & (raw <= 122))
        # words in 8-word windows that occur twice or more in the text
        h, at = windows(words, 8)
        doc = words.doc[at]
        repeat = np.zeros(n, np.int64)
        if len(h):
            order = np.lexsort((h, doc))
            same = (h[order][1:] == h[order][:-1]) & (doc[order][1:] == doc[order][:-1])
            many = np.append(same, False) | np.append(False, same)
            edge = np.zeros(len(words.starts) + 1, np.int64)
            hits = at[order][many]
            np.add.at(edge, hits, 1)
            np.add.at(edge, hits + 8, -1)
            covered = np.cumsum(edge[:-1]) > 0
            repeat = np.bincount(words.doc[covered], minlength=n)
        dup, ratio = _lines(raw, off, words)
        scores = (n_symbols / np.maximum(word_chars, 1), upper / np.maximum(upper + lower, 1), ratio)
        for k, v in enumerate((n_words, word_chars, n_symbols, dup, repeat, *scores)):
            out[k].append(v.astype(np.int64) if k < 5 else np.asarray(v, float))
    empty = np.zeros(0)
    return [pa.array(np.concatenate(v) if v else empty.astype(np.int64 if k < 5 else float)) for k, v in enumerate(out)]


def _lines(raw: np.ndarray, off: np.ndarray, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Per text: lines with a word that equal an earlier one, and their share."""
    n = len(off) - 1
    dup, ratio = np.zeros(n, np.int64), np.zeros(n)
    if not len(raw):
        return dup, ratio
    begins = np.zeros(len(raw), bool)
    begins[1:] = raw[:-1] == 10
    begins[off[:-1][off[:-1] < len(raw)]] = True
    starts = np.flatnonzero(begins)
    doc = np.searchsorted(off, starts, "right") - 1
    ends = np.append(starts[1:], len(raw))
    ends = ends - ((ends > starts) & (raw[ends - 1] == 10))  # without the line feed
    per_line = np.bincount(np.searchsorted(starts, words.starts, "right") - 1, minlength=len(starts)) if len(words.starts) else np.zeros(len(starts), np.int64)
    text, seen, last = raw.tobytes(), set(), -1
    for k in np.flatnonzero(per_line).tolist():
        d = int(doc[k])
        if d != last:
            seen, last = set(), d
        line = text[starts[k] : ends[k]]
        if line in seen:
            dup[d] += 1
        else:
            seen.add(line)
    lines = np.bincount(doc[per_line > 0], minlength=n)
    return dup, dup / np.maximum(lines, 1)


def with_measures(docs: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """The columns of ``keep`` and the measures of the text."""
    ship(docs.sparkSession)
    base = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text_col).alias(fresh(docs, "_text")))
    names = [f.strip().split()[0] for f in COLUMNS.split(",")]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields[:-1]] + [COLUMNS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *measure(b.column(b.num_columns - 1))], [*b.schema.names[:-1], *names])

    return base.mapInArrow(lean(run), schema)


def base_failed(words: str = "n_words", repeats: str = "n_repeat_words"):
    return (F.col(words) < 20) | (100 * F.col(repeats) > 30 * F.col(words))


# ------------------------------------------------------------------ exact bounds
def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(X <= k) for X binomial(n, p)."""
    if k >= n or p <= 0:
        return 1.0
    if p >= 1:
        return 0.0
    lp, lq, total = math.log(p), math.log1p(-p), 0.0
    base = math.lgamma(n + 1)
    for i in range(k, -1, -1):
        term = math.exp(base - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * lp + (n - i) * lq)
        total += term
        if term < total * 1e-17 and i < n * p:
            break
    return min(1.0, total)


def upper_bound(k: int, n: int, level: float) -> float:
    """Clopper-Pearson: the largest rate under which k or fewer of n still have probability ``level``."""
    if n == 0 or k >= n:
        return 1.0
    lo, hi = k / n, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        if binomial_cdf(k, n, mid) > level:
            lo = mid
        else:
            hi = mid
    return hi


def calibrate(counts: dict[tuple[str, str], dict[str, np.ndarray]], totals: dict[str, tuple[int, int]], risk: float, delta: float, price: float, least_bad: int = 10) -> dict[tuple[str, str], float]:
    """Cutoffs by (stratum, rule). counts: good and bad ones at or above each cutoff; totals: good and bad by stratum."""
    tested = max(1, len(totals) * len(RULES))
    out = {}
    for (stratum, rule), c in counts.items():
        n = totals[stratum][0]
        best, gain = None, 0.0
        for k in range(len(GRID) - 1, -1, -1):  # lenient first
            if upper_bound(int(c["good"][k]), n, delta / tested) > risk / len(RULES):
                break
            g = float(c["bad"][k]) - price * float(c["good"][k])
            if g > gain and c["bad"][k] >= least_bad:
                best, gain = k, g
        if best is not None:
            out[(stratum, rule)] = GRID[best]
    return out


def thresholds(measured: DataFrame, labels: DataFrame, id_col: str, stratum_col: str, quality_col: str = "quality", risk: float = 0.05, delta: float = 0.05, price: float = 10.0, least_bad: int = 10) -> dict[tuple[str, str], float]:
    """Cutoffs from all labelled documents that pass the base rules. A null stratum is one of its own; null labels don't count.

    Of several labels of one id the smallest counts; a label without a document does nothing.
    """
    marks = labels.where(F.col(quality_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.min(quality_col).alias("_good"))
    rows = measured.where(~base_failed()).join(marks, F.col(id_col) == F.col("_id"))
    stratum = F.coalesce(F.col(stratum_col).cast("string"), F.lit("\0null")).alias("stratum")
    sums = []
    for r in RULES:
        for mark, name in ((1, "good"), (0, "bad")):
            # one bin for each cutoff: the number of cutoffs at or below the score
            sums += [F.sum(((F.col("_good") == mark) & (F.col(r) >= g)).cast("long")).alias(f"{r}.{name}.{k}") for k, g in enumerate(GRID)]
    table = rows.groupBy(stratum).agg(F.sum((F.col("_good") == 1).cast("long")).alias("n1"), F.sum((F.col("_good") == 0).cast("long")).alias("n0"), *sums).collect()  # one row a stratum
    counts, totals = {}, {}
    for row in table:
        s = row["stratum"]
        totals[s] = (row["n1"], row["n0"])
        for r in RULES:
            counts[(s, r)] = {name: np.array([row[f"{r}.{name}.{k}"] for k in range(len(GRID))]) for name in ("good", "bad")}
    return calibrate(counts, totals, risk, delta, price, least_bad)


def verdict(cutoffs: dict[tuple[str, str], float], stratum_col: str):
    """True where no rule of the document's stratum rejects."""
    stratum = F.coalesce(F.col(stratum_col).cast("string"), F.lit("\0null"))
    bad = F.lit(False)
    for (s, r), cut in sorted(cutoffs.items()):
        bad = bad | ((stratum == s) & (F.col(r) >= cut))
    return ~bad


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", **options) -> DataFrame:
    """Measures, base_failed and kept for each row of ``docs``; ``labels`` has id and quality (1 good, 0 bad).

    Null and empty texts have no words and fail the base rules.  Repeated ids are judged
    row by row.  Empty documents give no rows; without labels only the base rules act.
    Columns of ``docs`` other than the three named are ignored.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    measured = scratch.save(with_measures(docs, text_col, [id_col, stratum_col]), "measured")
    cutoffs = thresholds(measured, labels, id_col, stratum_col, **options)
    return measured.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(cutoffs, stratum_col))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", **options) -> DataFrame:
    """The documents that judge() keeps, with all columns of ``docs``.

    Each text is measured once: documents are written with their measures, the labelled
    ones give the cutoffs, and the verdict filters what was written.  Texts are not
    shuffled.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    ship(docs.sparkSession)
    names = [f.strip().split()[0] for f in COLUMNS.split(",")]
    renamed = {n: fresh(docs, f"_m_{n}") for n in names}
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema] + [f"{renamed[x.split()[0]]} {x.split()[1]}" for x in COLUMNS.split(", ")])
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, *measure(b.column(at))], [*b.schema.names, *renamed.values()])

    measured = scratch.save(docs.mapInArrow(lean(run), schema), "measured")
    plain = measured.select(id_col, stratum_col, *[F.col(renamed[n]).alias(n) for n in names])
    cutoffs = thresholds(plain, labels, id_col, stratum_col, **options)
    stratum = F.coalesce(F.col(stratum_col).cast("string"), F.lit("\0null"))
    bad = base_failed(renamed["n_words"], renamed["n_repeat_words"])
    for (s, r), cut in sorted(cutoffs.items()):
        bad = bad | ((stratum == s) & (F.col(renamed[r]) >= cut))
    return measured.where(~bad).select(*[F.col(f"`{c}`") for c in docs.columns])
