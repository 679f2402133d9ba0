"""Quality rules: counts against plain Python, bounds against sums, cutoffs against enumeration."""

import re
from collections import Counter
from math import comb

import numpy as np
import pytest
from graphsieve.llm import quality

from .awkward import WORD, rows, words


def base(text):
    text = text or ""
    w, seen, dup = words(text), set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    c = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    inside = {j for i in range(len(w) - 7) if c[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside)


def test_counts(spark, docs):
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    got = quality.judge(docs, labels).collect()
    name = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert Counter((r["doc_id"], *(r[n] for n in name)) for r in got) == Counter((r[0], *base(r[1])) for r in rows())
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
        assert r["kept"] != r["base_failed"]  # without labels the base rules alone act


def test_bound_is_exact():
    for n, k, level in ((10, 0, 0.05), (50, 3, 0.01), (400, 7, 0.001)):
        u = quality.upper_bound(k, n, level)
        assert abs(sum(comb(n, i) * u**i * (1 - u) ** (n - i) for i in range(k + 1)) - level) < 1e-6
    assert quality.upper_bound(0, 0, 0.05) == 1.0 and quality.upper_bound(5, 5, 0.05) == 1.0
    assert abs(quality.upper_bound(0, 300, 0.05) - (1 - 0.05 ** (1 / 300))) < 1e-9


def made(spark, n=6000, seed=0, bad_strata=("en",)):
    """Symbols mark bad documents in some strata; elsewhere good ones have them as well."""
    rng = np.random.default_rng(seed)
    out, labels = [], []
    for i in range(n):
        lang = ("en", "fr", None)[i % 3]
        bad = rng.random() < 0.25
        marked = bad if lang in bad_strata else rng.random() < 0.4
        text = " ".join(f"w{rng.integers(1000)}x{j}" + ("%%%" if marked else "") for j in range(30))
        out.append((i, text, lang))
        labels.append((i, 0 if bad else 1))
    labels += [(1, None), (None, 1), (10**9, 0), (2, 1)]
    return spark.createDataFrame(out, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int"), dict(labels[:n]), {o[0]: o for o in out}


def test_cutoffs_reject_bad_and_limit_false_rejections(spark):
    docs, labels, truth, by = made(spark)
    got = quality.judge(docs, labels).collect()
    kept = {r["doc_id"]: r["kept"] for r in got}
    for lang in ("en", "fr", None):
        good = [d for d, q in truth.items() if q == 1 and by[d][2] == lang]
        assert sum(not kept[d] for d in good) <= 0.05 * len(good)
    bad = [d for d, q in truth.items() if q == 0 and by[d][2] == "en"]
    assert sum(not kept[d] for d in bad) >= 0.95 * len(bad)
    assert all(kept[d] for d, o in by.items() if o[2] in ("fr", None))
    few = labels.where("doc_id < 60")
    assert all(r["kept"] for r in quality.judge(docs, few).collect())  # too few labels prove nothing


def test_cutoffs_against_enumeration(spark):
    docs, labels, *_ = made(spark, 3000, 3)
    measured = quality.with_measures(docs, "text", ["doc_id", "lang"]).toPandas()
    got = quality.thresholds(spark.createDataFrame(measured), labels, "doc_id", "lang")
    marks = labels.dropna().groupBy("doc_id").min("quality").toPandas().set_index("doc_id")["min(quality)"]
    m = measured[(measured.n_words >= 20) & (100 * measured.n_repeat_words <= 30 * measured.n_words)]
    m = m.assign(good=m.doc_id.map(marks), s=m.lang.fillna("\0null")).dropna(subset=["good"])
    tested = m.s.nunique() * len(quality.RULES)
    want = {}
    for s, part in m.groupby("s"):
        for rule in quality.RULES:
            best = 0
            for cut in reversed(quality.GRID):
                hit = part[part[rule] >= cut]
                g, b = int((hit.good == 1).sum()), int((hit.good == 0).sum())
                if quality.upper_bound(g, int((part.good == 1).sum()), 0.05 / tested) > 0.05 / len(quality.RULES):
                    break
                if b - 10 * g > best and b >= 10:
                    best, want[s, rule] = b - 10 * g, cut
    assert got == want and want


def test_stage_keeps_columns_and_agrees(spark, docs):
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(r["doc_id"] for r in quality.judge(docs, labels).where("kept").collect())


def test_empty(spark, empty, docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.judge(empty, none).count() == 0 and quality.keep_good(empty, none).count() == 0
    assert quality.judge(docs, none).count() == docs.count()


@pytest.mark.parametrize("k,n,p", [(0, 5, 0.3), (3, 10, 0.2), (10, 10, 0.5), (4, 7, 0.0), (2, 4, 1.0)])
def test_cdf(k, n, p):
    assert abs(quality.binomial_cdf(k, n, p) - sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))) < 1e-9
