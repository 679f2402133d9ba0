"""The Jaccard join against all pairs."""

import random
from collections import Counter

import numpy as np
import pytest
from graphsieve.llm import ngram_join
from graphsieve.llm.components import components, find_roots
from graphsieve.llm.common import Scratch

from .awkward import LOWER, frame, rows, words


def shingles(text):
    w = words((text or "").translate(LOWER))
    if len(w) >= 5:
        return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    return frozenset([tuple(w)]) if w else frozenset()


def brute(data):
    sets = [shingles(r[1]) for r in data]
    parent = list(range(len(data)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [0] * len(data)
    for i in range(len(data)):
        for j in range(i):
            if sets[i] and sets[j]:
                o = len(sets[i] & sets[j])
                if 100 * o >= 75 * (len(sets[i]) + len(sets[j]) - o):
                    links[i] += 1
                    links[j] += 1
                    parent[find(i)] = find(j)
    low = {}
    for i, r in enumerate(data):
        if r[0] is not None:
            low[find(i)] = min(low.get(find(i), r[0]), r[0])
    return Counter((r[0], len(sets[i]), low.get(find(i)) if sets[i] else r[0], links[i]) for i, r in enumerate(data))


def result(df):
    return Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["n_links"]) for r in df.collect())


@pytest.mark.parametrize("block, members", [(ngram_join.BLOCK, ngram_join.MEMBERS), (150, 3)])
def test_against_all_pairs(spark, docs, monkeypatch, block, members):
    monkeypatch.setattr(ngram_join, "MEMBERS", members)
    assert result(ngram_join.jaccard_components(docs, block=block)) == brute(rows())


def test_chain_of_copies_and_common_passage(spark):
    rng = random.Random(4)
    base = [f"w{rng.randrange(10**6)}" for _ in range(80)]
    passage = [f"p{i}" for i in range(40)]
    data, w = [], list(base)
    for i in range(60):  # each a copy of the one before with a few words changed
        w = list(w)
        w[rng.randrange(80)] = f"e{i}"
        data.append((i, " ".join(w)))
    for i in range(60, 140):  # a passage that many share, and little else
        data.append((i, " ".join(passage + [f"q{i}x{k}" for k in range(rng.randrange(0, 30))])))
    order = list(range(len(data)))
    rng.shuffle(order)
    df = spark.createDataFrame([data[i] for i in order], "doc_id long, text string").repartition(7)
    assert result(ngram_join.jaccard_components(df, block=400)) == brute(data)


def test_t_occurrence_against_pairs():
    rng = np.random.default_rng(1)
    for trial in range(30):
        pool = rng.integers(1, 1 << 60, 60, dtype=np.uint64)
        common = rng.integers(1, 1 << 60, 12, dtype=np.uint64)
        sets = [np.unique(np.concatenate([rng.choice(pool, rng.integers(1, 25)), common if rng.random() < 0.8 else common[:3]])) for _ in range(25)]
        n = np.array([len(s) + rng.integers(0, 3) for s in sets])
        side = np.zeros(25, int) if trial % 2 else rng.integers(1, 3, 25)
        weight = rng.integers(1, 5, 25)
        a, b, links = ngram_join.t_occurrence(sets, n, side, weight, mu=0.0085 if trial % 3 else 1e-9)
        want = {(i, j) for i in range(25) for j in range(i) if not (side[i] and side[i] == side[j]) and 175 * len(np.intersect1d(sets[i], sets[j])) >= 75 * (n[i] + n[j])}
        assert {(max(x, y), min(x, y)) for x, y in zip(a.tolist(), b.tolist())} == want
        expect = np.zeros(25, int)
        for i, j in want:
            expect[i] += weight[j]
            expect[j] += weight[i]
        assert (links == expect).all()


def test_stage_keeps_one(spark, docs):
    """One row of each component, of its smallest id; rows with equal or null ids and other texts are not its copies."""
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    got = Counter((r["doc_id"], r["text"]) for r in kept.collect())
    data = Counter((r[0], r[1]) for r in rows())
    sets = {}
    for i, t in data:
        w = [x.translate(LOWER) for x in words(t)]
        sets[i, t] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    keys = [k for k in sets if sets[k]]
    root = {k: k for k in keys}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for n, x in enumerate(keys):
        for y in keys[:n]:
            both = len(sets[x] & sets[y])
            if both and 175 * both >= 75 * (len(sets[x]) + len(sets[y])):
                root[top(x)] = top(y)
    parts = {}
    for k in keys:
        parts.setdefault(top(k), []).append(k)
    assert all(got[k] == n for k, n in data.items() if not sets[k])
    for members in parts.values():
        stay = [k for k in members if got[k]]
        ids = [i for i, _ in members if i is not None]
        assert len(stay) == 1 and got[stay[0]] == 1 and stay[0][0] == (min(ids) if ids else None)
    assert sum(got.values()) == len(parts) + sum(n for k, n in data.items() if not sets[k])


@pytest.mark.parametrize("most", [10**6, 15])
def test_components(spark, most):
    rng = random.Random(8)
    edges = [(i, i + 1) for i in range(0, 60) if i % 20 != 19] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(40)]
    rng.shuffle(edges)
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["label"] for r in components(df, Scratch(spark, "cc"), "t", most).collect()}
    nodes, root = find_roots(np.array([e[0] for e in edges]), np.array([e[1] for e in edges]))
    assert got == dict(zip(nodes.tolist(), root.tolist()))
    assert components(df.limit(0), Scratch(spark, "cc"), "e").count() == 0


def test_empty(spark, empty):
    assert ngram_join.jaccard_components(empty).count() == 0
    assert ngram_join.keep_one(empty).count() == 0
    blank = frame(spark, [(i, t, *[None] * 17) for i, t in enumerate(("", None, " \n"))])
    assert {(r["doc_id"], r["component_id"], r["n_links"]) for r in ngram_join.jaccard_components(blank).collect()} == {(0, 0, 0), (1, 1, 0), (2, 2, 0)}
