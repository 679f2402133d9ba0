"""Mixing and sharding: laws that hold whatever the draws."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from graphsieve.llm import mixing, sharding

from .awkward import frame, rows, words


def water(sizes, weights, most=3.0):
    """Targets by small steps of pouring."""
    out, left, live = dict.fromkeys(sizes, 0.0), float(sum(sizes.values())), set(sizes)
    while left > 1e-6 and live:
        total = sum(weights[k] for k in live)
        step = min([left] + [(most * sizes[k] - out[k]) * total / weights[k] for k in live])
        for k in live:
            out[k] += step * weights[k] / total
        left -= step
        live = {k for k in live if most * sizes[k] - out[k] > 1e-9}
    return out


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 100, "c": 100}, {"a": 1, "b": 1000, "c": 50, "d": 3}, {"x": 0, "y": 10}, {"only": 7}, {None: 5, "é": 100, "z": 1}])
def test_targets(sizes):
    weights = mixing.cycle_weights(sizes)
    got, want = mixing.targets(sizes, weights), water({k: v for k, v in sizes.items()}, weights)
    assert all(abs(got[k] - want[k]) < 1e-3 for k in sizes)
    assert all(got[k] <= 3 * sizes[k] + 1e-9 for k in sizes)


def test_weights_go_by_code_point():
    assert mixing.cycle_weights(["é", "b", None, "Z"]) == {"Z": 5.0, "b": 2.0, "é": 1.0, None: 5.0}


def test_plan(spark, docs):
    got = mixing.mix_plan(docs).collect()
    data = rows()
    assert Counter((r["doc_id"], r["source"], r["size"]) for r in got) == Counter((r[0], r[3], len(words(r[1]))) for r in data)
    sizes = defaultdict(int)
    for r in data:
        sizes[r[3]] += len(words(r[1]))
    goal = mixing.targets(dict(sizes), mixing.cycle_weights(sizes))
    taken = defaultdict(int)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - goal[r["source"]]) < 1e-6
        assert r["taken"] == r["size"] * r["copies"] and 0 <= r["copies"] <= 3
        taken[r["source"]] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - goal[s]) <= max(r["size"] for r in got if r["source"] == s)
    again = mixing.mix_plan(frame(spark).repartition(3)).collect()
    assert Counter((r["doc_id"], r["taken"]) for r in got if r["doc_id"] not in (7, None)) == Counter((r["doc_id"], r["taken"]) for r in again if r["doc_id"] not in (7, None))


def test_reduction_tree(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK", 8)
    data = [(i, " ".join(["w"] * (1 + i * 7 % 23)), "ab"[i % 2]) for i in range(700)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    got = mixing.mix_plan(df).groupBy("source").agg({"taken": "sum", "target": "max"}).collect()
    for r in got:
        assert abs(r["sum(taken)"] - r["max(target)"]) <= 23


def test_pivots_keep_words_and_expectation():
    rng = np.random.default_rng(0)
    size = rng.integers(1, 40, 12).astype(float)
    p0 = np.full(12, 0.37)
    total = np.zeros(12)
    for pool in (True, False):
        mean = np.zeros(12)
        for _ in range(6000):
            p, held = mixing.pivot_pool(0.37, size, rng.random(12)) if pool else mixing.pivot(p0, size, rng.random(12))
            assert abs((p * size).sum() - (p0 * size).sum()) < 1e-6
            assert all(x in (0.0, 1.0) or i == held for i, x in enumerate(p))
            mean += p / 6000
        assert np.abs(mean - p0).max() < 0.03
        total += mean


def test_documents_of_the_mix(spark, docs):
    plan, got = mixing.mix_plan(docs).collect(), mixing.mix_documents(docs)
    assert got.columns == docs.columns
    want, seen = Counter(), Counter(r["doc_id"] for r in got.collect())
    for r in plan:
        want[r["doc_id"]] += r["copies"]
    assert seen == +want


def test_shards(spark, docs):
    got = sharding.shard_documents(docs).collect()
    data = rows()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in data)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append((r["slot"], r["doc_id"]))
        assert r["grown_shard"] in (r["shard"], 16) and r["law"] == "key"
    for s in slots.values():
        s.sort(key=lambda x: x[0])
        assert [x[0] for x in s] == list(range(len(s)))
        ids = [x[1] for x in s if x[1] is not None]
        assert ids == sorted(ids)
    again = Counter((r["doc_id"], r["shard"], r["grown_shard"]) for r in sharding.shard_documents(frame(spark).repartition(2)).collect())
    assert again == Counter((r["doc_id"], r["shard"], r["grown_shard"]) for r in got)


def test_movement_is_confined_and_balanced(spark):
    ids = spark.range(20_000)
    from pyspark.sql import functions as F

    for n in (1, 5, 8, 16, 17):
        tree = sharding.topology(n)
        assert [s.number for s in tree] == list(range(n))
        rows_ = ids.select(sharding.place(F.col("id"), tree).alias("a"), sharding.place(F.col("id"), sharding.grow(tree)).alias("b")).groupBy("a", "b").count().collect()
        assert all(r["b"] in (r["a"], n) for r in rows_)
        per = Counter()
        for r in rows_:
            per[r["a"]] += r["count"]
        assert max(per.values()) < 1.25 * 20_000 / n and len(per) == n
    heavy = tuple(sharding.Shard(s.number, s.region, s.rack, 3.0 if s.number == 5 else 1.0) for s in sharding.topology(16))
    moved = ids.select(sharding.place(F.col("id"), sharding.topology(16)).alias("a"), sharding.place(F.col("id"), heavy).alias("b")).where("a <> b")
    # only the region, then the rack, then the shard that weighs more takes rows
    assert {r["r"] for r in moved.select((F.col("b") / 8).cast("int").alias("r")).distinct().collect()} == {0}
    with pytest.raises(ValueError):
        sharding.place(F.col("id"), ())


def test_empty(spark, empty):
    assert mixing.mix_plan(empty).count() == 0 and mixing.mix_documents(empty).count() == 0
    assert sharding.shard_documents(empty).count() == 0


def test_growing_keeps_the_tree():
    for built in range(1, 25):
        for n in range(built, 41):
            tree = sharding.topology(n, built)
            assert sharding.grow(tree) == sharding.topology(n + 1, built) and [s.number for s in tree] == list(range(n))
            new = sharding.grow(tree)[-1]
            assert new.region not in {s.region for s in tree} and new.rack not in {s.rack for s in tree}
