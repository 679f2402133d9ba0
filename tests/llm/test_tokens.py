"""Token store and packing: exact round trips against encoding whole texts."""

import shutil
import zlib
from collections import Counter

import numpy as np
import pytest
from graphsieve.llm import packing, token_store
from graphsieve.llm.tokens import vocabulary
from tokenizers import Tokenizer

from .awkward import frame, rows


def encode(name, texts, end):
    t = Tokenizer.from_file(vocabulary(name))
    return [e.ids + [end] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("wide", [False, True])
def test_store(spark, docs, tmp_path, wide):
    path = f"file://{tmp_path}/store"
    token_store.write_store(docs, path, vocabulary("byte_bpe_50k.json"), 2, wide=wide)
    data = rows()
    ids = encode("byte_bpe_50k.json", [r[1] for r in data], 2)
    got = token_store.read_crcs(spark, path, wide).collect()
    assert all(r["verified"] for r in got)
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == Counter((r[0], len(x), crc(x)) for r, x in zip(data, ids))
    ordered = sorted(got, key=lambda r: r["start"])
    assert [r["doc_id"] for r in ordered][0] is None
    assert [r["doc_id"] for r in ordered][1:] == sorted(r[0] for r in data if r[0] is not None)
    assert [r["start"] for r in ordered] == [0, *np.cumsum([r["n_tokens"] for r in ordered])[:-1].tolist()]
    back = Counter((r["doc_id"], tuple(r["ids"])) for r in token_store.read_documents(spark, path, wide).collect())
    assert back == Counter((r[0], tuple(x)) for r, x in zip(data, ids))
    chunks = spark.read.parquet(f"{path}/staged").where("not recipe")
    assert chunks.count() == chunks.select("digest").distinct().count()


def test_store_is_the_same_on_any_layout(spark, tmp_path):
    roots = []
    old = token_store.RANGE
    token_store.RANGE = 16  # several ranges and levels
    try:
        for n, width in ((1, "3"), (7, "9")):
            path = f"file://{tmp_path}/store{n}"
            shuffles = spark.conf.get("spark.sql.shuffle.partitions")
            spark.conf.set("spark.sql.shuffle.partitions", width)
            token_store.write_store(frame(spark).repartition(n), path, vocabulary("byte_bpe_50k.json"), 2)
            assert all(r["verified"] for r in token_store.read_crcs(spark, path).collect())
            spark.conf.set("spark.sql.shuffle.partitions", shuffles)
            roots.append((sorted((r["doc_id"] or -1, bytes(r["root"]), r["start"]) for r in spark.read.parquet(f"{path}/recipes").collect()), sorted(tuple(r) for r in spark.read.parquet(f"{path}/manifest").collect())))
    finally:
        token_store.RANGE = old
    assert roots[0] == roots[1]
    assert max(x[0] for x in roots[0][1]) > 1 and sum(x[2] for x in roots[0][1] if x[0] == 1) == len(roots[0][0])


def rewrite(spark, path, change):
    df = spark.read.parquet(path)
    made = spark.createDataFrame(change([r.asDict() for r in df.collect()]), df.schema)
    (made.write.mode("overwrite").partitionBy("recipe") if path.endswith("staged") else made.write.mode("overwrite")).parquet(path)


def test_damage_is_seen(spark, tmp_path):
    """A changed payload, swapped and dropped recipes, and a manifest that was edited, cut or added to."""
    old = token_store.RANGE
    token_store.RANGE = 16
    store = f"{tmp_path}/store"
    path = f"file://{store}"
    try:
        token_store.write_store(frame(spark).where("doc_id < 60"), path, vocabulary("byte_bpe_50k.json"), 2)
        verdict = lambda: {(r["doc_id"], r["start"]): r["verified"] for r in token_store.read_crcs(spark, path).collect()}
        whole = verdict()
        assert all(whole.values()) and len(whole) > 40

        def swapped(rows, names):
            a, b = next((x, y) for x in rows for y in rows if x["n_tokens"] == y["n_tokens"] and x["digests"] != y["digests"])
            for n in names:
                a[n], b[n] = b[n], a[n]
            return rows

        def edited(rows, at, name, value):
            rows[at][name] = value
            return rows

        cases = [
            ("staged", lambda rows: edited(rows, next(i for i, r in enumerate(rows) if r["digest"]), "payload", b"\1\0")),
            ("recipes", lambda rows: swapped(rows, ["digests"])),
            ("recipes", lambda rows: swapped(rows, ["digests", "root"])),
            ("recipes", lambda rows: [r for r in rows if r["ordinal"] != 20]),
            ("recipes", lambda rows: [r for r in rows if r["ordinal"] < 16]),
            ("manifest", lambda rows: edited(rows, 0, "root", bytes(16))),
            ("manifest", lambda rows: [r for r in rows if r["level"] == 1]),
            ("manifest", lambda rows: [*rows, rows[0] | {"at": 99}]),
        ]
        for k, (table, change) in enumerate(cases):
            kept = f"{store}-kept"
            shutil.copytree(store, kept)
            rewrite(spark, f"{path}/{table}", change)
            got = verdict()
            assert not all(got.values()), (k, table)
            if k in (1, 2):  # at least the two that were swapped
                assert sum(not v for v in got.values()) >= 2
            shutil.rmtree(store)
            shutil.move(kept, store)
        assert verdict() == whole
    finally:
        token_store.RANGE = old


def test_wide_ids_are_refused(spark, tmp_path):
    with pytest.raises(Exception, match="above 65535"):
        token_store.write_store(frame(spark).limit(3), f"file://{tmp_path}/s", vocabulary("byte_bpe_50k.json"), 70_000)


def test_crc_join():
    rng = np.random.default_rng(1)
    shifts = token_store._shifts()
    for _ in range(20):
        parts = [rng.integers(0, 1 << 16, rng.integers(1, 900), dtype=np.uint32) for _ in range(rng.integers(1, 6))]
        crcs = np.array([crc(p) for p in parts], np.uint32)
        out = token_store.crc_join(crcs, np.array([len(p) for p in parts]), np.array([0, len(parts)]), shifts)
        assert int(out[0]) == crc(np.concatenate(parts))


def test_equal_passages_cut_alike():
    rng = np.random.default_rng(4)
    passage = rng.integers(0, 50_000, 6000, dtype=np.uint32)
    two = []
    for n in (333, 1777):
        ids = np.concatenate([rng.integers(0, 50_000, n, dtype=np.uint32), passage])
        ends, _ = token_store.cuts(ids, np.array([0, len(ids)]))
        starts = np.append(0, ends[:-1])
        two.append({ids[s:e].tobytes() for s, e in zip(starts, ends)})
        assert max(ends - starts) <= token_store.MOST
    assert len(two[0] & two[1]) >= 6


def test_empty(spark, empty, tmp_path):
    path = f"file://{tmp_path}/store"
    token_store.write_store(empty, path, vocabulary("byte_bpe_50k.json"), 2)
    assert token_store.read_crcs(spark, path).count() == 0
    assert packing.pack_documents(empty, vocabulary("word_bpe_49k.json")).count() == 0


def check_packing(got, capacity):
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing(spark, docs):
    data = rows()
    ids = encode("word_bpe_49k.json", [r[1] for r in data], 0)
    for capacity in (2048, 64):
        got = packing.pack_documents(docs, vocabulary("word_bpe_49k.json"), 0, capacity).collect()
        want = Counter((r[0], k, s, len(x[s : s + capacity]), crc(x[s : s + capacity])) for r, x in zip(data, ids) for k, s in enumerate(range(0, len(x), capacity)))
        assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
        used = check_packing(got, capacity)
        assert used <= -(-sum(len(x) for x in ids) // capacity) * 1.05 + 1


def test_plans_hold_the_histogram():
    rng = np.random.default_rng(3)
    for capacity in (16, 100, 2048):
        for _ in range(6):
            h = np.zeros(capacity + 1, np.int64)
            np.add.at(h, rng.integers(1, capacity + 1, 3000) if rng.random() < 0.5 else np.minimum(capacity, rng.geometric(3 / capacity, 3000)), 1)
            made = np.zeros_like(h)
            for p, n in packing.plan(h, capacity):
                assert n > 0 and sum(p) <= capacity
                for v in p:
                    made[v] += n
            assert (made == h).all()
            alone = sum(n for _, n in packing.residual(h, capacity))
            assert sum(n for _, n in packing.plan(h, capacity)) <= alone * 1.03 + 2
    assert packing.plan(np.zeros(9, np.int64), 8) == []


def test_patterns_place_most_pieces():
    """On histograms that have most lengths; one that lacks most is packed as tightly, by fewer patterns."""
    rng = np.random.default_rng(4)
    dense = [rng.integers(1, 40, 2049), np.full(2049, 1000), np.bincount(np.minimum(1 + rng.exponential(200, 200_000).astype(int), 2048), minlength=2049), np.bincount(np.minimum(1 + rng.lognormal(6, 1.2, 60_000).astype(int), 2048), minlength=2049)]
    for h in dense:
        h[0] = 0
        out, left = packing.fitted(h, 2048)
        made = np.zeros_like(h)
        for p, n in out:
            assert n > 0 and 2048 - 2048 // packing.SLACK <= sum(p) <= 2048
            np.add.at(made, list(p), n)
        assert (made + left == h).all() and (left >= 0).all()
        assert made.sum() > 0.9 * h.sum()
        used, alone = (sum(n for _, n in x) for x in (packing.plan(h), packing.residual(h, 2048)))
        assert used <= alone * 1.0005 + 1, (used, alone)


def test_patterns_are_full_and_possible():
    rng = np.random.default_rng(5)
    for capacity in (8, 100, 2048):
        h = rng.integers(0, 3, capacity + 1) * (rng.random(capacity + 1) < 0.3)
        for p in packing.enumerate_patterns(h, capacity):
            p = p[p > 0]
            assert p.sum() == capacity and all((p == v).sum() <= h[v] for v in p)


def test_fit_is_least_squares():
    """Against the condition for a minimum: no gradient where a count is above 0, none that would lower it at 0."""
    h = np.random.default_rng(6).integers(0, 9, 101)
    patterns = packing.enumerate_patterns(h, 100)
    x = packing.fit(patterns, h, steps=20_000, near=0)
    rest = np.bincount(patterns.ravel(), weights=np.repeat(x, patterns.shape[1]), minlength=101) - h
    rest[0] = 0
    slope = rest[patterns].sum(1)
    assert (x >= 0).all() and np.abs(slope[x > 1e-6]).max() < 0.05 and slope.min() > -0.05
