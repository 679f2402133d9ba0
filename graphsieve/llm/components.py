"""Connected components of an edge table, label = smallest member."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, lean, ship

EDGES_A_TASK = 400_000


def find_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and the smallest node of each one's component."""
    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inverse[: len(a)], inverse[len(a) :]
    root = np.arange(len(nodes))
    while len(x):
        low = np.minimum(root[x], root[y])
        before = root.copy()
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
        if (before == root).all():
            break
    return nodes, nodes[root]


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)) for b in batches if b.num_rows]
    if parts:
        nodes, root = find_roots(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(root)], ["node", "label"])


def components(edges: DataFrame, scratch: Scratch, table: str, most: int = EDGES_A_TASK) -> DataFrame:
    """node, label for each node of ``edges(a, b)``; written tables cut the lineage each round.

    Each task folds its edges into stars.  Nodes that several tasks saw link the
    stars' centres, and the rounds repeat until every node has one centre.  A task
    holds ``most`` edges or so; few edges take one task and one round.
    """
    ship(edges.sparkSession)
    current = scratch.save(edges.select(F.col("a").cast("long"), F.col("b").cast("long")), f"{table}-edges")
    k = 0
    while True:
        tasks = max(1, -(-current.count() // most))
        dealt = current.repartition(tasks, "a") if tasks > 1 else current.coalesce(1)
        stars = scratch.save(dealt.mapInArrow(lean(_stars), "node long, label long"), f"{table}-{k}")
        if tasks == 1:
            return stars
        best = stars.groupBy("node").agg(F.min("label").alias("m"), F.collect_set("label").alias("all"))  # at most one label a task
        # node-centre and centre-centre edges, pulled to the smallest; a centre that is a node elsewhere follows it
        pulled = scratch.save(best.select("node", "m", F.filter("all", lambda x: x != F.col("m")).alias("others")), f"{table}-{k}-pulled")
        loose = pulled.where(F.size("others") > 0)
        parents = pulled.where("node != m").select(F.col("m").alias("node")).distinct()
        moving = pulled.where("node != m").join(parents, "node", "left_semi")
        if loose.isEmpty() and moving.isEmpty():
            return pulled.select("node", F.col("m").alias("label"))
        links = pulled.select(F.col("node").alias("a"), F.col("m").alias("b")).unionByName(loose.select(F.explode("others").alias("a"), F.col("m").alias("b")))
        up = pulled.select(F.col("node").alias("b"), F.col("m").alias("up"))
        links = links.join(up, "b", "left").select("a", F.coalesce("up", "b").alias("b"), F.col("b").alias("old"))
        links = links.select("a", "b").unionByName(links.where("old != b").select(F.col("old").alias("a"), "b")).distinct()
        k += 1
        current = scratch.save(links, f"{table}-{k}-edges")
