"""Connected components of a distributed edge list."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import drop, stage

#: Edges up to which one task finishes the work; more go on in distributed rounds.
ONE_TASK = 100_000


def _union_find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            p, q = root(a), root(b)
            if p != q:
                parent[max(p, q)] = min(p, q)
    if parent:
        nodes = np.fromiter(parent, np.int64, len(parent))
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array([root(x) for x in nodes.tolist()], pa.int64())], ["node", "component"])


def components(edges: DataFrame, folder: str, name: str = "components", most_rounds: int = 60, one_task: int = ONE_TASK) -> DataFrame:
    """``node, component`` for each node of (a, b) edges; a component's name is its smallest node.

    Alternating large-star and small-star rounds, each written out: the edge list turns into stars round the
    smallest nodes in a logarithmic number of rounds, and no component is gathered in one task. Edges are
    counted before each round; once ``one_task`` or fewer are left, a single task finishes with union-find.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")).distinct()
    now = stage(now, folder, f"{name}_0")
    before = None
    for i in range(1, most_rounds + 1):
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if mark == before:
            break
        if mark[0] <= one_task:
            return now.coalesce(1).mapInArrow(_union_find, "node long, component long")
        before = mark
        # Large star: each neighbour above a node goes to the least of the node and its neighbours.
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # Small star: a node and its neighbours below it go to the least of them.
        down = large.where("a <> b").distinct()
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        nxt = small.unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        nxt = stage(nxt, folder, f"{name}_{i}")
        drop(edges.sparkSession, f"{folder}/{name}_{i - 1}")
        now = nxt
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
