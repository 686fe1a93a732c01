"""Neighbour joining over a table of distances."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import drop, stage

TREE = "node string, parent string, length double"


def _both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "d"))


def complete(names: DataFrame, distances: DataFrame, absent: float = 1.0) -> DataFrame:
    """``i, j, distance`` for all names (name) with i < j; pairs that ``distances`` lacks are ``absent`` apart."""
    held = names.select("name").where("name IS NOT NULL").distinct()
    every = held.select(F.col("name").alias("i")).join(held.select(F.col("name").alias("j")), F.col("i") < F.col("j"))
    given = distances.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "distance").groupBy("i", "j").agg(F.min("distance").alias("distance"))
    return every.join(given, ["i", "j"], "left").na.fill(absent, ["distance"])


def neighbour_joining(distances: DataFrame, folder: str, name: str = "tree") -> DataFrame:
    """The unrooted tree of a whole table (i, j, distance) with i < j: ``node, parent, length``, an edge a row.

    Inner nodes are ``#1``, ``#2`` and on in the order of joining; the last one is no other's child. Each round joins the pair of least Q, that is
    (n - 2) d(a, b) - r(a) - r(b) with r the sum of a node's distances, the smaller pair of names on a tie (Q to nine
    places). Rounds follow each other by the method, n - 2 of them; in each the table of n (n - 1) distances stays
    distributed and one row comes to the driver. Two nodes are one edge, none or one no tree.
    """
    spark = distances.sparkSession
    pairs = distances.select(F.col("i").cast("string").alias("a"), F.col("j").cast("string").alias("b"), F.col("distance").cast("double").alias("d"))
    now = stage(_both_ways(pairs), folder, f"{name}_0")
    n = now.select("a").distinct().count()
    if n and now.count() != n * (n - 1):
        raise ValueError("a distance is absent or given twice; see complete")
    edges: list[tuple[str, str, float]] = []
    for step in range(1, n - 1):
        total = now.groupBy("a").agg(F.sum("d").alias("r"))
        other = total.select(F.col("a").alias("b"), F.col("r").alias("s"))
        q = F.round((n - 2) * F.col("d") - F.col("r") - F.col("s"), 9)
        scored = now.where("a < b").join(total, "a").join(other, "b").select(F.struct(q.alias("q"), "a", "b", "d", "r", "s").alias("row"))
        best = scored.agg(F.min("row").alias("row")).first()["row"]
        near = best.d / 2 + (best.r - best.s) / (2 * (n - 2))
        made, joined = f"#{step}", [best.a, best.b]
        edges += [(best.a, made, near), (best.b, made, best.d - near)]
        rest = now.where(~F.col("a").isin(joined) & ~F.col("b").isin(joined))
        moved = now.where(F.col("a").isin(joined) & ~F.col("b").isin(joined)).groupBy("b").agg(((F.sum("d") - best.d) / 2).alias("d"))
        nxt = stage(rest.unionByName(_both_ways(moved.select(F.lit(made).alias("a"), "b", "d"))), folder, f"{name}_{step}")
        drop(spark, f"{folder}/{name}_{step - 1}")
        now, n = nxt, n - 1
    # Two nodes are left; of a leaf and an inner node, or of two inner ones, the later joined one is the parent.
    rank = F.when(F.col("a").startswith("#"), F.substring("a", 2, 20).cast("int")).otherwise(0)
    last = now.select("a", "b", "d", rank.alias("rank")).orderBy("rank", "a").limit(1).select(F.col("a").alias("node"), F.col("b").alias("parent"), F.col("d").alias("length"))
    return spark.createDataFrame(edges, TREE).unionByName(last)
