"""Neighbour joining against a joining by hand, on additive trees and on the tables."""

import os
import random

import pytest
from duplika.operators.tree import complete, neighbour_joining
from duplika.plans.queries import QUERIES
from duplika.staging import workdir

from .oracle import DATA


def naive(d):
    """Edges of the tree of distances {(i, j): d} with i < j, by a scan of all pairs in each round."""
    at = lambda a, b: d[min(a, b), max(a, b)]
    nodes, out, d = sorted({x for p in d for x in p}), [], dict(d)
    step = 0
    while len(nodes) > 2:
        n, step = len(nodes), step + 1
        r = {a: sum(at(a, b) for b in nodes if b != a) for a in nodes}
        q, a, b = min((round((n - 2) * at(a, b) - r[a] - r[b], 9), a, b) for a in nodes for b in nodes if a < b)
        near, new = at(a, b) / 2 + (r[a] - r[b]) / (2 * (n - 2)), f"#{step}"
        out += [(a, new, near), (b, new, at(a, b) - near)]
        for c in nodes:
            if c not in (a, b):
                d[min(c, new), max(c, new)] = (at(a, c) + at(b, c) - at(a, b)) / 2
        nodes = [c for c in nodes if c not in (a, b)] + [new]
    if len(nodes) == 2:
        a, b = sorted(nodes, key=lambda x: (int(x[1:]) if x[0] == "#" else 0, x))
        out.append((a, b, at(a, b)))
    return out


def rounded(rows):
    return sorted((a, b, round(x, 6)) for a, b, x in rows)


def table(spark, d):
    return spark.createDataFrame([(a, b, float(x)) for (a, b), x in d.items()], "i string, j string, distance double")


def additive(n, rng):
    """Distances between the leaves of a random tree, and its edges' lengths by the leaves that they cut off."""
    parent = {}
    live = [f"n{i:02d}" for i in range(n)]
    leaves = {x: {x} for x in live}
    k = 0
    while len(live) > 1:
        a, b = rng.sample(live, 2)
        k += 1
        new = f"in{k}"
        parent[a], parent[b] = (new, rng.randint(1, 9)), (new, rng.randint(1, 9))
        leaves[new] = leaves[a] | leaves[b]
        live = [x for x in live if x not in (a, b)] + [new]

    def up(x):
        out, length = {x: 0}, 0
        while x in parent:
            x, step = parent[x]
            length += step
            out[x] = length
        return out

    names = [f"n{i:02d}" for i in range(n)]
    return {(a, b): min(up(a)[x] + up(b)[x] for x in up(a).keys() & up(b).keys()) for a in names for b in names if a < b}


def test_equals_the_joining_by_hand(spark):
    rng = random.Random(2)
    names = [f"s{i}" for i in range(11)]
    d = {(a, b): rng.randint(1, 60) / 64 for a in names for b in names if a < b}
    assert rounded(neighbour_joining(table(spark, d), workdir(spark)).collect()) == rounded(naive(d))


def test_additive_distances_come_back(spark):
    d = additive(9, random.Random(6))
    edges = neighbour_joining(table(spark, d), workdir(spark)).collect()
    near = {}
    for r in edges:
        near.setdefault(r.node, []).append((r.parent, r.length))
        near.setdefault(r.parent, []).append((r.node, r.length))
    for a, b in d:
        seen, todo = {a: 0.0}, [a]
        while todo:
            x = todo.pop()
            for y, length in near[x]:
                if y not in seen:
                    seen[y] = seen[x] + length
                    todo.append(y)
        assert abs(seen[b] - d[a, b]) < 1e-9


def test_few_nodes_ties_and_gaps(spark):
    folder = workdir(spark)
    assert neighbour_joining(table(spark, {}), f"{folder}/a").count() == 0
    assert rounded(neighbour_joining(table(spark, {("x", "y"): 3}), f"{folder}/b").collect()) == [("x", "y", 3.0)]
    same = {(a, b): 1.0 for a in "pqrst" for b in "pqrst" if a < b}
    assert rounded(neighbour_joining(table(spark, same), f"{folder}/c").collect()) == rounded(naive(same))
    names = spark.createDataFrame([("x",), ("y",), ("z",), ("x",), (None,)], "name string")
    got = complete(names, table(spark, {("y", "x"): 0.25, ("x", "y"): 0.5}))
    assert sorted(map(tuple, got.collect())) == [("x", "y", 0.25), ("x", "z", 1.0), ("y", "z", 1.0)]
    with pytest.raises(ValueError, match="absent"):
        neighbour_joining(table(spark, {("x", "y"): 1, ("y", "z"): 1}), f"{folder}/d")


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
def test_query(spark):
    names = sorted({r.source for r in spark.read.parquet(f"{DATA}/documents.parquet").select("source").collect()})
    d = {(a, b): 1.0 for a in names for b in names if a < b} | {(r.i, r.j): r.distance for r in QUERIES["set_distance"](spark, DATA).collect()}
    assert rounded(QUERIES["join_tree"](spark, DATA).collect()) == rounded(naive(d))
