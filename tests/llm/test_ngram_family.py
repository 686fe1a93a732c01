"""Hot families and hot lists of the n-gram join."""

import inspect
import random

import pytest
from pyspark.sql import functions as F

from duplika.llm import ngram_join

from .test_operators import shingle_set


def brute(rows):
    sets = [(d, shingle_set(t)) for d, t in rows]
    parent = {d: d for d, _ in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = root(a), root(b)
                parent[max(p, q)] = min(p, q)
    return {d: root(d) for d, _ in sets}


def family(size, changes, with_base, seed):
    """Copies of one text with some words changed, beside a passage that many texts share."""
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefghiou", k=6)) for _ in range(3000)]
    base = rng.choices(words, k=120)
    rows = [" ".join(base)] if with_base else []
    for _ in range(size):
        own = list(base)
        for at in rng.sample(range(120), rng.choice(changes)):
            own[at] = "".join(rng.choices("klmnpqrst", k=7))
        rows.append(" ".join(own))
    passage = rng.choices(words, k=60)
    rows += [" ".join(rng.choices(words, k=rng.randint(5, 30)) + passage) for _ in range(size // 2)]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("changes, with_base", [((0, 1, 2, 4, 6), True), ((2, 3, 4), False), ((3, 4, 5), False)], ids=["based", "baseless", "dense, not linked"])
def test_family_against_brute_force(spark, changes, with_base):
    rows = family(150, changes, with_base, len(changes))
    want = brute(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for cell in (256, 16):
        got = {r.doc_id: r.component_id for r in ngram_join.near_duplicates(docs, cell=cell, round_cell=16).collect()}
        assert got == want


@pytest.mark.parametrize("listed", [80, 60], ids=["long", "short"])
def test_reach_keeps_every_pair_and_little_else(spark, listed):
    """A family's far members leave a list, but for those whose partner of another component is in reach."""
    rng = random.Random(3)
    rows = [(t, d, n := rng.randint(40, 60), rng.randint(0, 20), rng.randint(0, 3)) for t in range(6) for d in range(80)]
    named = spark.createDataFrame(rows, "token long, doc_id long, n long, pos int, component long").withColumn("listed", F.lit(listed)).withColumn("shared", F.lit(99))
    kept = {(r.token, r.doc_id) for r in ngram_join.within_reach(named, 75).collect()}
    want = {
        (t, d) for t, d, n, p, c in rows
        if any(t == u and c != o and 175 * min(n - p, m - q) >= 75 * (n + m) for u, _, m, q, o in rows)
    }
    assert want <= kept and len(kept) < len(rows)
    assert len(kept - want) <= len(rows) // 20


def test_links_come_from_the_trees_alone():
    """No other comparison of sets is left in the module, and no list is gathered by its n-gram."""
    source = inspect.getsource(ngram_join)
    assert "array_intersect" not in source and "Window" not in source
    assert "tree.probe" in inspect.getsource(ngram_join.block_links)


def test_names_that_clash(spark):
    rows = [(1, "a b c d e f g", "x", 1), (2, "a b c d e f g", "y", 2), (None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `a.b` string, `row` int")
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((tuple(r) for r in kept.collect()), key=str) == sorted([rows[0], rows[2]], key=str)
