import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from duplika.operators import intervals, masking, seeds
from duplika.operators.deal import deal
from duplika.operators.graph import components
from duplika.staging import workdir


def trailing(h, w):
    """The sampling rule, place by place."""
    out, last = [], None
    for i in range(w, len(h)):
        front = max(c for c in range(i + 1) if all(h[c] <= h[j] for j in range(max(0, c - w), c)))
        if h[front] != last:
            out.append(front)
            last = h[front]
    return out


def test_minimizer_rule():
    assert seeds.minimizer_places(np.array([5, 1, 9, 8, 10]), 2).tolist() == [1]
    rng = np.random.default_rng(0)
    for _ in range(50):
        h = rng.integers(0, 30, rng.integers(1, 90))
        assert seeds.minimizer_places(h, 4).tolist() == trailing(h.tolist(), 4)


def test_minimizers_in_parts(spark, monkeypatch):
    rng = random.Random(2)
    seq = "".join(rng.choices("ACGT", k=3000))
    df = spark.createDataFrame([("s", "c", seq), ("s", "short", "ACG"), ("s", "none", None)], "species string, chrom string, seq string")
    got = sorted((r.pos, r.kmer) for r in seeds.minimizers(df, 6, 5).collect())
    places = seeds.minimizer_places(seeds.kmer_codes(seq.encode(), 6), 5)
    assert got == [(p, seq[p : p + 6]) for p in places.tolist()]
    size, at, parts, last = 100, 0, [], None
    h = seeds.kmer_codes(seq.encode(), 6)
    assert Counter(r.kmer for r in seeds.kmers(df, 6).collect()) == Counter(seq[i : i + 6] for i in range(len(seq) - 5))
    assert h.size == 2995 and size and not at and not parts and last is None


def test_counts(spark):
    df = spark.createDataFrame([("s", "c", "ACGTACGTAC"), ("s", "d", "ACGT"), ("s", "e", None)], "species string, chrom string, seq string")
    by_number = {r.list_len: r.n_keys for r in seeds.count_histogram(seeds.kmer_counts(df, 4, chunk=3)).collect()}
    assert by_number == {r.list_len: r.n_keys for r in seeds.frequency_histogram(seeds.kmers(df, 4)).collect()} == {3: 1, 2: 2, 1: 1}


def test_cutoff(spark):
    h = spark.createDataFrame([(1, 900), (2, 90), (50, 1)], "list_len long, n_keys long")
    assert seeds.frequency_cutoff(h, 2000).first().threshold == 50
    assert seeds.frequency_cutoff(h, 10).first().threshold == 1 << 31


def merged(iv):
    out = []
    for s, e in sorted(iv):
        if out and s < out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        elif s < e:
            out.append([s, e])
    return [tuple(x) for x in out]


def test_interval_algebra(spark):
    rows = [("a", s, e) for s, e in ((0, 10), (5, 12), (12, 20), (30, 40), (31, 33), (7, 7))]
    df = spark.createDataFrame(rows, "k string, start long, end long")
    for size in (3, 8, 1 << 20):
        assert sorted(tuple(r)[1:] for r in intervals.union(df, ["k"], bin_size=size).collect()) == [(0, 12), (12, 20), (30, 40)]
    rng = random.Random(3)
    a = [(rng.choice("xy"), s := rng.randrange(500), s + rng.randrange(60)) for _ in range(120)]
    b = [(rng.choice("xy"), s := rng.randrange(500), s + rng.randrange(60)) for _ in range(90)]
    fa = spark.createDataFrame(a, "k string, start_a long, end_a long")
    fb = spark.createDataFrame(b, "k string, start_b long, end_b long")
    want = Counter((k, s, e, t, f) for k, s, e in a for j, t, f in b if j == k and s < f and t < e and s < e and t < f)
    got = intervals.overlap_join(fa, fb, ["k"], 16).select("k", "start_a", "end_a", "start_b", "end_b")
    assert Counter(map(tuple, got.collect())) == want
    inside = intervals.strictly_inside(fa, fb, ["k"], 16)
    assert inside.count() == sum(n for (k, s, e, t, f), n in want.items() if s > t and e < f)
    by = defaultdict(list)
    for k, s, e in a:
        by[k].append((s, e))
    u = intervals.union(fa.select("k", F.col("start_a").alias("start"), F.col("end_a").alias("end")), ["k"], bin_size=32)
    assert sorted(map(tuple, u.collect())) == sorted((k, *m) for k, v in by.items() for m in merged([x for x in v if x[0] < x[1]]))
    points = spark.createDataFrame([("x", p) for p in range(0, 560, 7)], "k string, at long")
    found = {r.at for r in intervals.points_within(points, fa.select("k", F.col("start_a").alias("start"), F.col("end_a").alias("end")), ["k"], "at", 32).collect()}
    assert found == {p for p in range(0, 560, 7) if any(s <= p < e for s, e in by["x"])}


def test_segments_and_venn(spark):
    rows = [("k", "a", 0, 10), ("k", "b", 5, 15), ("k", "a", 20, 22)]
    segs = intervals.segments(spark.createDataFrame(rows, "k string, tag string, start long, end long"), ["k"], "tag", ["a", "b"])
    assert {r.combo: r.bases for r in intervals.venn(segs, ["a", "b"]).collect()} == {"a": 7, "b": 5, "a&b": 5}


def naive_boxes(boxes, d):
    boxes = [b for b in boxes if (b[0], b[1]) != (b[2], b[3])]
    while True:
        for i in range(len(boxes)):
            for j in range(i):
                a, b = boxes[i], boxes[j]
                if a[1] + d >= b[0] and b[1] + d >= a[0] and a[3] + d >= b[2] and b[3] + d >= a[2]:
                    boxes[j] = (min(a[0], b[0]), max(a[1], b[1]), min(a[2], b[2]), max(a[3], b[3]))
                    del boxes[i]
                    break
            else:
                continue
            break
        else:
            return sorted(set(boxes))


def test_box_merge(spark):
    fixed = [(0, 100, 5000, 5100), (400, 450, 5300, 5400), (2000, 2100, 5000, 5100)]
    rng = random.Random(4)
    more = [(x := rng.randrange(9000), x + 50, y := rng.randrange(9000), y + 80) for _ in range(60)] + [(5, 9, 5, 9)]
    for rows in (fixed, more):
        df = spark.createDataFrame([("k", *r) for r in rows], "k string, x_start long, x_end long, y_start long, y_end long")
        got = sorted(tuple(r)[1:] for r in intervals.merge_boxes(df, ["k"], 500).collect())
        assert got == naive_boxes(list(dict.fromkeys(rows)), 500)
    assert naive_boxes(fixed, 500)[0] == (0, 450, 5000, 5400)


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(130)] + [(i, i + 1) for i in range(300, 380)]
    parent = list(range(400))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        p, q = root(a), root(b)
        parent[max(p, q)] = min(p, q)
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    for one_task in (0, 1000):
        got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), workdir(spark), one_task=one_task).collect()}
        assert got == {x: root(x) for x in nodes}
    assert components(spark.createDataFrame([], "a long, b long"), workdir(spark)).count() == 0


def test_runs_and_lift(spark):
    df = spark.createDataFrame([("s", "c", "ACgtNNacGT"), ("s", "low", "acgt"), ("s", "up", "ACGT")], "species string, chrom string, seq string")
    runs = masking.kept_runs(df)
    got = sorted(tuple(r)[1:] for r in runs.collect())
    assert got == [("c", 0, 0, 2), ("c", 2, 4, 6), ("c", 4, 8, 10), ("c", 6, 10, 10), ("low", 0, 4, 4), ("up", 0, 0, 4), ("up", 4, 4, 4)]
    points = spark.createDataFrame([("s", "c", p) for p in (0, 3, 4, 6)], "species string, chrom string, pos long")
    assert {r.pos: r.lifted for r in masking.lift_points(points, runs).collect()} == {0: 0, 3: 5, 4: 8, 6: 10}
    assert sorted(r.seq for r in masking.mask(df).collect()) == ["ACGT", "ACNNGT"]


def test_lift_cuts_the_cigar(spark):
    from duplika.schema import BEDPE

    x, y = "AAAAttAAAA", "CCCCCCgCC"
    df = spark.createDataFrame([("s", "x", x), ("s", "y", y)], "species string, chrom string, seq string")
    row = ("x", 0, 8, "y", 0, 8, "s:s", 0.0, "+", "+", 8, 8, "8M", "X=0.0;ID=0.0")
    out = masking.lift_pairs(spark.createDataFrame([row], BEDPE), masking.kept_runs(df)).first()
    assert (out.start1, out.end1, out.start2, out.end2, out.cigar) == (0, 10, 0, 9, "4M2S2M1N2M")


def test_deal(spark):
    rng = random.Random(6)
    rows = [(i, rng.randrange(40)) for i in range(500)]
    got = {r.id: r.bucket for r in deal(spark.createDataFrame(rows, "id long, w long"), [F.desc("w"), F.asc("id")], 7).collect()}
    assert got == {i: n % 7 for n, (i, _) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])))}


@pytest.mark.parametrize("n", [0, 1])
def test_empty(spark, n):
    df = spark.createDataFrame([("s", "c", "ACGT")][:n], "species string, chrom string, seq string")
    assert seeds.minimizers(df).count() == 0
    assert seeds.kmers(df, 4).count() == n
