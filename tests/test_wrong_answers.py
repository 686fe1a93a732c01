"""Unknown bases, headers, resumed runs and large boxes."""

import random

import numpy as np
from pyspark.sql import functions as F

from duplika.functions import cigar
from duplika.operators import evaluate, intervals, masking
from duplika.operators.anchors import anchors
from duplika.plans.repeats import Settings, _anchors, align_pair, run
from duplika.sources import fasta


def naive_anchors(x, y, k, offset, limit):
    """Each match is grown base by base from its first k-mer below the limit."""
    places, reach, out = {}, {}, set()
    for j in range(len(y) - k + 1):
        places.setdefault(y[j : j + k], []).append(j)
    for i in range(len(x) - k + 1):
        found = places.get(x[i : i + k], []) if set(x[i : i + k]) <= set("ACGT") else []
        for j in found if len(found) <= limit else []:
            if i < reach.get(j - i, 0) or (offset is not None and abs(j + offset - i) <= k):
                continue
            n = k
            while i + n < len(x) and j + n < len(y) and x[i + n] == y[j + n] and x[i + n] in "ACGT":
                n += 1
            out.add((i, j, n))
            reach[j - i] = i + n
    return out


def test_anchors_against_a_naive_search(spark):
    rng = random.Random(2)
    rows = []
    for t in range(40):
        x = "".join(rng.choices("ACGTN", (8, 8, 1, 1, 0.2), k=rng.randint(0, 300)))
        y = evaluate.mutate(x, 0.05, 0.1, rng, 9)
        for offset, limit in ((None, 999), (0, 999), (7, 4), (None, 2)):
            got = set(zip(*(a.tolist() for a in _anchors(x.encode(), y.encode(), 6, offset, limit))))
            assert got == naive_anchors(x, y, 6, offset, limit)
        rows.append((t, x, y, False))
    df = spark.createDataFrame(rows, "hit_id long, seq_x string, seq_y string, same_chrom boolean")
    got = {tuple(r) for r in anchors(df, 6, 4).collect()}
    assert got == {(t, *a) for t, x, y, _ in rows for a in naive_anchors(x, y, 6, None, 4)}


def test_an_unknown_base_is_no_match():
    x = evaluate.random_sequence(1500, random.Random(3))
    x = x[:700] + "A" + x[701:]
    (found,) = align_pair(x.encode(), (x[:700] + "N" + x[701:]).encode())
    assert found[4] == [(700, "="), (1, "X"), (799, "=")]


def test_headers_that_hold_the_sign(spark, tmp_path):
    (tmp_path / "g.fa").write_bytes(b">chr1 length>5 note\r\nACG\r\nTAC\r\n>chr2>x\nAC\n\n>chr3\n>chr4\nGG")
    got = {r.chrom: r.seq for r in fasta.read_fasta(spark, str(tmp_path / "g.fa")).collect()}
    assert got == {"chr1": "ACGTAC", "chr2>x": "AC", "chr3": "", "chr4": "GG"}


def test_another_genome_is_not_resumed(spark, tmp_path):
    rng = random.Random(4)
    settings = Settings(hard=True, decomposition=False)
    pairs = []
    for _ in range(2):
        unit = evaluate.random_sequence(2000, rng)
        seq = evaluate.random_sequence(rng.randint(6500, 9000), rng) + unit + evaluate.random_sequence(8000, rng) + unit + evaluate.random_sequence(6000, rng)
        df = spark.createDataFrame([("a", "chr1", seq)], "species string, chrom string, seq string")
        pairs.append([sorted(map(tuple, run(df, settings, str(tmp_path))["pairs"].collect())) for _ in range(2)])
    assert pairs[0][0] == pairs[0][1] and pairs[1][0] == pairs[1][1] and pairs[0][0] != pairs[1][0]


def test_large_and_small_boxes(spark):
    rng = random.Random(6)
    boxes = []
    for _ in range(80):
        size, x, y = rng.choice((10, 900, 40_000, 1_500_000)), rng.randrange(6_000_000), rng.randrange(6_000_000)
        boxes.append((x, x + rng.randint(1, size), y, y + rng.randint(1, size)))
    want = set(boxes)
    while True:
        near = lambda a, b: a[0] <= b[1] + 500 and b[0] <= a[1] + 500 and a[2] <= b[3] + 500 and b[2] <= a[3] + 500
        pair = next(((a, b) for a in want for b in want if a < b and near(a, b)), None)
        if pair is None:
            break
        a, b = pair
        want = want - {a, b} | {(min(a[0], b[0]), max(a[1], b[1]), min(a[2], b[2]), max(a[3], b[3]))}
    df = spark.createDataFrame([("k", *b) for b in boxes], "k string, x_start long, x_end long, y_start long, y_end long")
    assert {tuple(r)[1:] for r in intervals.merge_boxes(df, ["k"], 500).collect()} == want


def test_many_runs_are_not_quadratic(spark):
    seq = "".join(("Ac", "ACg")[i % 2] for i in range(100_000))
    df = spark.createDataFrame([("s", "c", seq), ("s", "none", None)], "species string, chrom string, seq string")
    got = masking.kept_runs(df).agg(F.count("*"), F.max("masked_off"), F.max("orig_end")).first()
    assert tuple(got) == (100_001, 150_000, len(seq))
    row = spark.range(1).select(F.lit("3=" * 60_000 + "1X" * 2 + "1=").alias("c"))
    assert row.select(cigar.render(cigar.merge_runs(cigar.parse(F.col("c"))))).first()[0] == "180000=2X1="
    empty = spark.createDataFrame([("",), (None,)], "c string").select(cigar.render(cigar.merge_runs(cigar.parse(F.col("c")))))
    assert [r[0] for r in empty.collect()] == ["", None]


def test_looking_forward_and_comparing_tags(spark):
    points = spark.createDataFrame([("a", p) for p in (0, 5, 6, 9)] + [("b", 1)], "k string, at long")
    events = spark.createDataFrame([("a", 5, "x"), ("a", 8, "y")], "k string, at long, v string")
    assert {(r.k, r["at"]): r.v for r in intervals.first_after(points, events, ["k"], "at", "v").collect()} == {("a", 0): "x", ("a", 5): "x", ("a", 6): "y", ("a", 9): None, ("b", 1): None}
    rows = spark.createDataFrame([("c", "t", 0, 100), ("c", "u", 50, 130), ("c", "w", 0, 10)], "chrom string, tag string, start long, end long")
    got = {r.tag: (r.total, r.miss, r.extra) for r in intervals.compare_tags(intervals.segments(rows, ["chrom"], "tag", ["t", "u", "w"]), ["t", "u", "w"], "t").collect()}
    assert got == {"t": (100, 0, 0), "u": (80, 50, 30), "w": (10, 90, 0)}
    assert np.isfinite(list(got["u"])).all()
