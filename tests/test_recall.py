"""Planted copies are found, wherever they lie."""

import random

import pytest

from duplika.functions.sequence import reverse_complement
from duplika.operators import evaluate, intervals
from duplika.plans.repeats import Settings, run
from pyspark.sql import functions as F

PLAIN = Settings(hard=True, decomposition=False)


def turned(s):
    return s.translate(str.maketrans("ACGT", "TGCA"))[::-1]


def test_copies_near_and_far_on_one_chromosome(spark):
    """Direct and inverted copies at 3 % error, 1, 6, 12 and 30 kb behind the original."""
    rng, rows, truth = random.Random(21), [], {}
    for gap in (1_000, 6_000, 12_000, 30_000):
        for inverted in (False, True):
            unit = evaluate.random_sequence(3000, rng)
            copy = evaluate.mutate(unit, 0.02, 0.01, rng)
            seq = evaluate.random_sequence(20_000, rng) + unit + evaluate.random_sequence(gap, rng)
            start = len(seq)
            seq += (turned(copy) if inverted else copy) + evaluate.random_sequence(15_000, rng)
            name = f"chr{len(rows) + 1}"
            rows.append(("g", name, seq))
            truth[name] = (20_000, 23_000, start, start + len(copy), "-" if inverted else "+")
    df = spark.createDataFrame(rows, "species string, chrom string, seq string")
    found = run(df, PLAIN)["pairs"].collect()
    for name, (a, b, c, d, strand) in truth.items():
        hits = [r for r in found if r.chr1 == r.chr2 == name and r.strand2 == strand]
        best = max((min(b, r.end1) - max(a, r.start1) + min(d, r.end2) - max(c, r.start2) for r in hits), default=0)
        assert best > 0.95 * (b - a + d - c), (name, truth[name], found)


def test_hits_grow_beyond_their_seeds(spark):
    """A copy of 880 bases in similar surroundings is long enough with these."""
    rng = random.Random(22)
    ends = [evaluate.random_sequence(12_000, rng) for _ in range(3)]
    unit = evaluate.random_sequence(2000, rng)
    seq = ends[0] + unit + ends[1] + evaluate.mutate(unit, 0.05, 0.01, rng) + ends[2]
    (r,) = run(spark.createDataFrame([("g", "chr1", seq)], "species string, chrom string, seq string"), PLAIN)["pairs"].collect()
    assert abs(r.start1 - 12_000) < 60 and abs(r.end1 - 14_000) < 60 and r.score < 12


@pytest.mark.parametrize("gap", [0, 3_000])
def test_hairpins(spark, gap):
    """An inverted repeat about the centre of its contig: both sides have the same places on their strands."""
    rng = random.Random(23)
    unit, side = evaluate.random_sequence(4000, rng), 9000
    seq = evaluate.random_sequence(side, rng) + unit + evaluate.random_sequence(gap, rng) + turned(unit) + evaluate.random_sequence(side, rng)
    found = run(spark.createDataFrame([("g", "chr1", seq)], "species string, chrom string, seq string"), PLAIN)["pairs"].collect()
    assert any(r.strand2 == "-" and r.end1 - r.start1 > 3800 for r in found)
    boxes = spark.createDataFrame([("k", True, 5, 9, 5, 9), ("k", False, 5, 9, 5, 9)], "k string, rc boolean, x_start long, x_end long, y_start long, y_end long")
    assert [r.rc for r in intervals.merge_boxes(boxes, ["k", "rc"], one_line=~F.col("rc")).collect()] == [True]
    assert intervals.merge_boxes(boxes, ["k", "rc"]).count() == 0 and reverse_complement(F.col("k")) is not None


def test_planted_documents(spark):
    """Recall over many sequences: mutated copies between and within, by error."""
    rng, rows, truth = random.Random(24), [], []
    for i in range(12):
        error = (0.02, 0.05, 0.10)[i % 3]
        unit = evaluate.random_sequence(2500, rng)
        copy = evaluate.mutate(unit, error, error / 4, rng)
        a, b = (evaluate.random_sequence(rng.randint(500, 3000), rng) for _ in range(2))
        rows += [("g", f"chrA{i}", a + unit + b), ("g", f"chrB{i}", b[::-1] + (turned(copy) if i % 2 else copy) + a[::-1])]
        truth.append((f"chrA{i}", len(a), len(a) + 2500, f"chrB{i}", len(b), len(b) + len(copy)))
    df = spark.createDataFrame(rows, "species string, chrom string, seq string")
    found = run(df, Settings(hard=True, decomposition=False, keep_contigs=True))["pairs"].collect()
    hit = 0
    for ca, a, b, cb, c, d in truth:
        best = max((min(b, r.end1) - max(a, r.start1) + min(d, r.end2) - max(c, r.start2) for r in found if (r.chr1, r.chr2) == (ca, cb)), default=0)
        hit += best > 0.9 * (b - a + d - c)
    assert hit == 12
