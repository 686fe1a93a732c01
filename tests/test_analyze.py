"""Measures of aligned pairs against a walk base by base; cover in rounds against the one-by-one choice; stage measures."""

import math
import random

from duplika.operators import kernels
from duplika.operators.analyze import analyze, overlapping
from duplika.operators.evaluate import mutate, random_sequence
from duplika.plans.repeats import Settings, core_elements, greedy_rounds, run
from duplika.staging import workdir
from pyspark.sql import functions as F

MASKED = set("acgtNn")


def naive(a, b, ops):
    """The measures of one pair, by two pointers; a masked run is a gap before the column that follows it."""
    i = j = 0
    columns, text = dict.fromkeys(("m", "d", "i", "ma", "mb", "same", "ti", "tv"), 0), []

    def put(n, sign):
        if text and text[-1][1] == sign:
            text[-1][0] += n
        elif n:
            text.append([n, sign])

    for n, op in ops:
        for _ in range(n):
            if op in "MD":
                k = 0
                while a[i] in MASKED:
                    i, k = i + 1, k + 1
                columns["ma"] += k
                put(k, "N")
            if op in "MI":
                k = 0
                while b[j] in MASKED:
                    j, k = j + 1, k + 1
                columns["mb"] += k
                put(k, "S")
            put(1, op)
            columns[op.lower()] += 1
            if op == "M":
                columns["same"] += a[i] == b[j]
                pairs = {frozenset("AG"), frozenset("CT")}
                columns["ti"] += a[i] != b[j] and frozenset((a[i], b[j])) in pairs
                columns["tv"] += a[i] != b[j] and frozenset((a[i], b[j])) not in pairs
            i, j = i + (op in "MD"), j + (op in "MI")
    assert i == len(a) and j == len(b)
    return columns, "".join(f"{n}{s}" for n, s in text)


def soft(seq, rng):
    out = list(seq)
    for _ in range(rng.randint(0, 4)):
        at = rng.randrange(len(out))
        for q in range(at, min(at + rng.randint(1, 9), len(out) - 1)):
            out[q] = out[q].lower()
    return "".join(out)


def test_measures_equal_a_walk(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for n in range(60):
        a, b, ops = "", "", []
        for _ in range(rng.randint(1, 9)):
            k, op = rng.randint(1, 12), rng.choice("MMMDI")
            x = random_sequence(k, rng)
            ops.append((k, op))
            a += x if op != "I" else ""
            b += mutate(x, 0.3, 0, rng) if op != "D" else ""
        ops.append((1, "M"))
        a, b = a + "A", b + "G"
        # Masked bases go between the columns, so the CIGAR still takes up all others.
        spread = lambda s: "".join((random_sequence(rng.randint(1, 5), rng).lower() if rng.random() < 0.2 else "") + ("N" if rng.random() < 0.05 else "") + c for c in s)
        a, b = spread(a), spread(b)
        rows.append((n, a, b, "".join(f"{k}{o}" for k, o in ops)))
        want[n] = naive(a, b, ops)
    rows += [(100, "ACGTac", "ACGT", "4M"), (101, None, "A", "1M"), (102, "ACGT", "ACG", "4M"), (103, "", "", ""), (104, "ACGT", "ACGT", "4Q")]
    got = {r.id: r for r in analyze(spark.createDataFrame(rows, "id long, a string, b string, cigar string")).collect()}
    assert len(got) == 65
    for n, (c, text) in want.items():
        r, gaps = got[n], c["d"] + c["i"] + c["ma"] + c["mb"]
        assert r.masked_cigar == text
        assert (r.aligned, r.matches, r.transitions, r.transversions) == (c["m"], c["same"], c["ti"], c["tv"])
        assert (r.indel_a, r.indel_b, r.gaps, r.columns) == (c["d"] + c["ma"], c["i"] + c["mb"], gaps, gaps + c["m"])
        assert (r.upper_a, r.upper_b) == (c["m"] + c["d"], c["m"] + c["i"])
        assert r.span == max(c["m"] + c["d"] + c["ma"], c["m"] + c["i"] + c["mb"])
        assert math.isclose(r.error, (c["m"] - c["same"] + gaps) / (gaps + c["m"])) and math.isclose(r.identity, 1 - r.error)
        part = (c["m"] - c["same"]) / r.upper_b
        assert (r.jukes_cantor is None) == (part >= 0.75) and (r.jukes_cantor is None or math.isclose(r.jukes_cantor, -0.75 * math.log(1 - 4 / 3 * part), abs_tol=1e-12))
    for n in (100, 101, 102, 104):
        assert got[n].aligned is None and got[n].error is None and got[n].masked_cigar is None
    assert got[103].aligned == 0 and got[103].error is None and got[103].masked_cigar == ""
    empty = spark.createDataFrame([], "id long, a string, b string, cigar string")
    assert analyze(empty).count() == 0


def test_overlapping_copies(spark):
    rows = [(0, 1000, 950, 1950, True, False), (0, 1000, 50, 1060, True, True), (0, 1000, 50, 1060, False, False)]
    df = spark.createDataFrame(rows, "a long, b long, c long, d long, same boolean, want boolean")
    assert all(r.got == r.want for r in df.select(overlapping(*map(F.col, "abcd"), F.col("same")).alias("got"), "want").collect())


def test_cover_in_rounds_is_the_greedy_choice(spark):
    rng = random.Random(9)
    sets = {e: {rng.randrange(120) for _ in range(rng.choice((1, 2, 3, 30)))} for e in range(90)}
    edges = spark.createDataFrame([(e, s) for e, held in sets.items() for s in held], "elem long, sd long")
    want = sorted(kernels.greedy_cover(sets))
    for one_task in (0, 60):
        got = greedy_rounds(edges, workdir(spark), one_task=one_task)
        assert sorted(r.elem for r in got.collect()) == want
    cores = [e for e in want if len(sets[e]) >= 2]
    for one_task in (10, 100_000):
        assert sorted(r.elem for r in core_elements(edges, workdir(spark), one_task).collect()) == cores
    assert core_elements(edges.where("elem < 0"), workdir(spark)).count() == 0


def test_stages_are_measured(spark, tmp_path):
    rng = random.Random(4)
    unit, sides = random_sequence(2500, rng), [random_sequence(4000, rng) for _ in range(3)]
    seq = sides[0] + unit + sides[1].lower() + mutate(unit, 0.03, 0.02, rng) + sides[2]
    df = spark.createDataFrame([("a", "chr1", seq)], "species string, chrom string, seq string")
    out = run(df, Settings(decomposition=False), f"file://{tmp_path}/stages")
    held = {r.stage: r for r in out["measures"].collect()}
    assert set(held) == {"masked", "aligned", "pairs", "runs"}
    assert held["masked"].rows == 1 and held["masked"].bases == sum(c.isupper() for c in seq)
    pairs = out["pairs"].collect()
    assert pairs and held["pairs"].rows == len(pairs) == held["aligned"].rows and held["pairs"].dropped == 0
    assert held["aligned"].columns > 2000 and held["masked"].columns is None
    again = run(df, Settings(decomposition=False), f"file://{tmp_path}/stages")
    assert sorted(again["measures"].collect()) == sorted(held.values())
