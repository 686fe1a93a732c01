"""One pair of sequences with very many seeds: split into parts, met as a stream, the same chains."""

import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from duplika.operators import evaluate
from duplika.plans import repeats
from duplika.staging import workdir

SETTINGS = repeats.Settings()
COLUMNS = ["species_x", "chrom_x", "species_y", "chrom_y", "own", "rc", "x", "y"]


def rows(df):
    return sorted(map(tuple, df.collect()))


def seeds_of(rng, own, spans):
    """Seeds along diagonals and at random, with breaks on x."""
    out = set()
    for begin, n in spans:
        for i in range(n):
            out.add((begin + 7 * i + rng.randint(0, 4), 9 * i + rng.randint(0, 2), rng.random() < 0.4))
        out |= {(begin + rng.randrange(7 * n), rng.randrange(9 * n), rng.random() < 0.5) for _ in range(n)}
    return [("s", "c1", "s", "c1" if own else "c2", own, rc, x, y) for x, y, rc in out]


@pytest.mark.parametrize("batch", [3, 10_000])
def test_split_pairs_have_the_same_chains(spark, batch):
    rng = random.Random(5)
    data = seeds_of(rng, True, [(0, 300), (9_000, 200), (40_000, 400)]) + seeds_of(rng, False, [(100, 150), (700, 90), (70_000, 250)])
    data += [("s", "c3", "s", "c4", False, False, 5 * i, 5 * i) for i in range(60)] + [("s", "c5", "s", "c6", False, True, 1, 1)]
    hits = spark.createDataFrame(data, "species_x string, chrom_x string, species_y string, chrom_y string, own boolean, rc boolean, x long, y long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        whole = rows(repeats.chain_seeds(hits, SETTINGS))
        split = rows(repeats.chain_seeds(hits, replace(SETTINGS, pair_seeds=100)))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert whole == split and len(whole) > 10
    large = hits.groupBy(COLUMNS[:5]).agg(F.count("*").alias("n")).where("n > 100")
    parts = repeats.split_pairs(hits, large, SETTINGS.max_gap)
    assert parts.count() == sum(r[1] in ("c1",) for r in data)
    assert parts.where("own").select("part").distinct().count() >= 6


def test_a_pair_of_millions_of_seeds_is_dealt_to_many_tasks(spark):
    """2 million seeds of one pair in 400 stretches: no part has more than a few thousand, and all chains are found."""
    stretch, per = 400, 5_000
    i, at = F.col("id") % per, F.floor(F.col("id") / per)
    seeds = spark.range(stretch * per).select(
        F.lit("s").alias("species_x"), F.lit("c1").alias("chrom_x"), F.lit("s").alias("species_y"), F.lit("c2").alias("chrom_y"), F.lit(False).alias("own"),
        F.lit(False).alias("rc"), (at * 100_000 + i * 11).alias("x"), (at * 60_000 + i * 10).alias("y"),
    )
    large = spark.createDataFrame([("s", "c1", "s", "c2", False, stretch * per)], "species_x string, chrom_x string, species_y string, chrom_y string, own boolean, n long")
    sizes = repeats.split_pairs(seeds, large, SETTINGS.max_gap).groupBy("part").agg(F.count("*").alias("n"), F.min("ordinal").alias("first")).collect()
    assert len(sizes) == stretch and {r.n for r in sizes} == {per} and {r["first"] for r in sizes} == {k * per + 1 for k in range(stretch)}
    chains = repeats.chain_seeds(seeds, SETTINGS).collect()
    assert {(c.x_start, c.x_end, c.y_start, c.y_end) for c in chains} == {(k * 100_000, k * 100_000 + 11 * (per - 1), k * 60_000, k * 60_000 + 10 * (per - 1)) for k in range(stretch)}


def test_searches_split_or_whole(spark):
    rng = random.Random(6)
    unit = evaluate.random_sequence(900, rng)
    text = lambda n: evaluate.random_sequence(n, rng)
    seqs = spark.createDataFrame([("s", f"c{i}", text(400) + unit + text(2500) + evaluate.mutate(unit, 0.03, 0.01, rng) + text(100)) for i in range(4)], "species string, chrom string, seq string")
    got = [rows(repeats.search_chains(seqs, s, workdir(spark))) for s in (SETTINGS, replace(SETTINGS, pair_seeds=10))]
    assert got[0] == got[1] and len(got[0]) > 10


def test_tiles_of_ten_kilobases_have_the_same_chains(spark):
    """Islands across a tile's border stay whole, in the tile in which they begin; pairs of many seeds stay cut by islands."""
    rng = random.Random(9)
    data = seeds_of(rng, True, [(0, 300), (9_000, 400), (24_000, 100), (26_000, 60), (39_000, 300)]) + seeds_of(rng, False, [(100, 150), (9_700, 190), (70_000, 250)])
    data += [("s", "c5", "s", "c6", False, True, 1, 1)]
    hits = spark.createDataFrame(data, "species_x string, chrom_x string, species_y string, chrom_y string, own boolean, rc boolean, x long, y long")
    whole, tiled, both = (
        rows(repeats.chain_seeds(hits, s))
        for s in (SETTINGS, replace(SETTINGS, max_chromosome_size=10_000), replace(SETTINGS, max_chromosome_size=10_000, pair_seeds=1_500))
    )
    assert whole == tiled == both and len(whole) > 10
    large = hits.groupBy(COLUMNS[:5]).agg(F.count("*").alias("n")).where("n > 1")
    parts = repeats.split_pairs(hits, large, SETTINGS.max_gap, tile=10_000, tiled=F.lit(True))
    got = {(r.own, r.rc, r.part // 2): r for r in parts.groupBy("own", "rc", "part").agg(F.min("x").alias("low"), F.max("x").alias("high")).collect()}
    assert {(o, k) for o, _, k in got} == {(True, 0), (True, 2), (True, 3), (False, 0), (False, 7)}
    assert all(k * 10_000 - SETTINGS.max_gap < r.low < (k + 1) * 10_000 for (_, _, k), r in got.items())
    assert got[(True, False, 0)].high > 11_000 and got[(True, False, 3)].high > 40_500


@pytest.mark.parametrize("size", [500, 10_000])
def test_whole_searches_tiled_or_not(spark, size):
    """The search of long contigs, within and between, by tiles: other tasks, the same chains."""
    rng = random.Random(10)
    unit = evaluate.random_sequence(1_500, rng)
    text = lambda n: evaluate.random_sequence(n, rng)
    seqs = [("s", f"c{i}", "".join(text(6_000) + evaluate.mutate(unit, 0.03, 0.01, rng) for _ in range(4)) + text(300)) for i in range(3)]
    seqs = spark.createDataFrame(seqs, "species string, chrom string, seq string")
    folder = workdir(spark)
    got = [rows(repeats.search_chains(seqs, s, f"{folder}/{i}")) for i, s in enumerate((SETTINGS, replace(SETTINGS, max_chromosome_size=size)))]
    assert got[0] == got[1] and len(got[0]) > 50
