"""What the plans of queries that grew faster than their input must not do, and the same results."""

import random

import pyarrow as pa

from duplika.operators import evaluate, intervals, seeds
from duplika.plans.queries import QUERIES

from .oracle import DATA


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().executedPlan().toString()


def test_small_keys_are_merged_in_their_task(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(rng.randrange(9) or None, x, x + rng.randint(1, 90), y, y + rng.randint(1, 90)) for x, y in ((rng.randrange(900), rng.randrange(900)) for _ in range(250))]
    df = spark.createDataFrame(rows, "k long, x_start long, x_end long, y_start long, y_end long")
    by_rounds = sorted(map(repr, intervals.merge_boxes(df, ["k"], 20, one_task=3).collect()))
    mixed = sorted(map(repr, intervals.merge_boxes(df, ["k"], 20, one_task=27).collect()))
    monkeypatch.setattr(intervals, "components", None)
    whole = df.where("k IS NOT NULL")
    alone = sorted(map(repr, intervals.merge_boxes(whole, ["k"], 20).collect()))
    assert by_rounds == mixed and [r for r in mixed if "k=None" not in r] == alone


def test_packed_kmers_take_two_bytes():
    rng = random.Random(5)
    batch = pa.RecordBatch.from_arrays([pa.array(["".join(rng.choices("ACGT", k=200_000))])], ["seq"])
    packed = list(seeds._packed(14, 1 << 21)([batch]))
    assert sum(len(b.column(c)[i].as_py()) for b in packed for c in ("once", "more", "times") for i in range(b.num_rows)) < 2.1 * 200_000


def test_both_strands_of_a_sequence_meet_without_a_shuffle(spark):
    assert "Exchange" not in plan(QUERIES["seed_pairs_rc"](spark, DATA))


def test_items_of_many_groups_are_met_once_a_set(spark):
    """2,000 items in 60 groups are one set, 1,770 rows; by item there would be 3.5 million."""
    rows = [(f"g{g:02}", i) for g in range(60) for i in range(2_000)] + [("g00", -1), ("h", -1), ("h", None), ("h", -1)]
    df = spark.createDataFrame(rows, "g string, item long").repartition(4)
    found = evaluate.set_distance(df, "g", "item")
    got = {(r.i, r.j): r.distance for r in found.collect()}
    want = {("g00", f"g{g:02}"): round(1 - 1 / 2_001, 6) for g in range(1, 60)} | {(f"g{g:02}", "h"): round(1 - 2_000 / 2_002, 6) for g in range(60)}
    assert got == want  # of equal sets nothing is left, which is distance 1 and no row


def test_a_cigar_is_parsed_once(spark):
    assert QUERIES["cigar_stats"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 2


def test_kmers_of_ranges_that_a_task_holds_are_not_sorted(spark):
    made = QUERIES["kmer_histogram"](spark, DATA)
    made.count()
    assert "range#" not in "".join(line for line in plan(made).splitlines() if "Sort" in line)


def test_kmer_counts_held_at_once_and_one_range_after_another(spark):
    rng = random.Random(6)
    seqs = ["".join(rng.choices("ACGT", weights=(9, 3, 1, 1), k=n)) for n in (0, 5, 40, 3_000, 3_000, 9_000)]
    df = spark.createDataFrame([(s,) for s in seqs], "seq string")
    for k in (3, 9, 12, 14, 15, 20):  # of 15 and more the rows are sorted
        want = {}
        for s in seqs:
            for i in range(len(s) - k + 1):
                code = int("".join(str("ACGT".index(c)) for c in s[i : i + k]), 4)
                want[code] = want.get(code, 0) + 1
        rows = seeds.kmer_counts(df, k, chunk=1_000).collect()
        assert len(rows) == len(want) and {r.kmer: r.n for r in rows} == want
