import random

from pyspark.sql import functions as F

from duplika.functions import cigar as C
from duplika.functions import sequence as Q


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_sequence_functions(spark):
    r = one(
        spark, Q.mask_compact(F.lit("ACgtNNacGT")).alias("m"), Q.mask_compact_bases(F.lit("ACgtNNacGT")).alias("b"), Q.reverse_complement(F.lit("AACgt")).alias("r"),
        Q.species_name(F.lit("/x/y/hg#38.v1.fa")).alias("s"), *[Q.valid_contig(F.lit(c)).alias(c) for c in ("chr1", "chrM", "chr6_alt")],
    )
    assert (r.m, r.b, r.r, r.s, r.chr1, r.chrM, r.chr6_alt) == ("ACNNGT", "ACGT", "acGTT", "hg38.v1", True, False, False)
    assert abs(Q.seed_density(0.3, 0.15, 14) - 0.0482) < 1e-4
    s, e = Q.to_forward(F.lit(10), F.lit(25), F.lit(100))
    assert tuple(one(spark, s.alias("s"), e.alias("e"))) == (75, 90)
    args = [F.lit(x).cast("long") for x in (3000, 4000, 12000, 13000, 20000, 20000)]
    assert tuple(one(spark, *[c.alias(f"c{i}") for i, c in enumerate(Q.pad_and_clip(*args, F.lit(True)))])) == (0, 9000, 9000, 18000)


def test_cigar(spark):
    ops = C.parse(F.lit("5=2X3I10=1D"))
    r = one(
        spark, C.render(C.simplify(ops)).alias("s"), C.total(ops).alias("n"), C.percent(C.gap_error(ops)).alias("g"), C.percent(C.mismatch_error(ops)).alias("x"),
        C.percent(C.error(ops)).alias("e"), C.score(ops, 5, -4, -1).alias("score"), C.is_valid(ops, F.lit(0), F.lit(20), F.lit(7), F.lit(25)).alias("ok"),
        C.render(C.merge_runs(C.parse(F.lit("1M2M3I4I5M")))).alias("m"), C.walk(ops, F.lit(10), F.lit(100)).alias("w"), C.error(C.parse(F.lit(""))).alias("none"),
    )
    assert (r.s, r.n, r.g, r.x, r.e, r.score, r.ok, r.m, r.none) == ("7M3I10M1D", 21, 19.0, 9.5, 28.6, 63.0, True, "3M7I5M", None)
    assert [tuple(s) for s in r.w] == [(10, 100, 5, "="), (15, 105, 2, "X"), (17, 107, 3, "I"), (20, 107, 10, "="), (30, 117, 1, "D")]


def test_cigar_spans_agree_with_a_walk(spark):
    rng = random.Random(1)
    texts = ["".join(f"{rng.randint(1, 30)}{rng.choice('=XID')}" for _ in range(rng.randint(1, 9))) for _ in range(50)]
    df = spark.createDataFrame([(t,) for t in texts], "c string")
    for r in df.select("c", C.x_span(C.parse(F.col("c"))).alias("x"), C.y_span(C.parse(F.col("c"))).alias("y"), C.render(C.simplify(C.parse(F.col("c")))).alias("s")).collect():
        import re

        ops = [(int(n), o) for n, o in re.findall(r"(\d+)(.)", r.c)]
        assert r.x == sum(n for n, o in ops if o != "D") and r.y == sum(n for n, o in ops if o != "I")
        again = re.findall(r"\d+(.)", r.s)
        assert all(a != b for a, b in zip(again, again[1:]))
