"""Short sequences go to the aligner once a cell, however many pairs they have there."""

import random

from pyspark.sql import functions as F

from duplika.operators import evaluate
from duplika.plans import repeats
from duplika.staging import exists, workdir


def test_a_sequence_is_in_a_cell_once(spark, monkeypatch):
    rng = random.Random(31)
    text = lambda n: evaluate.random_sequence(n, rng)
    unit = text(1_200)
    each = [text(rng.randint(100, 900)) + evaluate.mutate(unit, 0.03, 0.01, rng) + text(rng.randint(100, 900)) for _ in range(14)]
    each += [each[3], each[4][::-1].translate(str.maketrans("ACGT", "TGCA"))]
    seqs = spark.createDataFrame([("s", f"c{i}", s) for i, s in enumerate(each)], "species string, chrom string, seq string")
    folder, settings = workdir(spark), repeats.Settings()
    putative = repeats.search_classes(seqs, settings, f"{folder}/search")
    pairs = putative.withColumns({"hit_id": F.monotonically_increasing_id(), **{f"{s}_{e}": F.lit(0).cast("long") for s in "xy" for e in ("low", "high")}})
    used, bases, buckets = repeats._used(pairs, seqs)
    assert bases == sum(map(len, each[:14])) + len(each[15])  # equal ones are a class
    rows = repeats._near(pairs, used, buckets)
    assert rows.where("hit_id is not null").count() == pairs.count() > 80
    held = rows.where("hit_id is null").groupBy("cell", "chrom_x").count()
    assert held.where("count > 1").isEmpty() and rows.where("hit_id is not null and seq is not null").isEmpty()
    got = []
    monkeypatch.setattr(repeats, "_STRETCHED", 0)
    for near in (1 << 17, 2_300, 0):  # in cells, some of them, none
        monkeypatch.setattr(repeats, "_NEAR", near)
        got.append(sorted(map(tuple, repeats.align(putative, seqs, settings, f"{folder}/{near}", repeats.members_of(seqs)).collect())))
    assert exists(spark, f"{folder}/{1 << 17}/aligned_cells") and not exists(spark, f"{folder}/0/aligned_cells")
    assert got[0] == got[1] == got[2] and len(got[0]) > 80 and {r[9] for r in got[0]} == {"+", "-"}
