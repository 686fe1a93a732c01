"""Labelled regions on a small fixture: borders, overlapping and empty regions, nulls, repeated rows, empty tables."""

from duplika.operators.regions import region_distances, region_groups, write_region_groups

ELEMENT, REGION = "chrom string, start long, end long, id string, strand string, extra int", "chrom string, start long, end long, label string"


def test_groups_and_distances(spark, tmp_path):
    regions = spark.createDataFrame([("c1", 0, 100, "a"), ("c1", 50, 200_000, "b"), ("c2", 0, 100, "c"), ("c2", 0, 100, "c"), ("c3", 0, 9, "d"), (None, 0, 9, "e")], REGION)
    rows = [("c1", 10, 20, "x", "+", 1), ("c1", 60, 70, "y", "-", 1), ("c1", 60, 70, "y", "-", 2), ("c1", 0, 20, "z", "+", 1), ("c1", 80, 100, "z", "+", 1), ("c1", 150_000, 150_010, "x", "+", 1)]
    rows += [("c2", 1, 99, "w", "+", 1), (None, 1, 2, "x", "+", 1), ("c1", None, 5, "x", "+", 1)]
    elements = spark.createDataFrame(rows, ELEMENT)
    groups = region_groups(elements, regions)
    got = sorted((r.label, r.start, r.len, r.id, r.strand) for r in groups.collect())
    y = ("a", 60, 10, "y", "-")
    assert got == [("a", 10, 10, "x", "+"), y, y, ("b", 60, 10, "y", "-"), ("b", 60, 10, "y", "-"), ("b", 80, 20, "z", "+"), ("b", 150_000, 10, "x", "+"), ("c", 1, 98, "w", "+")]
    write_region_groups(groups, f"{tmp_path}/groups")
    lines = [r.value for r in spark.read.text(f"{tmp_path}/groups").collect()]
    assert sorted(lines)[0] == "c1\t0\t100\ta\t10\t10\tx\t+" and len(lines) == len(got)
    far = {(r.label_i, r.label_j): r.distance for r in region_distances(groups, regions).collect()}
    held = {label: {i for g, _, _, i, _ in got if g == label} for label in "abcde"}
    want = {}
    for i in "abcde":
        for j in "abcde":
            if i < j and held[i] - held[j]:
                want[i, j] = round(1 - len(held[i] - held[j]) / len(held[i] | held[j]), 6)
    assert far == want and far["a", "c"] == round(1 - 2 / 3, 6) and far["c", "d"] == 0 and ("a", "b") not in far


def test_nothing_in_nothing_out(spark):
    elements, regions = spark.createDataFrame([], ELEMENT), spark.createDataFrame([("c1", 0, 9, "a"), ("c1", 20, 30, "b")], REGION)
    groups = region_groups(elements, regions)
    assert groups.count() == 0 and region_distances(groups, regions).count() == 0
    assert region_groups(elements, regions.limit(0)).count() == 0
