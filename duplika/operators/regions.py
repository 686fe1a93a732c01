"""Elements of labelled regions, and how far apart regions are by the element sets they hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .intervals import strictly_inside

_REGION = ("chrom", "region_start", "region_end", "label")


def region_groups(elements: DataFrame, regions: DataFrame, bin_size: int = 1 << 16) -> DataFrame:
    """A row for each element strictly inside a region of ``chrom, start, end, label``: the region, and the element's start, len, id and strand.

    Regions may overlap; an element is in each that holds it, and equal elements count as often as they are there. Nulls are in no region. Rows
    stay flat, so a region's size is not bounded by a task.
    """
    a = elements.select("chrom", F.col("start").alias("start_a"), F.col("end").alias("end_a"), "id", "strand")
    b = regions.select("chrom", F.col("start").alias("start_b"), F.col("end").alias("end_b"), "label").distinct()
    held = strictly_inside(a, b, ["chrom"], bin_size)
    return held.select(
        "chrom", F.col("start_b").alias("region_start"), F.col("end_b").alias("region_end"), "label",
        F.col("start_a").alias("start"), (F.col("end_a") - F.col("start_a")).alias("len"), "id", "strand",
    )


def write_region_groups(groups: DataFrame, path: str) -> None:
    """Tab-separated, by region and place: sorted by ranges, so no task orders a whole region."""
    groups.orderBy(*_REGION, "start", "len", "id", "strand").select(*_REGION, "start", "len", "id", "strand").write.option("sep", "\t").csv(path)


def region_distances(groups: DataFrame, regions: DataFrame) -> DataFrame:
    """``label_i, label_j, distance`` of each two labels, i before j: 1 - size(i minus j) / size(i or j), where that is not 1.

    Sets are of element ids; regions of one label are one. A label without elements is at 0 from each before it that has some, and gives no row
    with another empty one. The result has up to a row for each two labels, so it is for lists of regions and not for tables of them;
    what labels share is counted by a join on the element, and only the sizes, a row a label, meet pair by pair.
    """
    held = groups.select("label", "id").distinct()
    size = regions.select("label").distinct().join(held.groupBy("label").agg(F.count("*").alias("n")), "label", "left").na.fill(0, ["n"])
    i, j = (held.select(F.col("label").alias(f"label_{s}"), "id") for s in "ij")
    shared = i.join(j, "id").where("label_i < label_j").groupBy("label_i", "label_j").agg(F.count("*").alias("both"))
    n_i, n_j = (size.select(F.col("label").alias(f"label_{s}"), F.col("n").alias(f"n_{s}")) for s in "ij")
    every = n_i.where("n_i > 0").join(n_j, F.col("label_i") < F.col("label_j")).join(shared, ["label_i", "label_j"], "left").na.fill(0, ["both"])
    distance = 1 - (F.col("n_i") - F.col("both")) / (F.col("n_i") + F.col("n_j") - F.col("both"))
    return every.where("n_i > both").select("label_i", "label_j", F.round(distance, 6).alias("distance"))
