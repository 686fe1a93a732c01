"""Pair tables, elements, regions and foreign formats as tab-separated text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import BEDPE, ELEMENT, REGION, REGION_LABEL


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("sep", "\t").schema(BEDPE).csv(path)


def check_pairs(pairs: DataFrame) -> DataFrame:
    """Rows that keep the table's promise: x forward and before y. Others raise when read."""
    sp = F.split("reference", ":")
    x = F.struct(F.lit(False), sp[0], F.col("chr1"), F.col("start1"), F.col("end1"))
    y = F.struct(F.col("strand2") == "-", sp[1], F.col("chr2"), F.col("start2"), F.col("end2"))
    fine = (F.col("strand1") == "+") & (x < y)
    return pairs.where(F.when(fine, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("not a forward, ordered pair: "), F.col("chr1"))).cast("boolean")))


def write_pairs(pairs: DataFrame, path: str) -> None:
    pairs.select([F.col(c).cast("string").alias(c) for c in pairs.columns]).na.fill("").write.option("sep", "\t").option("emptyValue", "").csv(path)


def read_elements(spark: SparkSession, path: str) -> DataFrame:
    """Elements of 8 or 9 columns; strand ``_`` reads as ``-``."""
    rows = spark.read.option("sep", "\t").option("mode", "PERMISSIVE").schema(ELEMENT).csv(path)
    return rows.withColumn("strand", F.when(F.col("strand") == "+", "+").otherwise("-"))


def write_elements(elements: DataFrame, path: str) -> None:
    write_pairs(elements, path)


def read_regions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("sep", "\t").schema(REGION).csv(path)


def write_regions(regions: DataFrame, path: str) -> None:
    regions.select("chrom", "start", "end").write.option("sep", "\t").csv(path)


def read_labelled_regions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("sep", "\t").schema(REGION_LABEL).csv(path)


def write_detection(result: DataFrame, path: str) -> None:
    result.select("error", "hits").write.option("sep", ";").option("header", True).csv(path)


#: Places of (chr1, start1, end1, chr2, start2, end2, strand1, strand2) in foreign tables; -1: always forward. Fixed values.
FORMATS = {
    "sdquest": (r"\s+", (1, 2, 3, 5, 6, 7, 4, 8)),
    "wgac": ("\t", (0, 1, 2, 6, 7, 8, -1, 5)),
    "bedpe": ("\t", (0, 1, 2, 3, 4, 5, 8, 9)),
}


def read_foreign(spark: SparkSession, path: str, kind: str, min_len: int = 0, main_contigs: bool = False) -> DataFrame:
    """Pairs of another tool; header lines go, strand ``_`` reads as ``-``."""
    sep, places = FORMATS[kind]
    part = F.split("value", sep)
    names = ("chr1", "start1", "end1", "chr2", "start2", "end2", "strand1", "strand2")
    pick = lambda i: F.lit("+") if i < 0 else F.try_element_at(part, F.lit(i + 1))
    rows = spark.read.text(path).select(*[pick(i).alias(n) for n, i in zip(names, places, strict=True)])
    rows = rows.withColumns({n: F.replace(F.col(n), F.lit("_"), F.lit("-")) for n in ("strand1", "strand2")})
    rows = rows.withColumns({n: F.col(n).try_cast("long") for n in ("start1", "end1", "start2", "end2")}).where("start1 is not null and end1 is not null and start2 is not null and end2 is not null")
    if main_contigs:
        rows = rows.where(~F.col("chr1").contains("_") & ~F.col("chr2").contains("_") & (F.col("chr1") != "chrM") & (F.col("chr2") != "chrM"))
    return rows.where((F.col("end1") - F.col("start1") >= min_len) & (F.col("end2") - F.col("start2") >= min_len))
