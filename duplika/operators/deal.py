"""Even dealing of ordered rows to buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..staging import stage, workdir


def deal(df: DataFrame, order: list[Column], buckets: int, name: str = "bucket") -> DataFrame:
    """Row number in ``order`` modulo ``buckets``.

    Rows are ordered by ranges; a row's number is its place in its range and the sizes of the ranges before, so that no
    task holds all rows.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    held = stage(ranged, workdir(df.sparkSession), "ranged").withColumn("_part", F.shiftright("_at", 33))
    sizes = held.groupBy("_part").agg(F.count("*").alias("_n"))  # a row a range
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    place = F.col("_base") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return held.join(F.broadcast(base), "_part").withColumn(name, F.pmod(place, F.lit(buckets)).cast("int")).select(*df.columns, name)
