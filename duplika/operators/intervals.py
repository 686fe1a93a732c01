"""Interval algebra on half-open, 0-based intervals: union, overlap, containment, segments, box merging."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..staging import stage, workdir
from .graph import components


def _carry(df: DataFrame, keys: Sequence[str], sums: dict[str, Column], folds: dict[str, Column], backwards: bool = False) -> DataFrame:
    """``keys, _bin`` and, for each name, what the bins before (or after) hold: ``sums`` of a bin, folded over the others.

    A row for each bin of a key, however many rows these have; so a long key is scanned by all tasks, each bin from its carry on.
    """
    per = df.groupBy(*keys, "_bin").agg(*[v.alias(k) for k, v in sums.items()])
    line = Window.partitionBy(*keys).orderBy(F.desc("_bin") if backwards else F.asc("_bin")).rowsBetween(Window.unboundedPreceding, -1)
    return per.select(*keys, "_bin", *[v.over(line).alias(k) for k, v in folds.items()])


def _islands(df: DataFrame, keys: Sequence[str], start: str, end: str, bin_size: int) -> DataFrame:
    one = [*keys, "_bin"]
    line = Window.partitionBy(*one).orderBy(start, end)
    held = df.withColumn("_bin", F.floor(F.col(start) / bin_size).cast("long"))
    held = held.join(_carry(held, keys, {"_top": F.max(end)}, {"_top": F.max("_top")}), one)
    before = F.greatest(F.max(end).over(line.rowsBetween(Window.unboundedPreceding, -1)), F.col("_top"))  # of what is not null
    opened = held.withColumn("_opens", F.when(F.col(start) < before, 0).otherwise(1)).drop("_top")
    opened = opened.withColumn("_island", F.sum("_opens").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    numbered = opened.join(_carry(opened, keys, {"_n": F.sum("_opens")}, {"_n": F.sum("_n")}), one)
    island = (F.col("_island") + F.coalesce("_n", F.lit(0))).alias("_island")
    return numbered.select(*keys, start, end, island).groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


#: Width of the bins that lines are scanned in.
BIN = 1 << 20


def union(df: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end", bin_size: int = BIN) -> DataFrame:
    """Merged intervals of each key. Book-ended ones stay apart; empty ones are dropped.

    A key's line is scanned in bins of its starts, each from what those before have reached.
    """
    return _islands(df.where(F.col(start) < F.col(end)).select(*keys, start, end), keys, start, end, bin_size)


def _binned(df: DataFrame, start: str, end: str, bin_size: int) -> DataFrame:
    first, last = F.floor(F.col(start) / bin_size).cast("long"), F.floor((F.col(end) - 1) / bin_size).cast("long")
    return df.where(F.col(start) < F.col(end)).withColumn("_first", first).withColumn("_bin", F.explode(F.sequence(first, last)))


def overlap_join(a: DataFrame, b: DataFrame, keys: Sequence[str], bin_size: int) -> DataFrame:
    """Pairs that share a base. ``a`` has start_a and end_a, ``b`` has start_b and end_b; keys have one name in both.

    Both sides are dealt to bins of ``bin_size``; a pair counts in the first bin that both reach.
    """
    left = _binned(a, "start_a", "end_a", bin_size).withColumnRenamed("_first", "_first_a")
    right = _binned(b, "start_b", "end_b", bin_size).withColumnRenamed("_first", "_first_b")
    met = left.join(right, [*keys, "_bin"])
    once = F.col("_bin") == F.greatest("_first_a", "_first_b")
    return met.where(once & (F.col("start_a") < F.col("end_b")) & (F.col("start_b") < F.col("end_a"))).drop("_bin", "_first_a", "_first_b")


def strictly_inside(a: DataFrame, b: DataFrame, keys: Sequence[str], bin_size: int) -> DataFrame:
    """Pairs where ``a`` lies inside ``b`` and touches neither end."""
    return overlap_join(a, b, keys, bin_size).where((F.col("start_a") > F.col("start_b")) & (F.col("end_a") < F.col("end_b")))


def points_within(points: DataFrame, regions: DataFrame, keys: Sequence[str], at: str, bin_size: int = 1 << 16) -> DataFrame:
    """Rows of ``points`` whose place ``at`` lies in some region (start, end) of their key."""
    merged = _binned(union(regions, keys), "start", "end", bin_size).select(*keys, "_bin", "start", "end")
    held = points.withColumn("_bin", F.floor(F.col(at) / bin_size).cast("long"))
    near = held.join(merged, [*keys, "_bin"], "inner")
    return near.where((F.col(at) >= F.col("start")) & (F.col(at) < F.col("end"))).drop("_bin", "start", "end")


def overlap_length(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return F.greatest(F.lit(0), F.least(e1, e2) - F.greatest(s1, s2))


def segments(df: DataFrame, keys: Sequence[str], tag: str, tags: Sequence[str], bin_size: int = BIN) -> DataFrame:
    """Break the line at every start and end; for each piece, how many intervals of each tag cover it.

    A running sum of +1 at starts and -1 at ends, in bins with the sums of those before; pieces that nothing covers are dropped.
    """
    edges = df.where("start < end").select(*keys, tag, F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("d")), F.struct(F.col("end").alias("at"), F.lit(-1).alias("d")))).alias("e"))
    steps = edges.groupBy(*keys, F.col("e.at").alias("start")).agg(*[F.sum(F.when(F.col(tag) == t, F.col("e.d")).otherwise(0)).alias(f"n_{t}") for t in tags])
    steps = steps.withColumn("_bin", F.floor(F.col("start") / bin_size).cast("long"))
    before = _carry(steps, keys, {f"_n_{t}": F.sum(f"n_{t}") for t in tags}, {f"_n_{t}": F.sum(f"_n_{t}") for t in tags})
    after = _carry(steps, keys, {"_next": F.min("start")}, {"_next": F.min("_next")}, backwards=True)
    line = Window.partitionBy(*keys, "_bin").orderBy("start")
    upto = line.rowsBetween(Window.unboundedPreceding, 0)
    held = steps.join(before.join(after, [*keys, "_bin"]), [*keys, "_bin"])
    out = held.select(
        *keys, "start", F.coalesce(F.lead("start").over(line), "_next").alias("end"), *[(F.sum(f"n_{t}").over(upto) + F.coalesce(f"_n_{t}", F.lit(0))).alias(f"n_{t}") for t in tags]
    )
    covered = sum((F.col(f"n_{t}") for t in tags), F.lit(0))
    return out.where(F.col("end").isNotNull() & (covered > 0))


def venn(segs: DataFrame, tags: Sequence[str]) -> DataFrame:
    """``combo, bases``: length covered by exactly each combination of tags."""
    combo = F.concat_ws("&", *[F.when(F.col(f"n_{t}") > 0, F.lit(t)) for t in tags])
    return segs.groupBy(combo.alias("combo")).agg(F.sum(F.col("end") - F.col("start")).alias("bases"))


def compare_tags(segs: DataFrame, tags: Sequence[str], truth: str) -> DataFrame:
    """``tag, total, miss, extra``: bases of each tag, those of ``truth`` that it lacks, and its own that ``truth`` lacks."""
    size, known = F.col("end") - F.col("start"), F.col(f"n_{truth}") > 0
    bases = lambda test: F.coalesce(F.sum(F.when(test, size)), F.lit(0))
    has = {t: F.col(f"n_{t}") > 0 for t in tags}
    rows = [F.struct(F.lit(t).alias("tag"), bases(has[t]).alias("total"), bases(known & ~has[t]).alias("miss"), bases(has[t] & ~known).alias("extra")) for t in tags]
    return segs.agg(F.array(*rows).alias("rows")).select(F.explode("rows").alias("r")).select("r.*")


def exclusive(segs: DataFrame, tags: Sequence[str], tag: str) -> DataFrame:
    """Pieces that intervals of ``tag`` alone cover."""
    others = sum((F.col(f"n_{t}") for t in tags if t != tag), F.lit(0))
    return segs.where((F.col(f"n_{tag}") > 0) & (others == 0))


def gap_to_next(df: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end") -> DataFrame:
    """Each interval with the distance to the next one of its key; negative where they overlap, null for the last."""
    line = Window.partitionBy(*keys).orderBy(start, end)
    return df.withColumn("gap", F.lead(start).over(line) - F.col(end))


def last_before(points: DataFrame, events: DataFrame, keys: Sequence[str], at: str, value: str, bin_size: int = BIN) -> DataFrame:
    """As-of lookup: for each point the ``value`` of its key's last event at or before it.

    One union and a window in bins of the line, each with the last value of those before; no range join.
    """
    return _as_of(points, events, keys, at, value, bin_size, False)


def first_after(points: DataFrame, events: DataFrame, keys: Sequence[str], at: str, value: str, bin_size: int = BIN) -> DataFrame:
    """As-of lookup forwards: for each point the ``value`` of its key's first event at or after it."""
    return _as_of(points, events, keys, at, value, bin_size, True)


def _number(df: DataFrame, at: str) -> Column:
    """A place as a number: seconds for dates and times."""
    timely = isinstance(df.schema[at].dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))
    return F.col(at).cast("timestamp").cast("double") if timely else F.col(at)


def _as_of(points: DataFrame, events: DataFrame, keys: Sequence[str], at: str, value: str, bin_size: int, forwards: bool) -> DataFrame:
    of_bin = F.floor(_number(points, at) / bin_size).cast("long")
    both = points.withColumn("_event", F.lit(1)).withColumn(value, F.lit(None).cast(events.schema[value].dataType)).unionByName(
        events.select(*keys, at, value).withColumn("_event", F.lit(0)), allowMissingColumns=True
    ).withColumn("_bin", of_bin)
    nearest = F.min_by if forwards else F.max_by
    told = both.where(F.col(value).isNotNull())
    # Bins of points without an event need their carry too: their place is null, and so is what they give.
    bins = told.select(*keys, "_bin", at, value).unionByName(points.select(*keys, of_bin.alias("_bin")).distinct(), allowMissingColumns=True)
    carry = _carry(bins, keys, {"_value": nearest(value, at)}, {"_value": F.last("_value", ignorenulls=True)}, backwards=forwards)
    line = Window.partitionBy(*keys, "_bin").orderBy(F.desc(at) if forwards else F.asc(at), "_event").rowsBetween(Window.unboundedPreceding, 0)
    here = both.withColumn(value, F.last(value, ignorenulls=True).over(line)).where("_event = 1").drop("_event")
    on = here["_bin"].eqNullSafe(carry["_bin"])
    for k in keys:
        on &= here[k].eqNullSafe(carry[k])
    named = [here[c] if c != value else F.coalesce(here[value], carry["_value"]).alias(value) for c in here.columns if c != "_bin"]
    return here.join(carry, on, "left").select(*named)


def key_edges(rows: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """Places where a new key begins, and the end."""
    new = np.zeros(max(rows.num_rows - 1, 0), bool)
    for c in keys:
        column = rows.column(c)
        new |= pc.not_equal(column.slice(1), column.slice(0, max(rows.num_rows - 1, 0))).to_numpy()
    return np.r_[0, np.flatnonzero(new) + 1, rows.num_rows]


def _merged(boxes: np.ndarray, dist: int) -> np.ndarray:
    """A key's boxes (x_start, x_end, y_start, y_end), merged to the fixpoint."""
    while len(boxes) > 1:
        x0, x1, y0, y1 = boxes.T
        near = (x1[:, None] + dist >= x0) & (x1 + dist >= x0[:, None]) & (y1[:, None] + dist >= y0) & (y1 + dist >= y0[:, None])
        label, n = np.full(len(boxes), -1), 0
        for i in range(len(boxes)):
            if label[i] < 0:
                label[i], open_ = n, [i]
                while open_:
                    fresh = np.flatnonzero(near[open_.pop()] & (label < 0))
                    label[fresh] = n
                    open_ += fresh.tolist()
                n += 1
        if n == len(boxes):
            break
        by = np.argsort(label, kind="stable")
        at = np.flatnonzero(np.r_[True, np.diff(label[by]) > 0])
        boxes = np.stack([f.reduceat(c[by], at) for f, c in zip((np.minimum, np.maximum) * 2, boxes.T)], axis=1)
    return boxes


def _merge_small(keys: Sequence[str], dist: int):
    sides = ["x_start", "x_end", "y_start", "y_end"]

    def merged(rows: pa.Table, edges: np.ndarray) -> pa.Table:
        boxes = np.stack([rows.column(c).to_numpy() for c in sides], axis=1)
        each = [_merged(boxes[a:b], dist) for a, b in zip(edges[:-1], edges[1:])]
        of = rows.select(keys).take(pa.array(np.repeat(edges[:-1], [len(e) for e in each])))
        for i, c in enumerate(sides):
            of = of.append_column(c, pa.array(np.concatenate([e[:, i] for e in each])).cast(rows.schema.field(c).type))
        return of

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches are sorted by key; the last key's rows wait for the next batch."""
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table]).combine_chunks()
            edges = key_edges(table, keys)
            rest = table.slice(edges[-2])
            if edges.size > 2:
                yield from merged(table.slice(0, edges[-2]), edges[:-1]).combine_chunks().to_batches()
        if rest is not None:
            yield from merged(rest, np.array([0, rest.num_rows])).combine_chunks().to_batches()

    return run


def merge_boxes(boxes: DataFrame, keys: Sequence[str], dist: int = 500, most_rounds: int = 50, one_line: Column | None = None, one_task: int = 1_000) -> DataFrame:
    """Bounding boxes of boxes within ``dist`` on both axes, to a fixpoint.

    Columns x_start, x_end, y_start, y_end. Boxes only grow, so the result does not depend on order. Boxes whose two sides are one
    interval go; ``one_line`` tells of a row's keys whether x and y count along one line, else all do. Keys of up to
    ``one_task`` boxes are merged each in a task, by one shuffle of the boxes; those of more by :func:`_merge_rounds`.
    """
    sides = ["x_start", "x_end", "y_start", "y_end"]
    off_diagonal = (F.col("x_start") != F.col("y_start")) | (F.col("x_end") != F.col("y_end"))
    if one_line is not None:
        off_diagonal = ~one_line | off_diagonal
    rows = boxes.where(off_diagonal).select(*keys, *sides)
    absent = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in [*keys, *sides]])
    # Keys with a null are no keys: their boxes meet none.
    large = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.max(absent).alias("absent")).where((F.col("n") > one_task) | F.col("absent")).select(*[F.col(c).alias(f"_{c}") for c in keys])
    large = stage(large, workdir(boxes.sparkSession), "large_keys")
    some = not large.isEmpty()
    on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys])
    small = rows.join(large, on, "left_anti") if some else rows
    found = small.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_merge_small(list(keys), dist), rows.schema).where(off_diagonal)
    return found.unionByName(_merge_rounds(rows.join(large, on, "left_semi"), keys, dist, most_rounds, off_diagonal)) if some else found


def _merge_rounds(boxes: DataFrame, keys: Sequence[str], dist: int, most_rounds: int, off_diagonal: Column) -> DataFrame:
    """``merge_boxes`` for keys of any number of boxes: each round takes the connected components of the proximity graph and their bounds.

    Boxes meet in the cells of grids: a box lies in the few cells of its own size's grid and, to meet larger boxes, in
    those of each wider grid that some box has; so a box costs a few rows a grid, however large it is.
    """
    spark, folder = boxes.sparkSession, workdir(boxes.sparkSession)
    sides = ["x_start", "x_end", "y_start", "y_end"]
    now = stage(boxes.select(*keys, *sides).distinct().withColumn("id", F.monotonically_increasing_id()), folder, "boxes_0")
    grid = max(1, 4 * dist)
    for i in range(1, most_rounds + 1):
        longest = F.greatest(F.col("x_end") - F.col("x_start"), F.col("y_end") - F.col("y_start"))
        own = now.withColumn("_own", F.ceil(F.greatest(F.log2(longest / grid), F.lit(0.0))).cast("int"))
        widths = [r._own for r in own.select("_own").distinct().collect()]  # powers of two: 64 at most
        width = F.lit(grid) * F.pow(F.lit(2), F.col("_grid")).cast("long")
        cells = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / width).cast("long"), F.floor((F.col(hi) + dist) / width).cast("long")))
        dealt = own.withColumn("_grid", F.explode(F.filter(F.lit(widths), lambda w: w >= F.col("_own"))))
        dealt = dealt.withColumn("_cx", cells("x_start", "x_end")).withColumn("_cy", cells("y_start", "y_end"))
        other = dealt.select(*keys, "_grid", "_cx", "_cy", *[F.col(c).alias(f"o_{c}") for c in ("id", "_own", *sides)])
        near = (
            (F.col("id") < F.col("o_id")) & ((F.col("_own") == F.col("_grid")) | (F.col("o__own") == F.col("_grid")))
            & (F.col("x_end") + dist >= F.col("o_x_start")) & (F.col("o_x_end") + dist >= F.col("x_start"))
            & (F.col("y_end") + dist >= F.col("o_y_start")) & (F.col("o_y_end") + dist >= F.col("y_start"))
        )
        edges = stage(dealt.join(other, [*keys, "_grid", "_cx", "_cy"]).where(near).select(F.col("id").alias("a"), F.col("o_id").alias("b")).distinct(), folder, f"near_{i}")
        if edges.isEmpty():
            break
        named = components(edges, folder, f"component_{i}")
        grouped = now.join(named, now.id == named.node, "left").withColumn("id", F.coalesce("component", "id"))
        now = stage(
            grouped.groupBy(*keys, "id").agg(F.min("x_start").alias("x_start"), F.max("x_end").alias("x_end"), F.min("y_start").alias("y_start"), F.max("y_end").alias("y_end")),
            folder, f"boxes_{i}",
        )
    else:
        raise RuntimeError("boxes did not settle")
    return now.where(off_diagonal).drop("id")
