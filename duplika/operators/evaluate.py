"""Measures on results: divergence, set distance, detection rates, core recall; and a seeded simulator."""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..staging import stage, workdir
from .intervals import overlap_join, overlap_length, union


_BASE = np.full(128, 4, np.uint8)
_BASE[list(b"ACGT")] = range(4)
_EITHER = _BASE.copy()
_EITHER[list(b"acgt")] = range(4)


def _bases(text: str, table: np.ndarray) -> np.ndarray:
    """0 to 3 for ACGT, 4 for any other character."""
    return table[np.minimum(np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32), 127)]


def _letter_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: list[list[int | None]] = []
        for a, b in zip(batch.column("a"), batch.column("b"), strict=True):
            if not (a.is_valid and b.is_valid):
                counts.append([None] * 3)
                continue
            x, y = _bases(a.as_py(), _EITHER), _bases(b.as_py(), _BASE)
            n = min(x.size, y.size)
            met = np.bincount(x[:n] * 5 + y[:n], minlength=25).reshape(5, 5)[:4, :4]
            counts.append([int(met.sum()), int(met.trace()), int(met[0, 2] + met[2, 0] + met[1, 3] + met[3, 1])])
        columns = [pa.array([c[i] for c in counts], pa.int64()) for i in range(3)]
        yield pa.RecordBatch.from_arrays([batch.column("id"), *columns], ["id", "n_bases", "matches", "transitions"])


def divergence(pairs: DataFrame) -> DataFrame:
    """For equal-length aligned rows (id, a, b): matches, mismatches, transitions, transversions, K by Jukes-Cantor and Kimura.

    Gap signs and soft-masked bases of ``b`` are not counted; a null row has null counts.
    """
    kinds = f"id {pairs.schema['id'].dataType.simpleString()}, n_bases long, matches long, transitions long"
    counted = pairs.select("id", "a", "b").mapInArrow(_letter_pairs, kinds)
    mis = F.col("n_bases") - F.col("matches")
    counted = counted.withColumn("mismatches", mis).withColumn("transversions", mis - F.col("transitions"))
    p, q = F.try_divide("transitions", "n_bases"), F.try_divide("transversions", "n_bases")
    return counted.select(
        "id", "n_bases", "matches", "mismatches", "transitions", "transversions",
        F.round(jukes_cantor(p + q), 6).alias("jukes_cantor"), F.round(kimura(p, q), 6).alias("kimura"),
    )


def _log(x: Column) -> Column:
    return F.when(x > 0, F.log(x))


def jukes_cantor(p: Column) -> Column:
    return F.lit(-0.75) * _log(1 - 4 * p / 3)


def kimura(transitions: Column, transversions: Column) -> Column:
    return -0.5 * _log(1 - 2 * transitions - transversions) - 0.25 * _log(1 - 2 * transversions)


def set_distance(members: DataFrame, group: str, item: str) -> DataFrame:
    """``i, j, distance`` for i < j: 1 - size(i minus j) / size(i or j); only distances other than 1."""
    # Items are counted by the set of groups that hold them: a pair of groups is met once a set, not once an item.
    # A null counts in a group's size and is shared with none.
    of_item = members.select(F.col(group).alias("g"), F.col(item).alias("item")).groupBy("item").agg(F.array_sort(F.collect_set("g")).alias("sets"))
    held = stage(of_item.groupBy("sets", F.col("item").isNull().alias("absent")).agg(F.count("*").alias("m")), workdir(members.sparkSession), "sets")
    size = held.select(F.explode("sets").alias("g"), "m").groupBy("g").agg(F.sum("m").alias("n"))
    first = held.where("not absent").select("sets", "m", F.posexplode("sets").alias("at", "i")).select("i", "m", F.explode(F.slice("sets", F.col("at") + 2, F.size("sets"))).alias("j"))
    shared = first.groupBy("i", "j").agg(F.sum("m").alias("both"))
    n_i, n_j = size.select(F.col("g").alias("i"), F.col("n").alias("n_i")), size.select(F.col("g").alias("j"), F.col("n").alias("n_j"))
    every = n_i.join(n_j, F.col("i") < F.col("j")).join(shared, ["i", "j"], "left").na.fill(0, ["both"])
    distance = 1 - (F.col("n_i") - F.col("both")) / (F.col("n_i") + F.col("n_j") - F.col("both"))
    return every.select("i", "j", F.round(distance, 6).alias("distance")).where("distance <> 1")


def detection_histogram(truth: DataFrame, found: DataFrame, threshold: float = 0.9, bin_size: int = 1 << 16) -> DataFrame:
    """``error, hits``: how many true pairs of each error level are covered beyond ``threshold`` by merged finds.

    ``truth``: pair_id, error, chrom, start, end, a row a side. ``found``: chrom, start, end.
    """
    merged = union(found, ["chrom"]).select("chrom", F.col("start").alias("start_b"), F.col("end").alias("end_b"))
    sides = truth.select("pair_id", "error", "chrom", F.col("start").alias("start_a"), F.col("end").alias("end_a"))
    met = overlap_join(sides, merged, ["chrom"], bin_size)
    covered = met.groupBy("pair_id").agg(F.sum(overlap_length(F.col("start_a"), F.col("end_a"), F.col("start_b"), F.col("end_b"))).alias("covered"))
    size = truth.groupBy("pair_id", "error").agg(F.sum(F.col("end") - F.col("start")).alias("size"))
    ok = size.join(covered, "pair_id", "left").withColumn("hit", F.coalesce(F.col("covered") / F.col("size") > threshold, F.lit(False)))
    return ok.groupBy("error").agg(F.sum(F.col("hit").cast("long")).alias("hits"))


def core_recall(cores: DataFrame, elements: DataFrame, pairs: DataFrame, share: float = 0.9, bin_size: int = 1 << 16) -> DataFrame:
    """One row of counts. ``cores``: core_id, copy_id, chrom, start, end. ``elements`` and ``pairs`` (sides): chrom, start, end (, core)."""
    copies = cores.select("core_id", "copy_id", "chrom", F.col("start").alias("start_a"), F.col("end").alias("end_a"))
    rename = lambda df: df.select("chrom", F.col("start").alias("start_b"), F.col("end").alias("end_b"), *[c for c in df.columns if c == "core"])
    bases = F.sum(overlap_length(F.col("start_a"), F.col("end_a"), F.col("start_b"), F.col("end_b")))
    by_elem = overlap_join(copies, rename(union(elements, ["chrom"])), ["chrom"], bin_size).groupBy("core_id", "copy_id").agg(bases.alias("covered"))
    flagged = overlap_join(copies, rename(elements.where("core = 'CORE'")), ["chrom"], bin_size).groupBy("core_id").agg(F.lit(1).alias("flagged"))
    in_pair = overlap_join(copies, rename(pairs), ["chrom"], bin_size).where("start_a >= start_b and end_a <= end_b").groupBy("core_id").agg(F.lit(1).alias("contained"))
    each = copies.withColumn("size", F.col("end_a") - F.col("start_a")).join(by_elem, ["core_id", "copy_id"], "left").na.fill(0, ["covered"])
    core = each.groupBy("core_id").agg(
        F.sum(F.when(F.col("covered") >= share * F.col("size"), 1).otherwise(0)).alias("good"), F.count("*").alias("copies"),
        F.sum("covered").alias("covered"), F.sum("size").alias("size"),
    ).join(flagged, "core_id", "left").join(in_pair, "core_id", "left")
    return core.agg(
        F.sum("good").alias("covered_copies"), F.sum("copies").alias("all_copies"), F.sum((F.col("good") > 0).cast("long")).alias("cores_hit"),
        F.sum((F.col("covered") >= share * F.col("size")).cast("long")).alias("cores_covered"), F.count("*").alias("cores"),
        F.sum(F.coalesce("flagged", F.lit(0))).alias("cores_flagged"), F.sum(F.coalesce("contained", F.lit(0))).alias("cores_in_pairs"),
    )


def roll_up(stats: DataFrame, by: list[str]) -> DataFrame:
    """Summed counts of repeated simulations."""
    return stats.groupBy(*by).agg(*[F.sum(c).alias(c) for c, t in stats.dtypes if c not in by and t != "string"])


# --- simulator (driver-side fixtures) ------------------------------------------------


def random_sequence(n: int, rng: random.Random) -> str:
    return "".join(rng.choices("ACGT", k=n))


def mutate(seq: str, substitution: float, indel: float, rng: random.Random, chunk: int = 30) -> str:
    """A copy with about these shares of changed bases and of bases in inserted or deleted chunks."""
    out = [rng.choice([b for b in "ACGT" if b != c]) if rng.random() < substitution else c for c in seq]
    budget = int(indel * len(seq))
    while budget > 0 and out:
        n = min(budget, rng.randint(1, chunk))
        at = rng.randrange(len(out))
        if rng.random() < 0.5:
            del out[at : at + n]
        else:
            out[at:at] = rng.choices("ACGT", k=n)
        budget -= n
    return "".join(out)


def simulate_duplications(n: int, error: float, rng: random.Random, low: int = 1000, high: int = 5000, spacer: int = 2000) -> tuple[str, list[tuple[int, int, int, int]]]:
    """A sequence with n originals and their mutated copies, and the true places."""
    parts, truth, at = [], [], 0
    for _ in range(n):
        a = random_sequence(rng.randint(low, high), rng)
        b = mutate(a, error / 2, error / 2, rng)
        gap1, gap2 = random_sequence(spacer, rng), random_sequence(spacer, rng)
        truth.append((at, at + len(a), at + len(a) + spacer, at + len(a) + spacer + len(b)))
        parts += [a, gap1, b, gap2]
        at += len(a) + len(b) + 2 * spacer
    return "".join(parts), truth
