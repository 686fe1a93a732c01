"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

The plan is made over the histogram of piece lengths, at most ``capacity`` numbers whatever the
corpus: a configuration linear program (a variable for each multiset of lengths that fits one
sequence, a demand for each length) is solved by multiplicative weights. In each round a knapsack dynamic program prices
the fill of every room for the weights, a block of patterns worth nearly the best one is taken in an amount that covers
no length more than once, and each length's weight falls exponentially with the share of its demand that the block
covers. The weights over the price of the best pattern are a solution of the dual program; the best of all rounds bounds the
sequences from below, and the rounds end when the solution is within ``GAP`` of it, or after ``ROUNDS``. The blocks
together, scaled so that no length is covered beyond its demand, are the solution; what single lengths lack then is served
by patterns priced for the last weights. The solution is rounded down, and what that leaves is filled by the same pricing in
whole patterns. The work grows with the lengths and patterns, not with the pieces. The pieces then take their
places by rank within their length, without meeting in one task.

Cases: null text counts as empty and is packed as its end id alone; rows that share a doc_id are
packed separately; an empty table gives no rows; only pieces longer than the capacity are cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import schema, slices, stage, whole_text, workdir
from .tokens import crc32s, encoder

PIECES = schema("doc_id long, piece int, start long, length long, ids_crc32 long, chunk int, rank long")
PACKED = schema("doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")

Pattern = tuple[tuple[int, int], ...]  # (length, copies), longest first
#: Rounds at most, patterns of a round at most, the share of the best price that they are worth, the weights' rate, and the gap that ends the rounds.
ROUNDS, BLOCK, NEAR, RATE, GAP = 64, 48, 0.98, 0.15, 1e-4
#: Copies of a pattern of the rounds from which it is kept for the solution, so that rounding down loses little of it.
KEEP = 8
#: Times that fills of what lacks are priced anew, which is done when a fill leaves more than the capacity / ROOM and GONE lengths or more
#: were taken out since.
PRICES, ROOM, GONE = 64, 4096, 32

# --- the plan over the histogram ----------------------------------------------


class _Knapsack:
    """The worth of the best fill of every room up to ``cap`` by lengths with a ``value`` above 0, any copies."""

    def __init__(self, value: np.ndarray, cap: int):
        self.value, self.cap = value.copy(), cap
        self.price()

    def price(self) -> None:
        best, self.gone = np.zeros(self.cap + 1), 0
        held = np.flatnonzero(self.value > 0)
        if held.size <= 200:  # few lengths: look them up
            fit = np.searchsorted(held, np.arange(self.cap + 1), "right").tolist()
            worth = self.value[held]
            for c in range(int(held[0]) if held.size else self.cap + 1, self.cap + 1):
                k = fit[c]
                best[c] = max(best[c - 1], (worth[:k] + best[c - held[:k]]).max())
        else:
            back = self.value[::-1].copy()
            for c in range(1, self.cap + 1):
                best[c] = max(best[c - 1], (back[self.cap - c : self.cap] + best[:c]).max())
        self.best = best

    def filled(self, n: int) -> Pattern:
        """A pattern that holds length n and the best fill of the rest."""
        pattern, room = {n: 1}, self.cap - n
        while k := self.pick(room):
            pattern[k] = pattern.get(k, 0) + 1
            room -= k
        return tuple(sorted(pattern.items(), reverse=True))

    def take_out(self, n: int) -> None:
        self.value[n] = -1.0
        self.gone += 1

    def pick(self, room: int) -> int:
        """The longest length that a best fill of a room has, among those not taken out; 0 if none fits."""
        if room <= 0:
            return 0
        worth = self.value[room:0:-1] + self.best[:room]
        n = room - int((worth >= worth.max() - 1e-9).argmax())
        return n if self.value[n] > 0 else 0


def _serve(lengths: list[int], lack: np.ndarray, knapsack: _Knapsack, whole: bool, prices: int) -> Iterator[tuple[Pattern, float]]:
    """Patterns that give each of the lengths what it lacks, from ``lack`` of all lengths; ``whole`` ones in whole numbers.

    Fills are priced anew, ``prices`` times at most, when one leaves room after lengths were taken out.
    """
    cap, value, least = knapsack.cap, knapsack.value, 1 if whole else 1e-9

    def built(n: int) -> tuple[dict[int, int], int]:
        pattern, room, hidden = {n: 1}, cap - n, {}
        if whole and lack[n] < 2:
            hidden[n], value[n] = value[n], -1.0
        while k := knapsack.pick(room):
            pattern[k] = pattern.get(k, 0) + 1
            room -= k
            if whole and lack[k] < pattern[k] + 1:
                hidden[k], value[k] = value[k], -1.0
        for k, w in hidden.items():
            value[k] = w
        return pattern, room

    for n in lengths:
        while lack[n] >= least:
            pattern, room = built(n)
            if room * ROOM > cap and knapsack.gone >= GONE and prices > 0:
                prices -= 1
                knapsack.price()
                pattern, room = built(n)
            times = min(lack[k] / a for k, a in pattern.items())
            times = int(times) if whole else times
            for k, a in pattern.items():
                lack[k] -= a * times
                if lack[k] < least:
                    lack[k] = 0
                    knapsack.take_out(k)
            yield tuple(sorted(pattern.items(), reverse=True)), times


def weigh(count: np.ndarray, cap: int, rounds: int = ROUNDS, block: int = BLOCK, rate: float = RATE, gap: float = GAP) -> tuple[dict[Pattern, float], np.ndarray, float]:
    """Multiplicative weights: patterns with multiplicities that cover no length beyond ``count``, the last weights, the best bound."""
    held = np.flatnonzero(count)
    weights = np.where(count > 0, np.arange(cap + 1) / cap, -1.0)
    taken: dict[Pattern, float] = {}
    covered, bound = np.zeros(cap + 1), 0.0
    for _ in range(rounds if held.size else 0):
        knapsack = _Knapsack(weights, cap)
        top = float(knapsack.best[cap])
        bound = max(bound, float(count[held] @ weights[held]) / top)
        if covered.any():
            share = covered[held] / count[held]
            if sum(taken.values()) / max(share.min(), 1e-12) <= bound * (1 + gap):
                break
        worth = weights[held] + knapsack.best[cap - held]
        near = held[worth >= NEAR * worth.max()]
        # Those that are least covered so far, each with the best fill beside it.
        chosen = {knapsack.filled(int(n)) for n in near[np.argsort(covered[near] / count[near], kind="stable")[:block]]}
        chosen.add(knapsack.filled(int(held[worth.argmax()])))
        gives, times = np.zeros(cap + 1), {}
        for pattern in sorted(chosen):
            times[pattern] = min(count[n] / a for n, a in pattern)
            for n, a in pattern:
                gives[n] += a * times[pattern]
        width = float((gives[held] / count[held]).max())
        for pattern, x in times.items():
            taken[pattern] = taken.get(pattern, 0.0) + x / width
        gives /= width
        covered += gives
        weights[held] *= np.exp(-rate * gives[held] / count[held])
        weights[held] /= weights[held].max()
    most = float((covered[held] / count[held]).max()) if held.size else 1.0
    return {p: x / most for p, x in taken.items()}, weights, bound


def _rest(count: np.ndarray, cap: int, kept: dict[Pattern, float], weights: np.ndarray, prices: int) -> dict[Pattern, float]:
    """``kept`` with patterns, priced for the weights, that serve what lengths lack."""
    lack, out = count.astype(float), dict(kept)
    for pattern, x in kept.items():
        for n, a in pattern:
            lack[n] -= a * x
    lack[lack < 1e-9 * np.maximum(count, 1)] = 0
    knapsack = _Knapsack(np.where(lack > 0, weights, -1.0), cap)
    for pattern, x in _serve(np.flatnonzero(lack)[::-1].tolist(), lack, knapsack, False, prices):
        out[pattern] = out.get(pattern, 0.0) + x
    return out


def solve(count: np.ndarray, cap: int, prices: int = PRICES, **rounds) -> tuple[dict[Pattern, float], float]:
    """Fractional pattern multiplicities that give ``count[length]`` pieces of every length a place, and a bound from below.

    The bound is the best of the rounds', that of the lengths' sum, and that of 1 for each piece above half the capacity and a half for one of just half.
    """
    taken, weights, bound = weigh(count, cap, **rounds)
    size = np.arange(cap + 1) / cap
    bound = max(bound, float(count @ size), float(count[cap // 2 + 1 :].sum()) + (0.5 * float(count[cap // 2]) if cap % 2 == 0 else 0.0))
    tries = [_rest(count, cap, kept, w, prices) for kept, w in (({p: x for p, x in taken.items() if x >= KEEP}, weights), (taken, weights), ({}, size))]
    return min(tries, key=lambda x: round(sum(x.values()), 6)), bound


def plan(count: np.ndarray, cap: int) -> list[tuple[Pattern, int]]:
    """Patterns and whole multiplicities that place each of ``count[length]`` pieces once."""
    out: dict[Pattern, int] = {}
    left = count.astype(np.int64).copy()
    if left.any():
        for key, x in solve(count, cap)[0].items():
            if times := int(x + 1e-6):
                out[key] = times
                for k, a in key:
                    left[k] -= a * times
    knapsack = _Knapsack(np.where(left > 0, np.arange(cap + 1) / cap, -1.0), cap)
    for key, times in _serve(np.flatnonzero(left)[::-1].tolist(), left, knapsack, True, PRICES):
        out[key] = out.get(key, 0) + times
    return sorted(out.items())


def slots(planned: list[tuple[Pattern, int]], cap: int) -> dict[str, np.ndarray]:
    """For each length, in order of rank: rank of the first piece, its sequence and its offset.

    Piece number r of a length sits in the slot with the last ``first <= r``, in sequence
    ``sequence + (r - first)``, at ``offset``. Sorted by (length, first).
    """
    taken = np.zeros(cap + 1, np.int64)
    rows, base = [], 0
    for pattern, times in planned:
        at = 0
        for n, copies in pattern:
            for _ in range(copies):
                rows.append((n, taken[n], base, at))
                taken[n] += times
                at += n
        base += times
    table = np.array(rows, np.int64).reshape(-1, 4)
    table = table[np.lexsort((table[:, 1], table[:, 0]))]
    return {k: table[:, i].copy() for i, k in enumerate(("length", "first", "sequence", "offset"))}


# --- pieces and places ----------------------------------------------------------


def _grouped_rank(values: np.ndarray) -> np.ndarray:
    """Number of earlier equal values, for each value."""
    order = np.argsort(values, kind="stable")
    held = values[order]
    first = np.flatnonzero(np.r_[True, held[1:] != held[:-1]]) if held.size else np.zeros(0, np.int64)
    run = np.diff(np.r_[first, held.size])
    out = np.empty(values.size, np.int64)
    out[order] = np.arange(held.size) - np.repeat(first, run)
    return out


def _cut(path: str, end_id: int, cap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, seen = TaskContext.get().partitionId(), np.zeros(cap + 1, np.int64)
        for batch in slices(batches, limit=2 << 20):
            ids, offsets = encoder(path).encode(batch.column("text"), end_id)
            n = np.diff(offsets)
            pieces = -(-n // cap)
            row = np.repeat(np.arange(n.size), pieces)
            piece = np.arange(row.size) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = piece * cap
            length = np.minimum(cap, n[row] - start)
            crc = crc32s(ids, np.r_[offsets[row] + start, offsets[-1]])
            rank = seen[length] + _grouped_rank(length)
            seen += np.bincount(length, minlength=cap + 1)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(row)),
                    pa.array(piece.astype(np.int32)),
                    pa.array(start),
                    pa.array(length),
                    pa.array(crc),
                    pa.array(np.full(row.size, chunk, np.int32)),
                    pa.array(rank),
                ],
                PIECES.names,
            )

    return run


def _place(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot = held.value
        edge = np.searchsorted(slot["length"], np.arange(int(slot["length"][-1]) + 2)) if slot["length"].size else None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy() + batch.column("base").to_numpy()
            order = np.argsort(length, kind="stable")
            at = np.empty(length.size, np.int64)
            for rows in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
                a, b = edge[length[rows[0]]], edge[length[rows[0]] + 1]
                at[rows] = a + np.searchsorted(slot["first"][a:b], rank[rows], "right") - 1
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in PACKED.names[:5]),
                    pa.array(slot["sequence"][at] + rank - slot["first"][at]),
                    pa.array(slot["offset"][at]),
                ],
                PACKED.names,
            )

    return run


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """Each piece of each document with its sequence and its offset there.

    The ids of a piece are ``ids[start : start + length]`` of the document's ids.
    """
    spark = docs.sparkSession
    cut = whole_text(docs).mapInArrow(_cut(tokenizer_path, end_id, capacity), PIECES)
    pieces = stage(cut, workdir(spark), "pieces")
    per_chunk = pieces.groupBy("chunk", "length").agg(F.count("*").alias("n"))
    count = np.zeros(capacity + 1, np.int64)
    for r in per_chunk.groupBy("length").agg(F.sum("n").alias("n")).collect():  # a row a length: capacity rows at most
        count[r["length"]] = r["n"]
    held = spark.sparkContext.broadcast(slots(plan(count, capacity), capacity))
    before = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = per_chunk.select("chunk", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return pieces.join(base, ["chunk", "length"]).mapInArrow(_place(held), PACKED)


def packing_query(spark: SparkSession, docs: DataFrame, tokenizer_path: str) -> DataFrame:
    return pack(docs, tokenizer_path, capacity=4096, end_id=1)
