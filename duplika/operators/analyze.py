"""Measures of aligned pairs over soft-masked sequences: a CIGAR over the unmasked bases is led along both whole ones.

Masked letters (lower-case bases and N) are gaps on their side, written ``N`` for the first sequence and ``S`` for the
second, before the column whose base they precede. ``D`` takes a base of the first sequence, ``I`` one of the second.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .evaluate import jukes_cantor, kimura

_MASKED = np.zeros(256, bool)
_MASKED[list(b"acgtNn")] = True
_KIND = np.full(256, -1, np.int8)  # purines 0, pyrimidines 1
_KIND[list(b"AG")], _KIND[list(b"CT")] = 0, 1
_SIGNS = np.array(list("NSMDI"))
_OP = re.compile(r"(\d+)([=XMDI])")
_COUNTS = (
    "match_columns", "deleted", "inserted", "masked_a", "masked_b", "matches", "transitions", "transversions",
)


def walk(a: bytes, b: bytes, cigar: str) -> tuple[list[int], str] | None:
    """Counts in the order of ``_COUNTS`` and the CIGAR with masked gaps; None unless it takes up both sequences.

    Masked bases after the last column are not taken up by any.
    """
    if _OP.sub("", cigar):
        return None
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    at_x, at_y = np.flatnonzero(~_MASKED[x]), np.flatnonzero(~_MASKED[y])
    parts = _OP.findall(cigar)
    lengths = np.array([int(n) for n, _ in parts], np.int64)
    wanted = {o: sum(n for n, (_, q) in zip(lengths.tolist(), parts) if q in o) for o in ("=XMD", "=XMI")}
    if (wanted["=XMD"], wanted["=XMI"]) != (at_x.size, at_y.size):
        return None
    if (x.size and (not at_x.size or at_x[-1] != x.size - 1)) or (y.size and (not at_y.size or at_y[-1] != y.size - 1)):
        return None
    kinds = np.repeat(np.array([{"D": 3, "I": 4}.get(o, 2) for _, o in parts], np.int8), lengths)
    in_x, in_y = kinds != 4, kinds != 3
    ahead = np.zeros((kinds.size, 3), np.int64)  # masked bases of either side, and the column itself
    ahead[in_x, 0] = np.diff(at_x, prepend=-1) - 1
    ahead[in_y, 1] = np.diff(at_y, prepend=-1) - 1
    ahead[:, 2] = 1
    signs = np.tile(np.array([0, 1, 2], np.int8), (kinds.size, 1))
    signs[:, 2] = kinds
    n, sign = ahead.ravel(), signs.ravel()
    n, sign = n[n > 0], sign[n > 0]
    heads = np.flatnonzero(np.diff(sign, prepend=-1))
    runs = np.add.reduceat(n, heads) if heads.size else n
    text = "".join(f"{k}{s}" for k, s in zip(runs.tolist(), _SIGNS[sign[heads]].tolist()))
    met = kinds == 2
    place_x, place_y = np.cumsum(in_x) - 1, np.cumsum(in_y) - 1
    p, q = x[at_x[place_x[met]]], y[at_y[place_y[met]]]
    known = (p != q) & (_KIND[p] >= 0)  # a changed base of the first sequence other than ACGT is neither
    same_kind = _KIND[p] == _KIND[q]
    counts = [
        int(met.sum()), int((kinds == 3).sum()), int((kinds == 4).sum()), x.size - at_x.size, y.size - at_y.size,
        int((p == q).sum()), int((known & same_kind).sum()), int((known & ~same_kind).sum()),
    ]
    return counts, text


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for a, b, c in zip(batch.column("a"), batch.column("b"), batch.column("cigar"), strict=True):
            whole = a.is_valid and b.is_valid and c.is_valid
            # One byte a letter: a letter beyond ASCII is a base unlike any other sign, "?".
            got = walk(a.as_py().encode("ascii", "replace"), b.as_py().encode("ascii", "replace"), c.as_py()) if whole else None
            out.append((*got[0], got[1]) if got else (None,) * (len(_COUNTS) + 1))
        columns = [pa.array([o[i] for o in out], pa.int64()) for i in range(len(_COUNTS))]
        columns.append(pa.array([o[-1] for o in out], pa.string()))
        yield pa.RecordBatch.from_arrays([batch.column("id"), *columns], ["id", *_COUNTS, "masked_cigar"])


def _share(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double"), whole.cast("double"))


def analyze(pairs: DataFrame) -> DataFrame:
    """All measures of aligned pairs (id, a, b, cigar), a row a pair.

    A pair whose CIGAR does not take up both sequences, and one with a null, has null measures. A ratio over nothing is null.
    Masked bases within a gap count once each.
    """
    kinds = f"id {pairs.schema['id'].dataType.simpleString()}, {', '.join(f'{c} long' for c in _COUNTS)}, masked_cigar string"
    walked = pairs.select("id", "a", "b", "cigar").mapInArrow(_walked, kinds)
    m, d, i, mask_a, mask_b, same = (F.col(c) for c in ("match_columns", "deleted", "inserted", "masked_a", "masked_b", "matches"))
    changed, gaps = m - same, d + i + mask_a + mask_b
    upper_b = m + i
    every = gaps + m
    p, q = _share(F.col("transitions"), upper_b), _share(F.col("transversions"), upper_b)
    return walked.select(
        "id", _share(changed + gaps, every).alias("error"), F.greatest(m + d + mask_a, m + i + mask_b).alias("span"), every.alias("columns"),
        F.round(100 * _share(changed, every), 1).alias("mismatch_percent"), F.round(100 * _share(gaps, every), 1).alias("gap_percent"),
        (d + mask_a).alias("indel_a"), (i + mask_b).alias("indel_b"), m.alias("aligned"), "matches", changed.alias("mismatches"), "transitions",
        "transversions", _share(same, m).alias("match_share"), _share(same, every).alias("match_share_all"),
        jukes_cantor(_share(changed, upper_b)).alias("jukes_cantor"), kimura(p, q).alias("kimura"), gaps.alias("gaps"), (m + d).alias("upper_a"),
        upper_b.alias("upper_b"), m.alias("upper_columns"), "masked_cigar", (1 - _share(gaps + changed, gaps + m)).alias("identity"),
    )


def overlapping(start_a: Column, end_a: Column, start_b: Column, end_b: Column, same_sequence: Column, least: int = 100) -> Column:
    """Whether two copies on one sequence and strand have fewer than ``least`` bases apart from those they share."""
    shared = F.when(same_sequence, F.greatest(F.lit(0), F.least(end_a, end_b) - F.greatest(start_a, start_b))).otherwise(0)
    return same_sequence & ((end_a - start_a - shared < least) | (end_b - start_b - shared < least))
