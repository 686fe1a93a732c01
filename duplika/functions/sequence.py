"""Column functions over nucleotide sequences."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_BASES = "ACGTACGTACGTACGTACGTACGTAC"


def text_to_sequence(text: Column) -> Column:
    """A deterministic nucleotide view of any text: letters become bases, other signs go."""
    return F.regexp_replace(F.translate(F.lower(text), _LETTERS, _BASES), "[^ACGT]", "")


def sequence_view(docs: DataFrame) -> DataFrame:
    """``species, chrom, seq`` from a document table."""
    return docs.select(
        F.col("source").alias("species"),
        F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("chrom"),
        text_to_sequence(F.coalesce("text", F.lit(""))).alias("seq"),
    )


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGTacgt", "TGCAtgca"))


def mask_compact(seq: Column) -> Column:
    """Soft-masked (lower-case) bases are cut out and the rest is joined; an upper-case N stays."""
    return F.regexp_replace(seq, "[^A-Z]", "")


def mask_compact_bases(seq: Column) -> Column:
    """As ``mask_compact``, but only A, C, G and T stay."""
    return F.regexp_replace(seq, "[^ACGT]", "")


def valid_contig(chrom: Column) -> Column:
    """Main contigs: no underscore in the name, and not the mitochondrion."""
    return ~chrom.contains("_") & (chrom != "chrM")


def species_name(path: Column) -> Column:
    """File name without its last extension and without ``#``."""
    return F.replace(F.regexp_extract(path, r"([^/]+)\.[^./]*$", 1), F.lit("#"), F.lit(""))


def to_forward(start: Column, end: Column, length: Column) -> tuple[Column, Column]:
    """A half-open interval of the reverse strand in forward coordinates."""
    return length - end, length - start


def tile_starts(length: Column, size: int, overlap: int) -> Column:
    """Array of (start, tile_len) structs that cover ``length`` bases, each ``overlap`` beyond its tile."""
    starts = F.when(length > 0, F.sequence(F.lit(0).cast("long"), length - 1, F.lit(size).cast("long")))
    return F.transform(starts, lambda s: F.struct(s.alias("start"), F.least(F.lit(size + overlap).cast("long"), length - s).alias("tile_len")))


def seed_density(max_error: float = 0.30, max_edit_error: float = 0.15, k: int = 14) -> float:
    """Least share of seeds on a true hit: edits spare a seed with exp(-k e), gaps thin them out."""
    gap = min(1.0, max_error - max_edit_error)
    return (1 - gap) / (1 + gap) / (2 * math.exp(k * max_edit_error) - 1)


def pad_and_clip(b1: Column, e1: Column, b2: Column, e2: Column, len1: Column, len2: Column, same: Column, pad: int = 5000) -> tuple[Column, ...]:
    """Grow a pair of intervals by ``pad`` within [0, len - 1]; on one chromosome they don't cross."""
    zero = F.lit(0).cast("long")
    start1, far1 = F.greatest(zero, b1 - pad), F.least(len1 - 1, e1 + pad)
    end1 = F.when(same, F.least(far1, b2)).otherwise(far1)
    near2 = F.greatest(zero, b2 - pad)
    start2 = F.when(same, F.greatest(near2, end1)).otherwise(near2)
    return start1, end1, start2, F.least(len2 - 1, e2 + pad)
