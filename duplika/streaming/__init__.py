"""Streaming forms of operators: seed statistics kept up to date as sequences arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.seeds import minimizers


def seed_frequencies(seqs: DataFrame, k: int = 14, w: int = 16) -> DataFrame:
    """Streaming ``kmer, places``: how often each minimizer occurs in all sequences so far.

    ``seqs`` is a streaming table of species, chrom and seq; the sampling is stateless per row, the counts are
    keyed state without expiry. Write it in update or complete mode.
    """
    return minimizers(seqs, k, w).groupBy("kmer").agg(F.count("*").alias("places"))
