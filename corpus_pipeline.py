"""A corpus pipeline: language, exact copies, near copies, repeated passages, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and returns the columns of
``documents``; the last returns the packed pieces. Stages are written as Parquet and read again between.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from duplika.llm import exact_dedup, language_id, ngram_join, packing, substring_dedup
from duplika.llm.common import stage, table, workdir
from duplika.llm.queries import WORD_BPE


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or alike to no learned language, go.

    A null, empty or letterless text goes; with no labelled row each text with a letter stays; ties, repeated rows and
    rows with a null doc_id are judged apiece by their text; an empty table stays empty.
    """
    return language_id.keep_known(docs, language_id.train_profiles(docs))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays.

    Null counts as the empty text; of rows that share text and doc_id one stays; a null doc_id is smaller than any
    other; an empty table stays empty.
    """
    return exact_dedup.dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the smallest doc_id stays.

    Texts without words (null, empty, blanks) and rows with a null doc_id all stay; rows that share a doc_id go or stay
    together; an empty table stays empty.
    """
    return ngram_join.keep_one(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that an earlier document has go; the document stays, perhaps with an empty text.

    Null and short texts, and rows with a null doc_id, stay as they are; rows that share a doc_id are not each
    other's earlier document; an empty table stays empty.
    """
    return substring_dedup.remove_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens with their sequence and offset.

    A null or empty text is its end id alone; longer texts are cut; rows that share a doc_id, or have none, are packed
    apiece; an empty table gives no pieces.
    """
    return packing.packing_query(spark, docs, WORD_BPE)


STAGES = [
    ("language_id", language),
    ("exact_dedup", exact),
    ("ngram_join", near),
    ("substring_dedup", repeats),
    ("packing", pack),
]

#: The language stage and the packing cannot be put in SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), workdir(spark)
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), folder, name)
    return STAGES[-1][1](spark, docs, sf_dir)
