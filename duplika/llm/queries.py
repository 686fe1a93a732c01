"""The queries ``op1_…`` to ``op13_…`` and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe
from .ann import ann_query
from .common import table
from .exact_dedup import dedup_query
from .language_id import language_query
from .licenses import scan, scan_sql
from .ngram_join import ngram_join_query
from .packing import packing_query
from .prefix_trie import TRIE_SQL, trie_query
from .rope_fim import FIM_SQL, fim_query
from .substring_dedup import substring_query
from .token_store import token_store_query
from .toxicity import toxicity_query
from .warc import WARC_SQL, warc_query

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store_query(spark, table(spark, sf_dir, "documents"), WORD_BPE, end_id=2)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_query(table(spark, sf_dir, "documents"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join_query(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing_query(spark, table(spark, sf_dir, "documents"), WORD_BPE)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), BYTE_BPE, public_tokenizers.PATTERN)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_query(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_query(table(spark, sf_dir, "documents"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann_query(table(spark, sf_dir, "embeddings"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim_query(table(spark, sf_dir, "documents"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_query(spark, table(spark, sf_dir, "pages"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_query(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_store": op1_token_store,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_ngram_join": op3_ngram_join,
    "op4_packing": op4_packing,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_toxicity": op7_toxicity,
    "op8_language_id": op8_language_id,
    "op9_license_scan": op9_license_scan,
    "op10_ann": op10_ann,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_warc": op12_warc,
    "op13_prefix_trie": op13_prefix_trie,
}

_OP2_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))"""

_OP3_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(ws[i + 1:i + 5], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(greatest(len(ws) - 4, (len(ws) > 0)::INT))) AS i FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * m >= 75 * (x.n + y.n - m)),
sym AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, e.b FROM reach r JOIN sym e ON r.b = e.a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, min(b) AS component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN reach ON a = d.doc_id GROUP BY 1, 2"""

_OP6_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
v AS (SELECT doc_id, i, md5(array_to_string(ws[i + 1:i + 50], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(len(ws) - 49)) AS i FROM w)),
f AS (SELECT h, min(doc_id) AS first FROM v GROUP BY h),
gone AS (SELECT DISTINCT doc_id, i + j AS i FROM (SELECT v.doc_id, i, unnest(range(50)) AS j FROM v JOIN f USING (h) WHERE first < doc_id)),
each AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t, count(*) AS n FROM each ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT w.doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)"""

ORACLE_SQL: dict[str, str] = {
    "op2_exact_dedup": _OP2_SQL,
    "op3_ngram_join": _OP3_SQL,
    "op6_substring_dedup": _OP6_SQL,
    "op9_license_scan": scan_sql(),
    "op11_fill_in_middle": FIM_SQL,
    "op12_warc": WARC_SQL,
    "op13_prefix_trie": TRIE_SQL,
}
