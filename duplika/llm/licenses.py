"""License scans by canonical digest lookup.

A text is brought to a canonical form: ASCII lower case, copyright statements dropped (lines that name a sign or a
year, or reserve all rights), punctuation and white space to single blanks, equivalent spellings to one. The SHA-256
digest of the whole form is hash-joined with the table of the digests of the known licence texts; lines are
looked up in the same way, each as an entire text, for notices that stand alone on a line. Only lines whose form has
the length of a known one are digested.

Cases: null counts as empty; a form without a sign (empty text, copyright lines alone) matches nothing;
repeated rows are scanned apiece; of two known texts with one digest, the name that sorts first counts;
columns besides doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import whole_text
from .license_texts import DIGESTS, KNOWN, SPELLINGS

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _any_case(words: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in words)


# "(c)" in small letters may also number a clause, so there it takes a year.
_STATEMENT = rf"{_any_case('copyright')}[ \t:]*(\([cC]\)|©|[\[<{{][yY]|[0-9])|\(C\)|\(c\)[ \t]*[0-9]|©|{_any_case('all rights reserved')}"
_COPYRIGHT_LINE = rf"(^|\n)[ \t*#/;-]*({_STATEMENT})[^\n]*"
_SIGNS = r"[^a-z0-9\x{80}-\x{10FFFF}]+"


def canonical(text: Column) -> Column:
    low = F.translate(F.regexp_replace(text, _COPYRIGHT_LINE, r"$1"), _UPPER, _LOWER)
    plain = F.regexp_replace(low, _SIGNS, " ")
    return reduce(lambda c, s: F.replace(c, F.lit(s[0]), F.lit(s[1])), SPELLINGS, F.trim(plain))


def canonical_sql(text: str) -> str:
    """The same form as DuckDB SQL."""
    out = f"translate(regexp_replace({text}, '{_COPYRIGHT_LINE}', '\\1', 'g'), '{_UPPER}', '{_LOWER}')"
    out = f"trim(regexp_replace({out}, '{_SIGNS}', ' ', 'g'), ' ')"
    return reduce(lambda c, s: f"replace({c}, '{s[0]}', '{s[1]}')", SPELLINGS, out)


def known_digests(spark: SparkSession, known: Sequence[tuple[str, str]] = KNOWN, digests: Sequence[tuple[str, int, str]] = DIGESTS) -> DataFrame:
    """``digest, size, name`` of known texts and of texts known by the size and digest of their forms."""
    texts = spark.createDataFrame([*known], "name string, known_text string").withColumn("form", canonical(F.col("known_text")))
    rows = texts.select("name", F.length("form").alias("size"), F.sha2("form", 256).alias("digest"))
    if digests:
        rows = rows.unionByName(spark.createDataFrame([*digests], "name string, size int, digest string"))
    return rows.where("size > 0").groupBy("digest").agg(F.max("size").alias("size"), F.min("name").alias("name"))


def scan(docs: DataFrame, known: Sequence[tuple[str, str]] = KNOWN, digests: Sequence[tuple[str, int, str]] = DIGESTS) -> DataFrame:
    """``doc_id, canonical_sha256, license, n_license_lines, line_licenses`` of each text.

    ``license`` is the known text that the whole document equals; ``line_licenses`` are the distinct
    known texts that single lines equal, sorted and joined by commas.
    """
    listed = known_digests(docs.sparkSession, known, digests)
    texts = whole_text(docs).withColumn("own", F.sha2("text", 256))
    sizes = [r["size"] for r in listed.select("size").distinct().collect()]  # of the list, a parameter
    lines = texts.select("doc_id", "own", F.posexplode(F.split("text", "\n")).alias("line", "text")).select("doc_id", "own", "line", canonical(F.col("text")).alias("form"))
    lines = lines.where(F.length("form").isin(sizes)).select("doc_id", "own", "line", F.sha2("form", 256).alias("digest"))
    # Rows that share doc_id and text count as one here and each get the result.
    found = lines.join(listed, "digest").groupBy("doc_id", "own", "line").agg(F.min("name").alias("name"))
    found = found.groupBy(F.col("doc_id").alias("_doc"), F.col("own").alias("_own")).agg(F.count("*").alias("n"), F.array_sort(F.collect_set("name")).alias("names"))
    whole = texts.select("doc_id", "own", F.sha2(canonical(F.col("text")), 256).alias("digest")).join(listed, "digest", "left")
    out = whole.join(found, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("own") == F.col("_own")), "left")
    return out.select(
        "doc_id",
        F.col("digest").alias("canonical_sha256"),
        F.col("name").alias("license"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n_license_lines"),
        F.coalesce(F.array_join("names", ","), F.lit("")).alias("line_licenses"),
    )


def scan_sql(known: Sequence[tuple[str, str]] = KNOWN, digests: Sequence[tuple[str, int, str]] = DIGESTS) -> str:
    rows = ", ".join("({}, {})".format(*(f"'{x.replace(chr(39), chr(39) * 2)}'" for x in pair)) for pair in known)
    more = "".join(f" UNION ALL SELECT '{name}', '{digest}'" for name, _, digest in digests)
    return f"""
WITH known AS (
  SELECT min(name) AS name, digest FROM (
    SELECT name, sha256({canonical_sql('known_text')}) AS digest FROM (VALUES {rows}) k(name, known_text){more}) GROUP BY digest),
forms AS (SELECT doc_id, coalesce(text, '') AS text, {canonical_sql("coalesce(text, '')")} AS form FROM documents),
lines AS (
  SELECT doc_id, sha256(form) AS digest FROM (
    SELECT doc_id, {canonical_sql('line')} AS form
    FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM forms)) WHERE form <> ''),
found AS (
  SELECT doc_id, count(*) AS n, array_to_string(list_sort(list_distinct(list(name))), ',') AS names
  FROM lines JOIN known USING (digest) GROUP BY doc_id)
SELECT f.doc_id, sha256(f.form) AS canonical_sha256, CASE WHEN f.form <> '' THEN k.name END AS license,
  coalesce(n, 0) AS n_license_lines, coalesce(names, '') AS line_licenses
FROM forms f LEFT JOIN known k ON k.digest = sha256(f.form) LEFT JOIN found USING (doc_id)"""
