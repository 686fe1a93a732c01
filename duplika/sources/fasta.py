"""FASTA and its index: readers and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequence import species_name
from ..schema import FAI


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """``species, chrom, seq``: a row a record; the name is the header's first token, the species the file's stem."""
    # A record ends before a ">" that begins a line; only a file's first record keeps its own.
    record = F.regexp_replace("value", r"^\s*>", "").alias("value")
    file = F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B")))  # the path is a URI; a plus sign in it is one
    rows = spark.read.option("lineSep", "\n>").text(path).select(species_name(file).alias("species"), record).where(F.trim("value") != "")
    header = F.split(F.regexp_extract("value", r"^([^\n]*)", 1), r"\s+")
    seq = F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n?", ""), r"\s+", "")
    return rows.select("species", header[0].alias("chrom"), seq.alias("seq"))


def contig_slice(seqs: DataFrame, chrom: str, start: int, length: int) -> DataFrame:
    """Random access: a part of one contig; the filter reaches a partitioned or sorted store."""
    return seqs.where(F.col("chrom") == chrom).select("species", "chrom", F.substring("seq", start + 1, length).alias("seq"))


def contig_index(seqs: DataFrame) -> DataFrame:
    return seqs.select("species", "chrom", F.length("seq").cast("long").alias("len"))


def read_fai(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("sep", "\t").schema(FAI + ", a string, b string, c string").csv(path).select("chrom", "len")


def wrap(seq, width: int = 80):
    return F.regexp_replace(seq, f"(.{{{width}}})(?=.)", "$1\n")


def write_fasta(seqs: DataFrame, path: str, header=None) -> None:
    """Records of 80 columns a line; empty ones are left out."""
    head = F.col("chrom") if header is None else header
    seqs.where(F.length("seq") > 0).select(F.concat(F.lit(">"), head, F.lit("\n"), wrap(F.col("seq"))).alias("value")).write.text(path)


def write_cluster_fasta(members: DataFrame, path: str) -> None:
    """A folder for each cluster, headers ``species#chrom{+ or _}#start#end``."""
    strand = F.when(F.col("strand") == "-", "_").otherwise("+")
    head = F.concat_ws("#", "species", F.concat("chrom", strand), F.col("start").cast("string"), F.col("end").cast("string"))
    rows = members.where(F.length("seq") > 0).select("cluster", F.concat(F.lit(">"), head, F.lit("\n"), wrap(F.col("seq"))).alias("value"))
    rows.write.partitionBy("cluster").text(path)


def parse_cluster_header(name):
    """Struct of a cluster header; the chromosome may itself hold ``#``."""
    parts = F.split(name, "#")
    middle = F.array_join(F.slice(parts, F.lit(2), F.size(parts) - 3), "#")
    return F.struct(
        parts[0].alias("species"), F.regexp_extract(middle, "^(.*).$", 1).alias("chrom"), F.right(middle, F.lit(1)).alias("strand"),
        F.element_at(parts, -2).cast("long").alias("start"), F.element_at(parts, -1).cast("long").alias("end"),
    )
