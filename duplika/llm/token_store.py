"""Token-ID output: ORC stripes with run-length encoded ids, row indexes and Bloom filters on doc_id.

Files hold ``doc_id, part, local_start, n_tokens, ids`` in ascending doc_id order, one range of
ids per part. ORC encodes the integers with its run-length encoding, keeps a row index every
``row_index_stride`` rows and a Bloom filter on doc_id, so point and range reads skip stripes and
row groups by metadata, and readers split files by stripe.

Cases: null text counts as empty and still gets its end id; rows that share a doc_id are ordered
by the hash of their text, then the text; null doc_ids come first; an empty table gives an empty store;
columns besides doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import list_parts, lists, schema, slices, whole_text, workdir
from .tokens import crc32s, encoder

STORED = schema("doc_id long, part int, local_start long, n_tokens long, ids array<int>")


def _encode(path: str, end_id: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        for batch in slices(batches, limit=2 << 20):
            ids, offsets = encoder(path).encode(batch.column("text"), end_id)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(np.full(n, part, np.int32)),
                    pa.array(before + offsets[:-1]),
                    pa.array(np.diff(offsets)),
                    lists(ids, offsets, pa.int32()),
                ],
                STORED.names,
            )
            before += int(offsets[-1])

    return run


def write_token_store(
    docs: DataFrame,
    path: str,
    tokenizer_path: str,
    end_id: int | None = 2,
    stripe_mb: int = 32,
    row_index_stride: int = 1000,
    bloom_fpp: float = 0.01,
) -> None:
    """Encode every whole text and write the store to ``path``."""
    ordered = (
        whole_text(docs)
        .withColumn("h", F.xxhash64("text"))
        .repartitionByRange("doc_id", "h")
        .sortWithinPartitions("doc_id", "h", "text")
        .select("doc_id", "text")
    )
    (
        ordered.mapInArrow(_encode(tokenizer_path, end_id), STORED)
        .write.option("compression", "zstd")
        .option("orc.stripe.size", str(stripe_mb << 20))
        .option("orc.row.index.stride", str(row_index_stride))
        .option("orc.create.index", "true")
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", str(bloom_fpp))
        .orc(path)
    )


def read_token_store(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids``; filters on doc_id reach the stripe metadata.

    The parts' sizes come from the light columns alone: the ids are not read for them. There is
    one row for each written part, at most the writer's number of shuffle partitions.
    """
    stored = spark.read.schema(STORED).orc(path)
    sizes = stored.groupBy("part").agg(F.sum("n_tokens").alias("size"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))
    return stored.join(F.broadcast(base), "part").select(
        "doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids"
    )


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values, offsets = list_parts(batch.column("ids"))
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("doc_id", "start", "n_tokens")), pa.array(crc32s(values, offsets))],
            ["doc_id", "start", "n_tokens", "ids_crc32"],
        )


def store_digest(stored: DataFrame) -> DataFrame:
    """One row a document with the checksum of the ids that the files hold."""
    return stored.mapInArrow(_sums, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_store_query(spark: SparkSession, docs: DataFrame, tokenizer_path: str, end_id: int = 2) -> DataFrame:
    path = f"{workdir(spark)}/token_store"
    write_token_store(docs, path, tokenizer_path, end_id)
    return store_digest(read_token_store(spark, path))
