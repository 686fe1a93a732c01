"""Shared pieces: document columns, Arrow batches and byte-level numpy text kernels."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..staging import drop, exists, stage, workdir  # noqa: F401

U64 = np.uint64
#: Text bytes handled at once by the numpy kernels; a longer document is handled alone.
CHUNK_BYTES = 1 << 19

# --- tables ------------------------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows and bytes of the Arrow batches that texts travel in; Spark's own 10,000 rows may be hundreds of MB of text.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20)}


def bound_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches, where they are not set already."""
    for name, value in BATCH.items():
        if spark.conf.get(name, None) is None:
            spark.conf.set(name, value)


def whole_text(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with null text as the empty text; other columns are left aside."""
    bound_batches(docs.sparkSession)
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )


def id_class(col: str, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % F.lit(modulus)


_TYPES = {
    "long": T.LongType(), "int": T.IntegerType(), "string": T.StringType(), "double": T.DoubleType(),
    "boolean": T.BooleanType(), "binary": T.BinaryType(), "array<long>": T.ArrayType(T.LongType()),
    "array<int>": T.ArrayType(T.IntegerType()), "array<double>": T.ArrayType(T.DoubleType()),
}


def schema(ddl: str) -> T.StructType:
    """A schema from ``name type, ...``; needs no session."""
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in (x.split() for x in ddl.split(","))])


# --- Arrow batches -----------------------------------------------------------


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each slice holds about ``limit`` bytes of ``column``, one row at least."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, offsets = buffers(batch.column(column))
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
            end = min(max(end, at + 1), batch.num_rows)
            yield batch.slice(at, end - at)
            at = end
    give_back()


def give_back() -> None:
    """Return freed memory to the system at the end of a task: workers live on for other tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string or binary column; null counts as empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def lists(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, kind))


def list_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a list column without nulls in the lists."""
    if column.null_count:
        column = column.fill_null([])
    offsets = column.offsets.to_numpy().astype(np.int64)
    values = column.values.to_numpy(zero_copy_only=False)
    return values[offsets[0] : offsets[-1]], offsets - offsets[0]


# --- words and hashes --------------------------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
#: A random 64-bit value for each byte, and odd multipliers for the places of bytes and words.
_BYTE = np.random.default_rng(7).integers(0, 2**64, 256, dtype=U64)
_STEP = U64(0x9E3779B97F4A7C15 | 1)
_WORD = U64(0xD1342543DE82EF95)
_WORD_INV = U64(pow(0xD1342543DE82EF95, -1, 2**64))


def mix(h: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


@lru_cache(maxsize=8)
def _powers(base: int, size: int) -> np.ndarray:
    out = np.full(size, base, U64)
    out[0] = 1
    return np.multiply.accumulate(out)


def powers(base: np.uint64, size: int) -> np.ndarray:
    """base ** 0, 1, ... modulo 2 ** 64."""
    return _powers(int(base), 1 << max(12, int(size).bit_length()))[:size]


def lower_ascii(raw: np.ndarray) -> np.ndarray:
    return _LOWER[raw]


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document row of each word ``[^\\x20\\x09-\\x0D]+``; no word crosses documents."""
    ink = ~_SPACE[raw]
    if not raw.size:
        z = np.zeros(0, np.int64)
        return z, z, z
    before = np.empty_like(ink)
    before[0] = False
    before[1:] = ink[:-1]
    after = np.empty_like(ink)
    after[-1] = False
    after[:-1] = ink[1:]
    first = offsets[:-1]
    before[first[first < raw.size]] = False
    last = offsets[1:] - 1
    after[last[last >= 0]] = False
    starts = np.flatnonzero(ink & ~before)
    ends = np.flatnonzero(ink & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    if not starts.size:
        return np.zeros(0, U64)
    size = ends - starts
    at = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(at, size)
    ink = raw[place + np.repeat(starts, size)]
    h = np.add.reduceat(_BYTE[ink] * powers(_STEP, int(size.max()))[place], at)
    return mix(h + size.astype(U64))


def row_bounds(rows: np.ndarray, n: int) -> np.ndarray:
    """Offsets of each of n documents in an array sorted by document row."""
    return np.searchsorted(rows, np.arange(n + 1))


def run_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of words i to i+k-1 for every i, over the whole array; ends that lack k words are left out."""
    n = words.size - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    up, down = powers(_WORD, words.size), powers(_WORD_INV, words.size)
    total = np.zeros(words.size + 1, U64)
    np.cumsum(words * up, out=total[1:])
    return mix((total[k:] - total[:-k]) * down[:n] + U64(k))
