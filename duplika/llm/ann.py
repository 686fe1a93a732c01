"""Approximate nearest neighbours by cosine: score-aware anisotropic quantisation and four-bit scans.

Unit vectors are product-quantised in blocks of two dimensions with 16 centroids (four bits) each. Codes and
centroids minimise an anisotropic loss: the part of the residual parallel to the vector, which moves
inner products with near queries most, is penalised ``eta`` times the orthogonal part. A scan adds
up table entries of the codes, two codes to a byte; the best of each slice of rows are scored
exactly on the original vectors, and only those exact scores leave the task.

Every row is indexed; the codebook alone is fitted on a bounded sample. Vectors that are null, zero, or hold null
or non-finite components take no part, nor do vectors of another length than the first row of the sample.
Ties go to the smaller vec_id. Queries without a candidate give no row; repeated rows are candidates
apiece; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop, list_parts, schema, stage, workdir

FOUND = schema("query_id long, vec_id long, score double")
INDEXED = schema("vec_id long, codes binary, vector array<double>")
_ROWS = 4096

# --- codebook -------------------------------------------------------------------


def _blocks(x: np.ndarray) -> np.ndarray:
    """(rows, blocks, 2); an odd last dimension gets a zero beside it."""
    if x.shape[1] % 2:
        x = np.c_[x, np.zeros(len(x))]
    return x.reshape(len(x), -1, 2)


def assign(x: np.ndarray, centroids: np.ndarray, eta: float, sweeps: int = 2) -> np.ndarray:
    """Codes of unit vectors by coordinate descent on the anisotropic loss."""
    b = _blocks(x)
    norm = (b**2).sum(axis=2)
    dots = np.einsum("nbd,bkd->nbk", b, centroids)
    flat = norm[:, :, None] - 2 * dots + (centroids**2).sum(axis=2)[None]
    code = flat.argmin(axis=2)
    along = norm[:, :, None] - dots  # a block's share of the parallel residual, for each centroid
    rows = np.arange(len(x))
    total = np.take_along_axis(along, code[:, :, None], axis=2)[:, :, 0].sum(axis=1)
    for _ in range(sweeps):
        for m in range(b.shape[1]):
            rest = total - along[rows, m, code[:, m]]
            code[:, m] = (flat[:, m] + (eta - 1) * (rest[:, None] + along[:, m]) ** 2).argmin(axis=1)
            total = rest + along[rows, m, code[:, m]]
    return code


def fit_codebook(x: np.ndarray, threshold: float = 0.2, rounds: int = 8, seed: int = 5) -> dict:
    """Centroids for unit vectors; ``threshold`` is the inner product above which scores matter."""
    b = _blocks(x)
    d = max(2, x.shape[1])
    eta = max(1.0, (d - 1) * threshold**2 / (1 - threshold**2))
    rng = np.random.default_rng(seed)
    pick = rng.choice(len(x), 16, replace=len(x) < 16)
    centroids = b[pick].transpose(1, 0, 2).copy() + rng.normal(0, 1e-6, (b.shape[1], 16, 2))
    rows = np.arange(len(x))
    for _ in range(rounds):
        code = assign(x, centroids, eta, 1)
        own = centroids[np.arange(b.shape[1])[None, :], code]
        along = (b * (b - own)).sum(axis=2)
        total = along.sum(axis=1)
        for m in range(b.shape[1]):
            xm, target = b[:, m], total - along[:, m] + (b[:, m] ** 2).sum(axis=1)
            for k in range(16):
                on = rows[code[:, m] == k]
                if on.size:
                    z = xm[on]
                    left = on.size * np.eye(2) + (eta - 1) * z.T @ z
                    centroids[m, k] = np.linalg.solve(left, z.sum(axis=0) + (eta - 1) * z.T @ target[on])
    return {"centroids": centroids, "eta": eta, "dims": x.shape[1]}


def pack_codes(code: np.ndarray) -> np.ndarray:
    """Two four-bit codes to a byte."""
    if code.shape[1] % 2:
        code = np.c_[code, np.zeros(len(code), code.dtype)]
    return (code[:, ::2] << 4 | code[:, 1::2]).astype(np.uint8)


def byte_tables(queries: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """(bytes, queries, 256) sums of two blocks' inner products with the centroids."""
    table = np.einsum("qbd,bkd->bqk", _blocks(queries), centroids)
    if table.shape[0] % 2:
        table = np.concatenate([table, np.zeros_like(table[:1])])
    return (table[::2, :, :, None] + table[1::2, :, None, :]).reshape(table.shape[0] // 2, len(queries), 256).astype(np.float32)


# --- index and search -------------------------------------------------------------


def usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & fine & F.exists(vector, lambda v: v != 0), F.lit(False))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    values, _ = list_parts(column)
    return values.reshape(-1, dims)


def _unit(x: np.ndarray) -> np.ndarray:
    """Unit vectors; scaled by the largest component first, so that no square is lost or overflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _encode(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = held.value
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                codes = pack_codes(assign(_unit(_matrix(part.column("vector"), book["dims"])), book["centroids"], book["eta"]))
                packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(codes.shape[1]), len(codes), [None, pa.py_buffer(np.ascontiguousarray(codes))])
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), packed.cast(pa.binary()), part.column("vector")], INDEXED.names)

    return run


def build_index(vectors: DataFrame, sample_rows: int = 10_000) -> tuple[DataFrame, dict | None]:
    """``vec_id, codes, vector`` of every usable row, and the codebook.

    ``sample_rows`` bounds the fit: the rows of smallest hashed vec_id.
    """
    clean = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector")).where(
        usable(F.col("vector")) & F.col("vec_id").isNotNull()
    )
    sample = clean.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).toArrow()
    if sample.num_rows == 0:
        return clean.select("vec_id", F.lit(b"").alias("codes"), "vector"), None
    column = sample.column("vector").combine_chunks()
    first = len(column[0])
    rows = [v for v in column.to_pylist() if len(v) == first]
    book = fit_codebook(_unit(np.array(rows)))
    held = vectors.sparkSession.sparkContext.broadcast(book)
    return clean.where(F.size("vector") == first).mapInArrow(_encode(held), INDEXED), book


def _top(score: np.ndarray, most: int) -> np.ndarray:
    """(rows, most) places of the largest scores of each row; of equal scores, the first places."""
    n = score.shape[1]
    if n <= most:
        return np.broadcast_to(np.arange(n), (len(score), n))
    least = -np.partition(-score, most - 1, axis=1)[:, most - 1]
    out = np.empty((len(score), most), np.int64)
    for i in range(len(score)):
        over = np.flatnonzero(score[i] > least[i])
        out[i, : over.size] = over
        out[i, over.size :] = np.flatnonzero(score[i] == least[i])[: most - over.size]
    return out


def _scan(held, k: int, candidates: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, queries, book = held.value
        queries = _unit(queries)
        best_score = np.full((len(queries), k), -np.inf)
        best_id = np.full((len(queries), k), np.iinfo(np.int64).max)
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                ids = part.column("vec_id").to_numpy()
                order = np.argsort(ids, kind="stable")
                ids = ids[order]
                vectors = _unit(_matrix(part.column("vector"), book["dims"]))[order]
                codes = np.frombuffer(b"".join(part.column("codes").to_pylist()), np.uint8).reshape(len(ids), -1)[order].T
                for a in range(0, len(queries), 256):
                    b = min(a + 256, len(queries))
                    score = np.zeros((b - a, len(ids)), np.float32)
                    # Tables of some queries at a time: those of a whole block would take hundreds of MB.
                    for table, code in zip(byte_tables(queries[a:b], book["centroids"]), codes, strict=True):
                        score += table[:, code]
                    score[query_ids[a:b, None] == ids[None, :]] = -np.inf
                    place = _top(score, candidates)
                    exact = np.einsum("qcd,qd->qc", vectors[place], queries[a:b])
                    exact = np.where(query_ids[a:b, None] == ids[place], -np.inf, exact)
                    all_score = np.concatenate([best_score[a:b], exact], axis=1)
                    all_id = np.concatenate([best_id[a:b], ids[place]], axis=1)
                    keep = np.lexsort((all_id, -all_score), axis=1)[:, :k]
                    best_score[a:b] = np.take_along_axis(all_score, keep, axis=1)
                    best_id[a:b] = np.take_along_axis(all_id, keep, axis=1)
        found = np.isfinite(best_score)
        if found.any():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.broadcast_to(query_ids[:, None], found.shape)[found]), pa.array(best_id[found]), pa.array(best_score[found])],
                FOUND.names,
            )

    return run


def search(vectors: DataFrame, is_query: Column, k: int = 5, candidates: int = 80, query_block: int = 8192) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest found of each row where ``is_query`` holds.

    Queries go in blocks of about ``query_block``, each block against every indexed row. ``candidates`` rows of
    every slice of 4,096 rows are scored exactly.
    """
    spark = vectors.sparkSession
    home = workdir(spark)
    folder = f"{home}/work"
    indexed, book = build_index(vectors)
    if book is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    index = stage(indexed, folder, "index")
    asked = index.where(is_query).select("vec_id", "vector").dropDuplicates(["vec_id"])
    blocks = -(-asked.count() // query_block)
    found = None
    for i in range(blocks):
        mine = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == i) if blocks > 1 else asked
        got = mine.orderBy("vec_id").toArrow()  # one block: about query_block rows, a few MB, whatever the table
        if not got.num_rows:
            continue
        queries = _matrix(got.column("vector").combine_chunks(), book["dims"])
        held = spark.sparkContext.broadcast((got.column("vec_id").to_numpy(), queries, book))
        part = stage(index.mapInArrow(_scan(held, k, candidates), FOUND), folder, f"found_{i}")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    nearest = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = stage(found.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), home, "nearest")
    drop(spark, folder)
    return out


def ann_query(embeddings: DataFrame) -> DataFrame:
    return search(embeddings, F.col("vec_id") % 50 == 0, k=5)
