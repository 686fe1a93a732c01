"""Language identification by hyperdimensional profiles.

Each letter has a random +-1 vector. A letter trigram is the product (binding) of its letters'
vectors, rotated (permuted) by their place; a text is the sum (bundle) of its trigrams; a language
is the bundle of its training texts' unit vectors. A text goes to the language of largest cosine.

Cases: null text, or text without a letter, is ``und`` with score 0; a tie goes to the language
that sorts first; with no training row every text is ``und``; rows that share a doc_id are scored
apiece; columns besides doc_id, text and (for training) lang are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, id_class, schema, slices, whole_text

UND = "und"
_SYMBOLS = 64
#: Trigrams taken at once, and cells of a table of counts by text.
_TRIGRAMS, _CELLS = 1024, 1 << 23
SCORED = schema("doc_id long, held_out boolean, lang_pred string, score double, cosine double")


@lru_cache(maxsize=1)
def _symbol_table() -> np.ndarray:
    """A symbol for each code point: 0 for no letter, 1-26 for a-z, 27-63 shared by other letters."""
    out = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        if chr(c).isalpha():
            out[c] = 27 + (c * 2654435761 % 2**32 >> 16) % (_SYMBOLS - 27)
    for i in range(26):
        out[ord("a") + i] = out[ord("A") + i] = i + 1
    return out


@lru_cache(maxsize=2)
def _letters(dims: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letter vectors as first, middle and last letter of a trigram."""
    base = np.random.default_rng(seed).choice(np.array([-1, 1], np.int8), (_SYMBOLS, dims))
    return np.roll(base, 2, axis=1), np.roll(base, 1, axis=1), base


def text_vectors(texts: list[str | None], dims: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The bundle of each text, and whether the text has a letter."""
    low = [(t or "").lower() for t in texts]
    joined = "\n".join(low) + "\n"
    symbols = _symbol_table()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
    row = np.repeat(np.arange(len(low)), np.fromiter(map(len, low), np.int64, len(low)) + 1)
    keep = np.r_[True, (symbols[1:] != 0) | (symbols[:-1] != 0)]
    symbols, row = np.r_[np.uint8(0), symbols[keep]], np.r_[0, row[keep]]
    middle = np.flatnonzero(symbols[1:-1]) + 1
    s = symbols.astype(np.int64)
    code = (s[middle - 1] * _SYMBOLS + s[middle]) * _SYMBOLS + s[middle + 1]
    used, at = np.unique(code, return_inverse=True)
    first, mid, last = _letters(dims, seed)
    out = np.zeros((len(low), dims), np.float32)
    here = row[middle]
    lettered = np.bincount(here, minlength=len(low)) > 0
    step = max(1, used.size)
    if len(low) * used.size > _CELLS:
        # Texts of many scripts hold many trigrams, each in few texts: counts of some trigrams at a time.
        order = np.argsort(at, kind="stable")
        at, here, step = at[order], here[order], _TRIGRAMS
    for a in range(0, used.size, step):
        u, rows, own, of = used[a : a + step], slice(None), at, here
        if step < used.size:
            some = slice(*np.searchsorted(at, (a, a + u.size)))
            rows, of = np.unique(here[some], return_inverse=True)
            own = at[some] - a
        n = len(low) if step == used.size else rows.size
        counts = np.bincount(of * u.size + own, minlength=n * u.size).reshape(n, u.size).astype(np.float32)
        for c in range(0, u.size, _TRIGRAMS):
            part = u[c : c + _TRIGRAMS]
            vectors = first[part // _SYMBOLS**2] * mid[part // _SYMBOLS % _SYMBOLS] * last[part % _SYMBOLS]
            out[rows] += counts[:, c : c + _TRIGRAMS] @ vectors.astype(np.float32)
    return out, lettered


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def _bundle(dims: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in slices(batches, limit=1 << 19):
            vectors, _ = text_vectors(batch.column("text").to_pylist(), dims, seed)
            langs = np.array(batch.column("lang").to_pylist(), object)
            for lang in set(langs.tolist()):
                sums[lang] = sums.get(lang, 0) + _unit(vectors[langs == lang]).sum(axis=0, dtype=np.float64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([v.tolist() for v in sums.values()])], ["lang", "bundle"])

    return run


def train_profiles(docs: DataFrame, max_rows: int = 20_000, dims: int = 1024, seed: int = 11) -> dict:
    """Language prototypes from rows with a non-null lang.

    ``max_rows`` bounds the fit: the rows of smallest hashed doc_id are used, from all the table.
    """
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").where("lang is not null and text is not null")
    last = known.select(F.xxhash64("doc_id").alias("h")).orderBy("h").limit(max_rows).agg(F.max("h")).first()[0]
    if last is None:
        return {"langs": [], "vectors": np.zeros((0, dims), np.float32), "dims": dims, "seed": seed}
    sample = known.where(F.xxhash64("doc_id") <= F.lit(last)).select("text", "lang").repartition(12)
    sums: dict[str, np.ndarray] = {}
    for r in sample.mapInArrow(_bundle(dims, seed), "lang string, bundle array<double>").collect():  # 12 rows a language
        sums[r["lang"]] = sums.get(r["lang"], 0) + np.array(r["bundle"])
    langs = sorted(sums)
    return {"langs": langs, "vectors": _unit(np.array([sums[x] for x in langs])).astype(np.float32), "dims": dims, "seed": seed}


def _identify(held, sharpness: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles = held.value
        names = np.array([*profiles["langs"], UND], object)
        for batch in slices(batches, limit=1 << 19):
            vectors, lettered = text_vectors(batch.column("text").to_pylist(), profiles["dims"], profiles["seed"])
            if profiles["langs"]:
                cosine = _unit(vectors) @ profiles["vectors"].T
                best = np.where(lettered, cosine.argmax(axis=1), len(names) - 1)
                top = np.where(lettered, cosine.max(axis=1), 0.0).astype(np.float64)
                share = 1 / np.exp(sharpness * (cosine - cosine.max(axis=1, keepdims=True))).sum(axis=1)
            else:
                best, top = np.full(batch.num_rows, len(names) - 1), np.zeros(batch.num_rows)
                share = top
            score = np.where(lettered, share, 0.0).astype(np.float64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(names[best].tolist(), pa.string()), pa.array(score), pa.array(top)],
                SCORED.names,
            )

    return run


def identify(docs: DataFrame, profiles: dict, held_out=None, sharpness: float = 20.0) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, cosine`` of each text.

    ``score`` is the soft maximum of the languages' cosines, ``cosine`` the largest one.
    """
    held = docs.sparkSession.sparkContext.broadcast(profiles)  # a vector a language
    held_out = F.lit(None).cast("boolean") if held_out is None else held_out
    return whole_text(docs).withColumn("held_out", held_out).mapInArrow(_identify(held, sharpness), SCORED)


def language_query(docs: DataFrame) -> DataFrame:
    """Fold 2 of crc32(doc_id) mod 4 is held out from the fit."""
    held_out = id_class("doc_id", 4) == 2
    profiles = train_profiles(docs.where(~held_out))
    return identify(docs, profiles, held_out)


def keep_known(docs: DataFrame, profiles: dict, min_score: float = 0.3, sharpness: float = 20.0) -> DataFrame:
    """The rows of ``docs``, all their columns, whose text has a letter and a language.

    Rejected are texts that are ``und`` and those whose score is below ``min_score``, next to no
    preference among four languages; with no learned language every row with a letter stays.
    """
    held = docs.sparkSession.sparkContext.broadcast(profiles)
    bound_batches(docs.sparkSession)
    # Names of any kind travel as numbers.
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    text = f"c{docs.columns.index('text')}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, 1 << 19):
            vectors, lettered = text_vectors(batch.column(text).to_pylist(), held.value["dims"], held.value["seed"])
            if held.value["langs"]:
                cosine = _unit(vectors) @ held.value["vectors"].T
                share = 1 / np.exp(sharpness * (cosine - cosine.max(axis=1, keepdims=True))).sum(axis=1)
                lettered = lettered & (share >= min_score)
            yield batch.filter(pa.array(lettered))

    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
