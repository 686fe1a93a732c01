"""Substring deduplication by seed and extend.

Seeds are winnowed anchors: of every ``length - k + 1`` consecutive runs of k words the run of least hash is
an anchor, so any shared passage of ``length`` words holds a shared anchor. Documents are joined on their
anchors; an anchor found in one document alone goes. Around each shared anchor the match is extended both ways, by
every split of the remaining words between left and right: each of the extensions, a window of
``length`` words over the anchor, is matched by its hash with the smallest doc_id that has it. Windows
that an earlier document starts are merged into maximal repeats, and their words go.

No pairs of documents are formed: an anchor or window shared by m documents costs m rows, reduced to
one in the mappers. Whole-document copies of an earlier document are known by the digest of their words
and need neither anchors nor windows.

Cases: null text has no words; documents below ``length`` words lose none; rows that share a doc_id are judged
apiece, none as the other's earlier document; rows with a null doc_id lose no word and take
none; an empty table gives no rows; columns besides doc_id and text are not read by the query.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, buffers, drop, lists, list_parts, row_bounds, run_hashes, schema, slices, stage, whole_text, word_hashes, word_spans, workdir

LENGTH, ANCHOR = 50, 26
PREPARED = schema("doc_id long, sig long, n_words long, sha string, anchors array<long>")
WINDOWS = schema("doc_id long, sig long, packed binary, pos array<int>, hash array<long>")
CLEANED = schema("doc_id long, sig long, n_removed long, kept_sha256 string, kept_text string")
_MAX = U64(2**64 - 1)
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least of each w consecutive values."""
    n = x.size - w + 1
    if n <= 0:
        return x[:0]
    padded = np.full(-(-x.size // w) * w + w, _MAX, x.dtype)
    padded[: x.size] = x
    block = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(block, axis=1).ravel()
    back = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


def winnow(h: np.ndarray, w: int) -> np.ndarray:
    """Which values are the least of some w consecutive ones."""
    least = sliding_min(h, w)
    if not least.size:
        return np.zeros(h.size, bool)
    # The largest minimum among the windows that cover i equals h[i] if one of them has it as its least.
    over = np.concatenate([np.zeros(w - 1, U64), least, np.zeros(w - 1, U64)])
    return _MAX - sliding_min(_MAX - over, w) == h


def _words(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    raw, offsets = buffers(batch.column("text"))
    starts, ends, rows = word_spans(raw, offsets)
    return raw, starts, ends, rows, row_bounds(rows, batch.num_rows)


def _joined(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bytes:
    """Words joined by one space."""
    if not starts.size:
        return b""
    size = ends - starts + 1
    at = np.cumsum(size) - size
    out = np.full(int(size.sum()), 0x20, np.uint8)
    place = np.arange(out.size) - np.repeat(at, size)
    ink = place < np.repeat(size - 1, size)
    out[ink] = raw[(place + np.repeat(starts, size))[ink]]
    return out[:-1].tobytes()


def _anchor_hashes(words: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each place; the largest number where they leave the document."""
    h = run_hashes(words, k)
    h[rows[: h.size] != rows[k - 1 :]] = _MAX
    return h


def _prepare(length: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            raw, starts, ends, rows, bound = _words(batch)
            h = _anchor_hashes(word_hashes(raw, starts, ends), rows, k)
            chosen = winnow(h, length - k + 1) & (h != _MAX)
            shas, found, size = [], [], np.zeros(batch.num_rows + 1, np.int64)
            for i, (a, b) in enumerate(zip(bound.tolist(), bound[1:].tolist())):
                shas.append(hashlib.sha256(_joined(raw, starts[a:b], ends[a:b])).digest())
                if b - a >= length:
                    own = np.unique(h[a:b][chosen[a:b]])
                    found.append(own)
                    size[i + 1] = own.size
            anchors = np.concatenate(found) if found else np.zeros(0, U64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([int.from_bytes(s[:8], "little", signed=True) for s in shas], pa.int64()),
                    pa.array(np.diff(bound)),
                    pa.array([s.hex() for s in shas]),
                    lists(anchors.view(np.int64), np.cumsum(size), pa.int64()),
                ],
                PREPARED.names,
            )

    return run


def _extend(length: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            raw, starts, ends, rows, bound = _words(batch)
            words = word_hashes(raw, starts, ends)
            h = _anchor_hashes(words, rows, k)
            window = run_hashes(words, length)
            shared, edge = list_parts(batch.column("shared"))
            shared = shared.view(U64)
            texts = batch.column("text")
            sigs, packed, places, hashes, size = [], [], [], [], np.zeros(batch.num_rows + 1, np.int64)
            for i, (a, b) in enumerate(zip(bound.tolist(), bound[1:].tolist())):
                joined = _joined(raw, starts[a:b], ends[a:b])
                sigs.append(int.from_bytes(hashlib.sha256(joined).digest()[:8], "little", signed=True))
                packed.append(pa.compress(texts[i].as_py().encode(), "zstd", asbytes=True) if b - a >= length else b"")
                if b - a < length:
                    continue
                seeds = np.flatnonzero(np.isin(h[a : b - k + 1], shared[edge[i] : edge[i + 1]]))
                # Windows over a seed begin up to length - k words before it.
                cover = np.zeros(b - a + 2, np.int64)
                np.add.at(cover, np.maximum(seeds - (length - k), 0), 1)
                np.add.at(cover, seeds + 1, -1)
                begins = np.flatnonzero(np.cumsum(cover)[: b - a - length + 1] > 0)
                places.append(begins)
                hashes.append(window[a + begins])
                size[i + 1] = begins.size
            offsets = np.cumsum(size)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(sigs, pa.int64()),
                    pa.array(packed, pa.binary()),
                    lists((np.concatenate(places) if places else np.zeros(0, np.int64)).astype(np.int32), offsets, pa.int32()),
                    lists((np.concatenate(hashes) if hashes else np.zeros(0, U64)).view(np.int64), offsets, pa.int64()),
                ],
                WINDOWS.names,
            )

    return run


def _clean(length: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, edge = list_parts(batch.column("places"))
            lost, shas, kept = [], [], []
            for i, z in enumerate(batch.column("packed")):
                raw = np.frombuffer(_unpack(z.as_py()), np.uint8)
                starts, ends, _ = word_spans(raw, np.array([0, raw.size]))
                cover = np.zeros(starts.size + 1, np.int64)
                begins = np.unique(places[edge[i] : edge[i + 1]])
                cover[begins] += 1
                np.subtract.at(cover, np.minimum(begins + length, starts.size), 1)
                stay = np.cumsum(cover)[:-1] == 0
                text = _joined(raw, starts[stay], ends[stay])
                lost.append(int(starts.size - stay.sum()))
                shas.append(hashlib.sha256(text).hexdigest())
                kept.append(text.decode() if with_text else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("sig"), pa.array(lost, pa.int64()), pa.array(shas, pa.string()), pa.array(kept, pa.string())],
                CLEANED.names,
            )

    return run


def _unpack(z: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompressobj().decompress(z)


def find_repeats(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, with_text: bool = False, folder: str | None = None) -> DataFrame:
    """``doc_id, sig, n_words, n_removed, kept_sha256, kept_text`` of each row.

    ``sig`` is the head of the digest of the row's words; ``kept_text`` is null where nothing goes, or without ``with_text``.
    """
    spark = docs.sparkSession
    folder = folder or workdir(spark)
    texts = whole_text(docs)
    prepared = stage(texts.mapInArrow(_prepare(length, anchor), PREPARED), folder, "prepared")
    first = stage(
        prepared.where((F.col("n_words") >= length) & F.col("doc_id").isNotNull()).groupBy("sha").agg(F.min("doc_id").alias("earliest")),
        folder, "first",
    )
    live = prepared.join(first, (prepared.sha == first.sha) & (prepared.doc_id == first.earliest), "left_semi")
    seeds = stage(live.select("doc_id", F.explode("anchors").alias("h")), folder, "seeds")
    spread = seeds.groupBy("h").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("h")
    # Staged first, so that a join with a hot anchor or window can be split by its rows.
    spread = stage(spread, folder, "spread")
    shared = stage(seeds.join(spread, "h").groupBy("doc_id").agg(F.collect_set("h").alias("shared")), folder, "shared")
    drop(spark, f"{folder}/seeds")
    near = texts.join(shared, "doc_id").select("doc_id", "text", "shared")
    windows = stage(near.mapInArrow(_extend(length, anchor), WINDOWS), folder, "windows")
    each = windows.select("doc_id", "sig", F.explode(F.arrays_zip("pos", "hash")).alias("w")).select("doc_id", "sig", "w.pos", "w.hash")
    source = each.groupBy("hash").agg(F.min("doc_id").alias("source"), F.max("doc_id").alias("last")).where("source < last").select("hash", "source")
    source = stage(source, folder, "source")
    repeated = each.join(source, "hash").where("source < doc_id").groupBy("doc_id", "sig").agg(F.collect_list("pos").alias("places"))
    rest = windows.select("doc_id", "sig", "packed").dropDuplicates(["doc_id", "sig"]).join(repeated, ["doc_id", "sig"])
    cleaned = stage(rest.mapInArrow(_clean(length, with_text), CLEANED), folder, "cleaned")
    base = prepared.select("doc_id", "sig", "n_words", "sha").join(first, "sha", "left").join(cleaned, ["doc_id", "sig"], "left")
    copy = F.coalesce(F.col("earliest") < F.col("doc_id"), F.lit(False))
    return base.select(
        "doc_id",
        "sig",
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit(EMPTY_SHA)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        F.when(copy, F.lit("")).otherwise(F.col("kept_text")).alias("kept_text"),
    )


def remove_repeats(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """``docs`` with the repeated words gone; texts without one stay as they are.

    A text that loses words holds the rest joined by single spaces.
    """
    found = find_repeats(docs, length, anchor, with_text=True).where("n_removed > 0")
    # A row is known by its id and the digest of its own text's words.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"), _sig(docs).alias("sig"))
    changed = found.select(F.col("doc_id").alias("id"), "sig", F.struct("kept_text").alias("kept")).dropDuplicates(["id", "sig"])
    own = F.col("row")
    text = F.when(F.col("kept").isNotNull(), F.col("kept.kept_text")).otherwise(own.getField("text")).alias("text")
    out = rows.join(changed, ["id", "sig"], "left")
    return out.select(*[text if c == "text" else own.getField(c).alias(c) for c in docs.columns])


def _sig(docs: DataFrame):
    """The head of the digest of the words joined by one space, in JVM functions."""
    words = F.regexp_replace(F.coalesce(docs["text"], F.lit("")), r"[\x20\x09-\x0D]+", " ")
    digest = F.sha2(F.regexp_replace(words, "^ | $", ""), 256)
    ends = F.reverse(F.regexp_replace(F.substring(digest, 1, 16), "(..)", "$1,"))
    pairs = F.array_join(F.transform(F.split(ends, ","), F.reverse), "")
    high, low = F.conv(F.substring(pairs, 1, 8), 16, 10).cast("long"), F.conv(F.substring(pairs, 9, 8), 16, 10).cast("long")
    return F.shiftleft(high, 32).bitwiseOR(low)


def substring_query(docs: DataFrame) -> DataFrame:
    return find_repeats(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")
