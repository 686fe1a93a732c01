"""Toxicity by a factorization machine over hashed terms.

A text's features are the presence of its hashed words and word beginnings (ASCII lower-cased). The
machine scores ``bias + sum w_i + sum <v_i, v_j>`` over pairs of present terms, so that a pair such
as an insult beside the mention of a group can weigh more, or less, than its parts do. Terms are chosen
by their own frequency in the classes or by that of a pair they are in, and the decay of the pair
factors by the loss on a part of the training rows. The raw score is turned into a probability by a logistic fitted on the training rows.

Cases: null counts as empty, and an empty text gets the score of the bias alone; repeated rows are
scored apiece; with no training row, or one class only, the score is the smoothed share of toxic rows;
columns besides doc_id, text (and, for training, toxic) are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, buffers, drop, id_class, lists, list_parts, lower_ascii, schema, slices, stage, whole_text, word_hashes, word_spans, workdir

BITS = 22
_BEGINNINGS = (4, 5, 6)
SCORED = schema("doc_id long, held_out boolean, score double, predicted int")


def terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed terms of each text, sorted, and the texts' offsets."""
    raw, offsets = buffers(texts)
    raw = lower_ascii(raw)
    # Words here end at any ASCII sign that is neither letter nor digit, so that "idiot," is "idiot".
    plain = np.where(_SIGN[raw], np.uint8(0x20), raw)
    starts, ends, rows = word_spans(plain, offsets)
    kinds = [word_hashes(plain, starts, ends)]
    for k in _BEGINNINGS:
        long = ends - starts > k
        kinds.append(word_hashes(plain, starts[long], starts[long] + k) ^ np.uint64(k))
    row = np.concatenate([rows, *(rows[ends - starts > k] for k in _BEGINNINGS)])
    code = (row.astype(np.int64) << BITS) | (np.concatenate(kinds) >> np.uint64(64 - BITS)).astype(np.int64)
    code.sort()
    code = code[np.r_[True, code[1:] != code[:-1]]] if code.size else code
    return (code & ((1 << BITS) - 1)).astype(np.int32), np.searchsorted(code >> BITS, np.arange(len(texts) + 1))


_SIGN = np.zeros(256, bool)
_SIGN[:128] = [not chr(c).isalnum() for c in range(128)]


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, limit=1 << 20):
        ids, offsets = terms(batch.column("text"))
        yield pa.RecordBatch.from_arrays([batch.column("toxic"), lists(ids, offsets, pa.int32())], ["toxic", "terms"])


#: Decay and pace of the pair factors that ``fit`` chooses from: from nearly none to free ones.
_PAIRS = ((0.1, 5e-4), (1e-2, 5e-3), (1e-3, 1e-2))


#: Terms whose pairs are looked at, at most: the table of pairs is worked out in the driver, in time of the square of these.
PAIR_TERMS = 6_000


def paired_terms(
    features: list[np.ndarray], label: np.ndarray, seen: np.ndarray, min_share: float = 0.02, min_rows: int = 10, min_z: float = 6.0, block: int = 512, most: int = PAIR_TERMS
) -> np.ndarray:
    """Terms of a pair whose odds of a toxic row are over those its parts' own odds tell by ``min_z`` standard errors.

    The rows of the rarer class meet as many of the other one. A term has the support of ``min_share`` of the rows: one of
    less in a pair of 0.2 % of the rows or more differs between the classes by itself where a tenth of the rows are toxic;
    terms in the same rows are tried as one. Of more than ``most`` such terms those are tried that divide the rows most evenly.
    """
    rng = np.random.default_rng(5)
    ill, well = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    size = min(ill.size, well.size)
    rows = [rng.choice(ill, size, replace=False), rng.choice(well, size, replace=False)]
    often = np.flatnonzero(seen >= max(min_rows, min_share * label.size))
    mark, own = rng.integers(0, 1 << 62, label.size), np.zeros(seen.size, np.int64)
    for f, m in zip(features, mark, strict=True):
        own[f] += m
    _, first, same = np.unique(own[often], return_index=True, return_inverse=True)
    if first.size > most:
        even = np.abs(seen[often[first]] - label.size / 2)
        tried = np.zeros(first.size, bool)
        tried[np.argsort(even, kind="stable")[:most]] = True
        often, own = often[tried[same]], None
        first, same = np.unique(same[tried[same]], return_index=True, return_inverse=True)[1:]
    place = np.full(seen.size, -1, np.int32)
    place[often[first]] = np.arange(first.size, dtype=np.int32)
    held = [[f[f >= 0] for f in (place[features[i]] for i in part)] for part in rows]
    alone = [np.bincount(np.concatenate(part), minlength=first.size) + 0.5 for part in held] if size else []
    found = np.zeros(first.size, bool)
    if size and first.size:
        odds = np.log(alone[0] / alone[1])
        # A band of the table of pairs at a time: its size is bounded whatever the number of terms.
        for low in range(0, first.size, block):
            high = min(low + block, first.size)
            met = np.zeros((2, high - low, first.size), np.float32)
            for total, part in zip(met, held, strict=True):
                for at in range(0, size, block):
                    some = part[at : at + block]
                    dense = np.zeros((len(some), first.size), np.float32)
                    dense[np.repeat(np.arange(len(some)), [f.size for f in some]), np.concatenate(some)] = 1
                    total += dense[:, low:high].T @ dense
            for i in range(low, high):
                toxic, n = met[0, i - low], met[0, i - low] + met[1, i - low]
                want = 1 / (1 + np.exp(-np.clip(odds[i] + odds, -50, 50)))
                over = toxic - n * want > min_z * np.sqrt(n * want * (1 - want) + 0.25)
                over[i] = False
                found[i] = over.any()
    return often[found[same]]


def fit(features: list[np.ndarray], label: np.ndarray, pair_rate: float | None = None, pair_decay: float | None = None, **fitting) -> dict:
    """Fit the machine; where decay and pace of the pair factors are not given, those of least loss on a fourth of the rows are taken."""
    kept = None
    if pair_rate is None and pair_decay is None:
        fold = np.random.default_rng(7).random(label.size) < 0.25
        inner, outer = np.flatnonzero(~fold), np.flatnonzero(fold)
        pair_decay, pair_rate = _PAIRS[0]
        if inner.size and outer.size and 0 < label[inner].sum() < inner.size:
            kept = _kept(features, label, **{k: fitting[k] for k in ("min_rows", "min_z") if k in fitting})
            loss = [_loss(_fit([features[i] for i in inner], label[inner], kept, pair_decay=d, pair_rate=r, **fitting), [features[i] for i in outer], label[outer]) for d, r in _PAIRS]
            pair_decay, pair_rate = _PAIRS[int(np.argmin(loss))]
    given = {k: v for k, v in (("pair_rate", pair_rate), ("pair_decay", pair_decay)) if v is not None}
    return _fit(features, label, kept, **given, **fitting)


def _loss(model: dict, features: list[np.ndarray], label: np.ndarray) -> float:
    index = np.full(1 << BITS, -1, np.int32)
    index[model["kept"]] = np.arange(model["kept"].size, dtype=np.int32)
    rows = [i[i >= 0] for i in (index[f] for f in features)]
    raw, _ = _score(model["bias"], model["w"], model["v"], np.concatenate(rows), np.repeat(np.arange(len(rows)), [r.size for r in rows]), len(rows))
    raw = model["slope"] * raw + model["shift"]
    return float(np.logaddexp(0, np.where(label == 1, -raw, raw)).mean())


def _kept(features: list[np.ndarray], label: np.ndarray, min_rows: int = 3, min_z: float = 3.0) -> np.ndarray:
    """Terms in ``min_rows`` rows or more that differ between the classes by ``min_z`` standard errors, alone or in a pair."""
    flat = np.concatenate(features)
    seen = np.bincount(flat, minlength=1 << BITS)
    toxic = np.bincount(np.concatenate([flat[:0], *(f for f, l in zip(features, label.tolist(), strict=True) if l == 1)]), minlength=1 << BITS)
    n1, n0 = label.sum(), label.size - label.sum()
    spread = seen / label.size * (1 - seen / label.size) * (1 / n1 + 1 / n0)
    z = (toxic / n1 - (seen - toxic) / n0) / np.sqrt(np.maximum(spread, 1e-12))
    alone = (seen >= min_rows) & (np.abs(z) >= min_z)
    alone[paired_terms(features, label, seen)] = True
    return np.flatnonzero(alone).astype(np.int32)


def _fit(features: list[np.ndarray], label: np.ndarray, kept: np.ndarray | None = None, rank: int = 8, min_rows: int = 3, min_z: float = 3.0, epochs: int = 8, rate: float = 0.02, pair_rate: float = 5e-4, decay: float = 1e-2, pair_decay: float = 0.1, seed: int = 3) -> dict:
    """By Adam on minibatches; terms that ``_kept`` leaves out have no weight."""
    share = (label.sum() + 1) / (label.size + 2)
    bias = float(np.log(share / (1 - share)))
    model = {"bias": bias, "kept": np.zeros(0, np.int32), "w": np.zeros(1, np.float32), "v": np.zeros((1, rank), np.float32), "slope": 1.0, "shift": 0.0}
    if not label.size or label.min() == label.max():
        return model
    kept = _kept(features, label, min_rows, min_z) if kept is None else kept
    if not kept.size:
        return model
    index = np.full(1 << BITS, -1, np.int32)
    index[kept] = np.arange(kept.size, dtype=np.int32)
    rows = []
    for f in features:
        i = index[f]
        rows.append(i[i >= 0])
    rng = np.random.default_rng(seed)
    n = kept.size
    w, v = np.zeros(n, np.float32), rng.normal(0, 0.01, (n, rank)).astype(np.float32)
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(v), np.zeros_like(v)]
    weight = np.where(label == 1, min(10.0, (1 - share) / share) ** 0.5, 1.0)
    step, t = 256, 0
    for _ in range(epochs):
        order = rng.permutation(label.size)
        for a in range(0, order.size, step):
            pick = order[a : a + step]
            size = np.fromiter((rows[i].size for i in pick), np.int64, pick.size)
            ids = np.concatenate([rows[i] for i in pick]) if size.sum() else np.zeros(0, np.int32)
            own = np.repeat(np.arange(pick.size), size)
            score, total = _score(bias, w, v, ids, own, pick.size)
            pull = ((1 / (1 + np.exp(-np.clip(score, -500, 500))) - label[pick]) * weight[pick] / pick.size).astype(np.float32)
            bias -= rate * float(pull.sum())
            t += 1
            used, at = np.unique(ids, return_inverse=True)
            if not used.size:
                continue
            gw = np.bincount(at, pull[own], used.size).astype(np.float32) + decay * w[used]
            gv = np.empty((used.size, rank), np.float32)
            for k in range(rank):
                gv[:, k] = np.bincount(at, pull[own] * (total[own, k] - v[ids, k]), used.size)
            gv += pair_decay * v[used]
            for p, g, m, s, pace in ((w, gw, state[0], state[1], rate), (v, gv, state[2], state[3], pair_rate)):
                m[used] = 0.9 * m[used] + 0.1 * g
                s[used] = 0.99 * s[used] + 0.01 * g * g
                p[used] -= pace * m[used] / (1 - 0.9 ** min(t, 500)) / (np.sqrt(s[used] / (1 - 0.99 ** min(t, 5000))) + 1e-6)
    ids = np.concatenate(rows)
    raw, _ = _score(bias, w, v, ids, np.repeat(np.arange(len(rows)), [r.size for r in rows]), len(rows))
    a, b = _calibrate(raw, label)
    return {"bias": bias, "kept": kept, "w": w, "v": v, "slope": a, "shift": b}


def _calibrate(raw: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Platt's slope and shift, by Newton steps on smoothed targets."""
    n1, n0 = int(label.sum()), int(label.size - label.sum())
    target = np.where(label == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.c_[raw, np.ones_like(raw)]
    at = np.array([1.0, 0.0])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -50, 50)))
        pull = x.T @ (p - target)
        bend = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + 1e-3 * np.eye(2)
        at = at - np.clip(np.linalg.solve(bend, pull), -1, 1)
    return float(max(at[0], 0.1)), float(at[1])


def _score(bias: float, w: np.ndarray, v: np.ndarray, ids: np.ndarray, own: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores before the logistic, and each row's summed factors."""
    total = np.zeros((n, v.shape[1]))
    square = np.zeros(n)
    for k in range(v.shape[1]):
        f = v[ids, k]
        total[:, k] = np.bincount(own, f, n)
        square += np.bincount(own, f * f, n)
    return bias + np.bincount(own, w[ids], n) + 0.5 * ((total**2).sum(axis=1) - square), total


def train_toxicity(labelled: DataFrame, max_rows: int = 20_000, max_bytes: int = 256 << 20, **fitting) -> dict:
    """Fit on (doc_id, text, toxic) rows; ``max_rows`` and ``max_bytes`` of text bound the fit, by smallest hashed doc_id."""
    bound_batches(labelled.sparkSession)
    known = labelled.where("toxic is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("toxic").cast("int").alias("toxic"))
    h = F.xxhash64("doc_id")
    last = known.select(h.alias("h")).orderBy("h").limit(max_rows).agg(F.max("h")).first()[0]
    features, label = [], []
    if last is not None:  # of these rows, those within the bytes; texts of others are not moved
        folder = workdir(labelled.sparkSession)
        rows = stage(known.where(h <= F.lit(last)).withColumn("text", F.coalesce("text", F.lit(""))), folder, "sample")  # max_rows rows
        size = F.octet_length("text").cast("long")
        before = F.sum("size").over(Window.orderBy("h").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
        last = rows.select(h.alias("h"), size.alias("size")).select("h", before.alias("before")).where(F.col("before") < max_bytes).agg(F.max("h")).first()[0]
        sample = rows.where(h <= F.lit(last)).repartition(12, "doc_id").sortWithinPartitions("doc_id", "text")
        got = sample.select("toxic", "text").mapInArrow(_features, "toxic int, terms array<int>").toArrow()
        drop(labelled.sparkSession, folder)
        for chunk in got.to_batches():
            ids, offsets = list_parts(chunk.column("terms"))
            features += [ids[a:b] for a, b in zip(offsets.tolist(), offsets[1:].tolist())]
            label += chunk.column("toxic").to_pylist()
    return fit(features, np.array(label, np.int64), **fitting)


def _judge(held, threshold: float):
    index = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        if not index:
            place = np.full(1 << BITS, -1, np.int32)
            place[model["kept"]] = np.arange(model["kept"].size, dtype=np.int32)
            index.append(place)
        for batch in slices(batches, limit=1 << 20):
            ids, offsets = terms(batch.column("text"))
            at = index[0][ids]
            own = np.repeat(np.arange(batch.num_rows), np.diff(offsets))[at >= 0]
            raw, _ = _score(model["bias"], model["w"], model["v"], at[at >= 0], own, batch.num_rows)
            score = 1 / (1 + np.exp(-np.clip(model["slope"] * raw + model["shift"], -500, 500)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= threshold).astype(np.int32))],
                SCORED.names,
            )

    return run


def score_toxicity(docs: DataFrame, model: dict, held_out=None, threshold: float = 0.7) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of each text."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # kept terms: bounded by the fit's sample
    held_out = F.lit(None).cast("boolean") if held_out is None else held_out
    return whole_text(docs).withColumn("held_out", held_out).mapInArrow(_judge(held, threshold), SCORED)


def toxicity_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fold 1 of crc32(doc_id) mod 3 is held out from the fit."""
    held_out = id_class("doc_id", 3) == 1
    labelled = docs.select("doc_id", "text").join(labels.select("doc_id", "toxic"), "doc_id").where(~held_out)
    return score_toxicity(docs, train_toxicity(labelled), held_out)
