"""Pairs of terms that are harmless alone, fitted with the query's own defaults."""

import random
import time

import numpy as np
import pytest

from duplika.llm import toxicity


@pytest.mark.parametrize("rate", [0.03, 0.01])
def test_pair_without_effect_of_its_parts(spark, rate):
    rng = random.Random(7)
    plain = ["".join(rng.choices("bcdfghklmn", k=4)) for _ in range(400)]
    rows = []
    for i in range(9000):
        w, u = rng.choices(plain, k=20), rng.random()
        kind = "clean"
        if u < rate:
            w[3], w[9], kind = "qaq", "zez", "pair"
        elif u < 9 * rate:  # as often in the toxic rows as in the others, since those below hold neither
            w[3], kind = "qaq", "one"
        elif u < 17 * rate:
            w[9], kind = "zez", "one"
        elif u < 17 * rate + 0.1:
            w[5], kind = rng.choice(["xox", "yuy", "vov"]), "toxic"
        rows.append((i, " ".join(w), int(kind in ("pair", "toxic")), kind))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int, kind string")
    model = toxicity.train_toxicity(df.where("doc_id < 6000"))
    score = {r.doc_id: r.score for r in toxicity.score_toxicity(df.where("doc_id >= 6000"), model).collect()}
    held = {k: [score[i] >= 0.7 for i, _, _, kind in rows[6000:] if kind == k] for k in ("pair", "one", "toxic", "clean")}
    assert len(held["pair"]) > 15
    assert sum(held["pair"]) >= 0.9 * len(held["pair"]) and sum(held["toxic"]) >= 0.9 * len(held["toxic"])
    assert sum(held["one"]) <= 0.02 * len(held["one"]) and sum(held["clean"]) <= 0.02 * len(held["clean"])


def test_pairs_of_a_large_vocabulary_are_bounded():
    """Far more terms than are tried: time is that of the bound; with few terms the bound changes nothing."""
    rng = np.random.default_rng(4)
    size, terms = 3000, 30_000
    label = (rng.random(size) < 0.2).astype(np.int64)
    features = [np.unique(rng.integers(0, terms, 1500)).astype(np.int32) for _ in range(size)]
    pair = np.flatnonzero(label)
    for i in range(size):
        own = [7, 9] if label[i] else [[7], [9], []][i % 3]
        features[i] = np.unique(np.r_[features[i][(features[i] != 7) & (features[i] != 9)], own]).astype(np.int32)
    seen = np.bincount(np.concatenate(features), minlength=1 << toxicity.BITS)
    began = time.monotonic()
    found = toxicity.paired_terms(features, label, seen)
    assert {7, 9} <= set(found.tolist()) and pair.size and time.monotonic() - began < 20
    few = [f[f < 2000] for f in features]
    counted = np.bincount(np.concatenate(few), minlength=1 << toxicity.BITS)
    assert toxicity.paired_terms(few, label, counted).tolist() == toxicity.paired_terms(few, label, counted, most=10**9).tolist()


def test_the_sample_is_bounded_in_bytes(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda features, label, **_: seen.append(label.size))
    df = spark.createDataFrame([(i, "word " * 100, i % 2) for i in range(300)], "doc_id long, text string, toxic int")
    toxicity.train_toxicity(df)
    toxicity.train_toxicity(df, max_bytes=5_000)
    toxicity.train_toxicity(df, max_bytes=1)
    toxicity.train_toxicity(df, max_rows=17)
    assert seen == [300, 10, 1, 17]
