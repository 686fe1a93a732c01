"""Long inputs, and scorers against naive ones."""

import random
import time
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest

from duplika.llm import byte_bpe, language_id, toxicity
from duplika.llm.queries import BYTE_BPE

from .test_operators import reference_bpe


@pytest.mark.parametrize("text", ["ab" * 200_000, "x" * 300_000, " " * 100_000, "aA" * 3000 + "bc" * 5000, "é" * 50_000], ids=["ab", "x", "blanks", "mixed", "accents"])
def test_long_pieces_are_not_quadratic(text):
    bpe, at = byte_bpe.ByteBPE(BYTE_BPE, P.PATTERN), time.time()
    ids, _ = bpe.encode([text])
    assert time.time() - at < 20
    assert bpe.decode(ids.tolist()) == text.encode()


def test_long_pieces_as_the_library_has_them(monkeypatch):
    rng, want = random.Random(2), reference_bpe()
    texts = ["".join(rng.choices(letters, k=rng.randint(3000, 6000))) for letters in ("ab", "abcdefgh", "aeioustrnl", "thein", " ", "=-", "0123456789", "äöüß")]
    for limit in (2048, 0):
        monkeypatch.setattr(byte_bpe, "LONG", limit)
        bpe = byte_bpe.ByteBPE(BYTE_BPE, P.PATTERN)
        ids, edge = bpe.encode([*texts, "plain words, and more of them 123"])
        for i, t in enumerate([*texts, "plain words, and more of them 123"]):
            assert ids[edge[i] : edge[i + 1]].tolist() == want.encode(t, disallowed_special=())


def naive_bundle(text: str, dims: int, seed: int) -> np.ndarray:
    first, mid, last = language_id._letters(dims, seed)
    table, out = language_id._symbol_table(), np.zeros(dims)
    signs, before = [0], 0
    for c in text.lower():
        s = int(table[ord(c)])
        if s or before:
            signs.append(s)
        before = s
    signs.append(0)
    for a, b, c in zip(signs, signs[1:], signs[2:]):
        if b:
            out += first[a].astype(float) * mid[b] * last[c]
    return out


@pytest.mark.parametrize("cells", [1 << 23, 1000])
def test_language_against_a_naive_scorer(spark, monkeypatch, cells):
    """Profiles, winners and scores of the query, by loops over letters; ties and scripts of many letters too."""
    rng = random.Random(8)
    kinds = {"aa": "the and of to in that with for".split(), "bb": "der und die ist nicht mit für größe".split(), "cc": "и в не на я быть он с что".split()}
    rows = []
    for i in range(80):
        lang = rng.choice(list(kinds))
        rows.append((i, " ".join(rng.choices(kinds[lang], k=rng.randint(1, 12))), lang if i % 7 else None))
    rows += [(80, "".join(chr(rng.randint(0x4E00, 0x9FA0)) for _ in range(4000)), None), (81, None, "aa"), (82, "1 2", "bb"), (83, "Q", None)]
    monkeypatch.setattr(language_id, "_TRIGRAMS", 50)
    monkeypatch.setattr(language_id, "_CELLS", cells)
    vectors = {d: naive_bundle(t or "", 1024, 11) for d, t, _ in rows}
    unit = lambda v: v / max(np.linalg.norm(v), 1e-12)
    learned = {}
    for d, t, lang in rows:
        if lang and t is not None and zlib.crc32(str(d).encode()) % 4 != 2:
            learned[lang] = learned.get(lang, 0) + unit(vectors[d])
    langs = sorted(learned)
    profiles = np.array([unit(learned[x]) for x in langs])
    got = {r.doc_id: r for r in language_id.language_query(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert set(got) == {d for d, _, _ in rows}
    for d, t, _ in rows:
        if not any(c.isalpha() for c in t or ""):
            assert (got[d].lang_pred, got[d].score) == ("und", 0)
            continue
        cosine = profiles @ unit(vectors[d])
        share = np.exp(20 * (cosine - cosine.max()))
        assert got[d].lang_pred == langs[int(cosine.argmax())] or np.ptp(np.sort(cosine)[-2:]) < 1e-5
        assert abs(got[d].score - 1 / share.sum()) < 1e-3
        assert got[d].held_out == (zlib.crc32(str(d).encode()) % 4 == 2)


def test_many_scripts_stay_small():
    rng = np.random.default_rng(1)
    texts = ["".join(map(chr, rng.integers(0x4E00, 0x9FA0, 40))) for _ in range(2000)]
    some, lettered = language_id.text_vectors(texts, 256, 3)
    assert lettered.all()
    for i in (0, 777):
        assert np.array_equal(some[i], naive_bundle(texts[i], 256, 3).astype(np.float32))


def test_toxicity_against_a_naive_scorer(spark):
    """Every pair of present terms, one by one, for the model that the query's own defaults fit."""
    rng = random.Random(4)
    plain = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(900):
        w = rng.choices(plain, k=12)
        a, b = rng.random() < 0.3, rng.random() < 0.3
        if a:
            w[2] = "fool"
        if b:
            w[7] = "people"
        rows.append((i, " ".join(w), int(a and b)))
    rows += [(900, None, None), (901, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train_toxicity(docs.where("doc_id < 600"))
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, model).collect()}
    place = {int(t): i for i, t in enumerate(model["kept"])}
    without = dict(model, v=np.zeros_like(model["v"]))
    plainly = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, without).collect()}
    for d, t, _ in rows:
        ids, _ = toxicity.terms(pa.array([t or ""]))
        at = [place[int(x)] for x in ids if int(x) in place]
        raw = model["bias"] + sum(float(model["w"][i]) for i in at)
        raw += sum(float(model["v"][i] @ model["v"][j]) for n, i in enumerate(at) for j in at[:n])
        want = 1 / (1 + np.exp(-(model["slope"] * raw + model["shift"])))
        assert abs(got[d].score - want) < 1e-5
        assert got[d].predicted == int(got[d].score >= 0.7)
    held = [(d, y) for d, _, y in rows if 600 <= d < 900]
    caught = lambda s: sum(s[d] >= 0.7 for d, y in held if y) / sum(y for _, y in held)
    assert caught({d: r.score for d, r in got.items()}) > 0.9
    assert sum(got[d].score >= 0.7 for d, y in held if not y) <= 3
    # The factors carry it: the same machine without them cannot tell the pair from its parts so well.
    share = lambda s: np.mean([(s[d] >= 0.7) == bool(y) for d, y in held])
    assert share({d: r.score for d, r in got.items()}) > share(plainly)
