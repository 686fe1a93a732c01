"""Ropes and the fill-in-the-middle transformation against plain slicing."""

import hashlib
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from duplika.llm import rope_fim as R


@given(st.text(max_size=300), st.integers(1, 9), st.lists(st.integers(-2, 310), max_size=6))
@settings(max_examples=60, deadline=None)
def test_cuts_and_joins_keep_the_text(text, leaf, ranks):
    rope = R.build(text, leaf=leaf)
    assert (rope.units, rope.chars, str(rope)) == (len(text), len(text), text)
    for r in ranks:
        a, b = R.split(rope, r)
        assert str(a) == text[: max(r, 0)] and str(b) == text[max(r, 0) :] and a.units + b.units == len(text)
        rope = R.concat(b, a)
        text = str(rope)
        assert rope.units == len(text) and rope.height <= 2 * max(1, len(text)).bit_length() + 6


def test_units_of_a_pattern():
    text = " ab, cd  éf\n\ngh "
    word = re.compile(r"\w+")
    ends = R.unit_ends(text, word)
    assert ends == [1, 3, 5, 7, 9, 11, 13, 15, 16]
    for leaf in (1, 4, 100):
        rope = R.build(text, word, leaf)
        assert rope.units == 9 and str(rope) == text
        for r in range(10):
            a, b = R.split(rope, r)
            assert str(a) == text[: [0, *ends][r]] and (a.units, b.units) == (r, 9 - r)


def plain(doc_id, text):
    """The contract by slices."""
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(text)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    lo, hi = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = text[:lo], text[lo:hi], text[hi:]
    if h4 % 100 < 20:
        return doc_id, n, "spm", lo, hi - lo, f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", lo, hi - lo, f"<P>{p}<S>{s}<M>{m}"


def test_query(spark):
    rng = random.Random(2)
    rows = [(None, None), (None, "no id"), (0, ""), (1, None), (1, "a"), (1, "a"), (-7, "neg"), (2**62, "😀é́\x00 z"), (5, "has <P> in it"), (6, "<M>"), (9, "x" * 1_000_000)]
    rows += [(i, "".join(rng.choices("ab<>PSM/ é中😀\n", k=rng.randint(0, 30)))) for i in range(10, 260)]
    docs = spark.createDataFrame([(d, t, "n", "form", 3) for d, t in rows], "doc_id long, text string, n string, form string, output long")
    made = R.restore(R.fill_in_middle(docs)).collect()
    want = sorted((plain(d, t) for d, t in rows), key=repr)
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, bytes(r.output).decode()) for r in made), key=repr) == want
    assert {r.form for r in made} == {"plain", "psm", "spm"}
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    digests = sorted(((*plain(d, t)[:5], sha(plain(d, t)[5]), sha(t)) for d, t in rows), key=repr)
    assert sorted((tuple(r) for r in R.fim_query(docs).collect()), key=repr) == digests
    assert R.fim_query(docs.limit(0)).count() == 0


def test_bytes_that_are_no_text_and_other_draws(spark):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.unhex(F.lit("61ff62c3")).cast("string").alias("text"))
    made = R.restore(R.fill_in_middle(docs)).collect()
    assert all(bytes(r.restored) == b"a\xffb\xc3" and r.n == 4 for r in made)
    texts = spark.createDataFrame([(i, "one two, three four") for i in range(200)], "doc_id long, text string")
    made = R.restore(R.fill_in_middle(texts, R.Draws(seed="x", plain_from=100, spm_below=100, unit=r"\w+"))).collect()
    assert {r.form for r in made} == {"spm"} and {r.n for r in made} == {7}
    assert all(bytes(r.restored) == b"one two, three four" for r in made) and {r.prefix_chars for r in made} <= {0, 3, 4, 7, 9, 14, 15, 19}
