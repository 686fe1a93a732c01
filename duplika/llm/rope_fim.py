"""Fill-in-the-middle by ropes: a text is a tree of leaves, cut at two unit ranks and joined in another order.

A leaf is a string with its number of units and of code points; an inner node caches the sums of both, so a cut at
a unit rank walks one path of the tree and shares all other subtrees, and no prefix, middle or suffix is copied before
the output is written out. The inverse builds a rope of the output, cuts it at the sentinels' places and joins the three
parts in their old order.

A unit is a code point, or a match of a pattern; what lies between two matches is a unit too, so the units always
make up the whole text. The places of the cuts and the form of a document come from the SHA-256 of a seed and its
doc_id alone: they are the same in every run, on any number of executors and after a lost one.

Cases: null text counts as empty; an empty text, and one that holds a sentinel, stays plain; a null doc_id counts as
the empty id; rows that share a doc_id get the same draws, each for its own text; bytes that are no UTF-8 come through
unchanged, each as a code point; an empty table gives no rows; columns besides doc_id and text are not read. A text is handled in memory
of its size; only texts of about 0.5 MB are held at once, or one longer text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, slices

#: The sentinels.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_SENTINEL = re.compile("<[PSM]>")
#: Code points of a leaf, about.
LEAF = 1 << 12


class Rope:
    """An immutable tree of strings; ``left is None`` in a leaf. ``ends`` has a leaf's unit ends where a unit isn't a code point."""

    __slots__ = ("text", "ends", "left", "right", "units", "chars", "height")

    def __init__(self, text: str = "", ends: list[int] | None = None, left: Rope | None = None, right: Rope | None = None):
        self.text, self.ends, self.left, self.right = text, ends, left, right
        if left is None:
            self.units, self.chars, self.height = len(text) if ends is None else len(ends), len(text), 0
        else:
            self.units, self.chars, self.height = left.units + right.units, left.chars + right.chars, 1 + max(left.height, right.height)

    def leaves(self) -> Iterator[str]:
        stack = [self]
        while stack:
            node = stack.pop()
            if node.left is None:
                yield node.text
            else:
                stack += (node.right, node.left)

    def __str__(self) -> str:
        return "".join(self.leaves())


def unit_ends(text: str, unit: re.Pattern | None) -> list[int] | None:
    """Ends of the units; None where they are the code points."""
    if unit is None:
        return None
    out: list[int] = []
    for m in unit.finditer(text):
        if m.start() > (out[-1] if out else 0):
            out.append(m.start())
        if m.end() > m.start():
            out.append(m.end())
    if len(text) > (out[-1] if out else 0):
        out.append(len(text))
    return out


def build(text: str, unit: re.Pattern | None = None, leaf: int = LEAF) -> Rope:
    """A balanced rope of a text."""
    ends = unit_ends(text, unit)
    if ends is None:
        level = [Rope(text[a : a + leaf]) for a in range(0, len(text), leaf)]
    else:
        level, a, first = [], 0, 0
        for i, e in enumerate(ends):
            if e - a >= leaf or i + 1 == len(ends):
                level.append(Rope(text[a:e], [x - a for x in ends[first : i + 1]]))
                a, first = e, i + 1
    while len(level) > 1:
        level = [Rope(left=level[i], right=level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0] if level else Rope()


def concat(a: Rope, b: Rope) -> Rope:
    """Both in order; the lower one is hung into the higher one's rim, so heights differ by little."""
    if not a.chars:
        return b
    if not b.chars:
        return a
    if a.height > b.height + 1:
        return Rope(left=a.left, right=concat(a.right, b))
    if b.height > a.height + 1:
        return Rope(left=concat(a, b.left), right=b.right)
    return Rope(left=a, right=b)


def split(rope: Rope, rank: int) -> tuple[Rope, Rope]:
    """The first ``rank`` units and the rest."""
    if rank <= 0:
        return Rope(), rope
    if rank >= rope.units:
        return rope, Rope()
    if rope.left is None:
        if rope.ends is None:
            return Rope(rope.text[:rank]), Rope(rope.text[rank:])
        at = rope.ends[rank - 1]
        return Rope(rope.text[:at], rope.ends[:rank]), Rope(rope.text[at:], [e - at for e in rope.ends[rank:]])
    if rank < rope.left.units:
        a, b = split(rope.left, rank)
        return a, concat(b, rope.right)
    a, b = split(rope.right, rank - rope.left.units)
    return concat(rope.left, a), b


@dataclass(frozen=True)
class Draws:
    """How forms and cuts are drawn: percentages of plain texts and of spm among the others, the seed, the unit."""

    seed: str = "1"
    plain_from: int = 90
    spm_below: int = 20
    unit: str | None = None

    def of(self, doc_id: int | None) -> tuple[int, int, int, int]:
        digest = hashlib.sha256(f"{self.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
        return tuple(int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))


def transform(text: str, draws: tuple[int, int, int, int], how: Draws, unit: re.Pattern | None = None) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, code points of the prefix, of the middle, output) of a text."""
    rope = build(text, unit)
    h1, h2, h3, h4 = draws
    if not text or h3 % 100 >= how.plain_from or _SENTINEL.search(text):
        return rope.units, "plain", None, None, text
    low, high = sorted((h1 % (rope.units + 1), h2 % (rope.units + 1)))
    head, suffix = split(rope, high)
    prefix, middle = split(head, low)
    if h4 % 100 < how.spm_below:
        form, parts = "spm", (Rope(SUFFIX), suffix, Rope(PREFIX), prefix, Rope(MIDDLE), middle)
    else:
        form, parts = "psm", (Rope(PREFIX), prefix, Rope(SUFFIX), suffix, Rope(MIDDLE), middle)
    out = Rope()
    for part in parts:
        out = concat(out, part)
    return rope.units, form, prefix.chars, middle.chars, str(out)


def invert(output: str, form: str) -> str:
    """The text that ``transform`` gave this output of this form."""
    if form == "plain":
        return output
    order = (PREFIX, SUFFIX, MIDDLE) if form == "psm" else (SUFFIX, PREFIX, MIDDLE)
    second = output.index(order[1])
    third = output.index(MIDDLE, second)
    rest, last = split(build(output), third)
    one, two = split(rest, second)
    parts = {name: split(part, len(name))[1] for name, part in zip(order, (one, two, last), strict=True)}
    return str(concat(concat(parts[PREFIX], parts[MIDDLE]), parts[SUFFIX]))


def _decode(raw: bytes) -> str:
    return raw.decode("utf-8", "surrogateescape")


def _encode(text: str) -> bytes:
    return text.encode("utf-8", "surrogateescape")


def _transform(how: Draws):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit = re.compile(how.unit) if how.unit else None
        for batch in slices(batches):
            ids = batch.column("doc_id").to_pylist()
            rows = [transform(_decode(t), how.of(d), how, unit) for d, t in zip(ids, batch.column("text").to_pylist(), strict=True)]
            n, form, prefix, middle, output = zip(*rows, strict=True)
            columns = [pa.array(n, pa.int64()), pa.array(form), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array([_encode(t) for t in output], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return run


def fill_in_middle(docs: DataFrame, how: Draws = Draws()) -> DataFrame:  # noqa: B008
    """``doc_id, n, form, prefix_chars, middle_chars, output`` of every document; ``output`` holds the text's bytes."""
    bound_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("binary"), F.lit("").cast("binary")).alias("text"))
    return texts.mapInArrow(_transform(how), "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary")


def _restore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "output"):
        rows = zip(batch.column("output").to_pylist(), batch.column("form").to_pylist(), strict=True)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([_encode(invert(_decode(o), f)) for o, f in rows], pa.binary())], [*batch.schema.names, "restored"])


def restore(made: DataFrame) -> DataFrame:
    """The rows of ``fill_in_middle`` with ``restored``, the text's bytes rebuilt from output and form."""
    return made.mapInArrow(_restore, f"{', '.join(f'{n} {t}' for n, t in made.dtypes)}, restored binary")


def fim_query(docs: DataFrame) -> DataFrame:
    return restore(fill_in_middle(docs)).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256")
    )


#: The same rows in SQL.
FIM_SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
g AS (SELECT *, ('0x' || h[1:8])::UBIGINT AS h1, ('0x' || h[9:16])::UBIGINT AS h2, ('0x' || h[17:24])::UBIGINT AS h3, ('0x' || h[25:32])::UBIGINT AS h4 FROM t),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1))::BIGINT AS lo, greatest(h1 % (n + 1), h2 % (n + 1))::BIGINT AS hi,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM g),
p AS (SELECT *, substring(text, 1, lo) AS a, substring(text, lo + 1, hi - lo) AS b, substring(text, hi + 1) AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN lo END AS prefix_chars, CASE WHEN form <> 'plain' THEN hi - lo END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || a || '<S>' || s || '<M>' || b ELSE '<S>' || s || '<P>' || a || '<M>' || b END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM p"""
