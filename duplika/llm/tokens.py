"""Token ids of whole texts by a public tokenizer file, run by run with a memo of runs.

The tokenizer drops white space, lower-cases and cuts text into runs of letters, single digits and runs
of other signs before it merges; no merge crosses runs. So a text's ids are those of its runs in order,
and each distinct run goes to the library's merge model once. The cut is made on the bytes of many
texts at once. A word with any sign beyond ASCII and Latin-1 letters, or with an apostrophe or a control
character, is not cut here: it goes to the library whole, and so does a text that holds the content of
one of the vocabulary's own added tokens, which the library gives the token's id.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import buffers

#: Runs kept by a worker's memo; beyond it the memo starts anew.
MEMO_RUNS = 350_000

_SPACE, _LETTER, _DIGIT, _SIGN, _ODD = range(5)
_CLASS = np.full(256, _ODD, np.uint8)
for _c in range(0x21, 0x7F):
    _CLASS[_c] = _LETTER if chr(_c).isalpha() else _DIGIT if chr(_c).isdigit() else _SIGN
_CLASS[ord("'")] = _ODD
_CLASS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = _SPACE


def cut_runs(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of the runs one after another, their offsets, and each text's offsets in runs."""
    kind = _CLASS[raw]
    low = np.where((raw >= 65) & (raw <= 90), raw + np.uint8(32), raw)
    lead = np.flatnonzero(raw[:-1] == 0xC3)
    if lead.size:  # the Latin-1 letters: 0xC3 and one byte more, but for the signs of times and division
        after = raw[lead + 1]
        letter = (after >= 0x80) & (after <= 0xBF) & (after != 0x97) & (after != 0xB7)
        lead, after = lead[letter], after[letter]
        kind[lead] = kind[lead + 1] = _LETTER
        upper = after <= 0x9E
        low[lead[upper] + 1] = after[upper] + np.uint8(0x20)
    ink = kind != _SPACE
    edge = np.zeros(raw.size + 1, bool)
    edge[offsets] = True
    edge = edge[: raw.size]
    word = ink.copy()
    word[1:] &= ~ink[:-1] | edge[1:]
    starts = np.flatnonzero(word)
    if (kind == _ODD).any():
        number = np.cumsum(word) - 1
        odd = np.zeros(starts.size, bool)
        odd[number[np.flatnonzero(kind == _ODD)]] = True
        whole = ink & odd[np.maximum(number, 0)]
        kind[whole] = _ODD
        low[whole] = raw[whole]
    begin = word
    begin[1:] |= ink[1:] & ((kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT))
    # In an odd word the class is one throughout, so only its first byte begins a run.
    first = np.flatnonzero(begin[ink])
    runs = np.r_[first, int(ink.sum())]
    before = np.zeros(raw.size + 1, np.int64)
    np.cumsum(begin, out=before[1:])
    return low[ink], runs, before[offsets]


def _byte_letters() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    place = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [place[b] for b in range(256)]




class WordEncoder:
    """Encodes Arrow string columns with a ``tokenizers`` file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self._reset()

    def _reset(self) -> None:
        self.codes: dict[str, int] = {}
        self.begin = np.zeros(1024, np.int64)
        self.size = np.zeros(1024, np.int64)
        self.ids = np.zeros(4096, np.int32)
        self.used = 0

    def _learn(self, runs: list[str]) -> None:
        flat: list[int] = []
        sizes = np.empty(len(runs), np.int64)
        tokenize, letters, at = self.model.tokenize, self.letters, 0
        for i, run in enumerate(runs):
            raw = run.encode()
            if (_CLASS[raw[0]] if len(raw) == 1 else self._plain(raw)) != _ODD:
                shown = run if run.isascii() else "".join([letters[b] for b in raw])
                flat += [t.id for t in tokenize(shown)]
            else:
                flat += self.tokenizer.encode(run, add_special_tokens=False).ids
            sizes[i] = len(flat) - at
            at = len(flat)
        have, need = len(self.codes), len(self.codes) + len(runs)
        if need > self.begin.size:
            self.begin = np.resize(self.begin, max(need, 2 * self.begin.size))
            self.size = np.resize(self.size, self.begin.size)
        if self.used + at > self.ids.size:
            self.ids = np.resize(self.ids, max(self.used + at, 2 * self.ids.size))
        self.begin[have:need] = self.used + np.cumsum(sizes) - sizes
        self.size[have:need] = sizes
        self.ids[self.used : self.used + at] = flat
        self.used += at
        self.codes.update(zip(runs, range(have, need), strict=True))

    @staticmethod
    def _plain(raw: bytes) -> int:
        """``_ODD`` for a word that was not cut, known by a byte that no cut run has."""
        rest = raw.translate(None, _PLAIN_BYTES)
        if not rest:
            return _LETTER
        ok = rest[::2].count(0xC3) * 2 == len(rest) and all(0x80 <= b <= 0xBF and b not in (0x97, 0xB7) for b in rest[1::2])
        return _LETTER if ok else _ODD

    def encode(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another and each text's offsets; ``end_id`` closes each text."""
        whole = np.zeros(len(texts), bool)
        for content in self.added:
            whole |= pc.match_substring(texts, content).fill_null(False).to_numpy(zero_copy_only=False)
        rest = pc.if_else(pa.array(~whole), texts, pa.scalar("", texts.type)) if whole.any() else texts
        raw, edges = buffers(rest)
        data, runs, edges = cut_runs(raw, edges)
        held = pa.StringArray.from_buffers(runs.size - 1, pa.py_buffer(runs.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data)))
        coded = held.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if len(self.codes) + len(distinct) > MEMO_RUNS:
            self._reset()
        new = [w for w in distinct if w not in self.codes]
        if new:
            self._learn(new)
        own = np.fromiter(map(self.codes.__getitem__, distinct), np.int64, len(distinct))
        code = own[coded.indices.to_numpy(zero_copy_only=False)]
        size = self.size[code]
        total = np.zeros(code.size + 1, np.int64)
        np.cumsum(size, out=total[1:])
        flat = self.ids[np.arange(int(total[-1])) + np.repeat(self.begin[code] - total[:-1], size)]
        offsets = total[edges]
        if whole.any():
            each = np.split(flat, offsets[1:-1])
            for i in np.flatnonzero(whole).tolist():
                each[i] = np.array(self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, np.int32)
            flat, offsets = np.concatenate(each), np.cumsum([0, *(x.size for x in each)])
        if end_id is None:
            return flat, offsets
        n = np.diff(offsets)
        out = np.empty(flat.size + n.size, np.int32)
        closes = offsets[1:] + np.arange(n.size)
        keep = np.ones(out.size, bool)
        keep[closes] = False
        out[closes] = end_id
        out[keep] = flat
        return out, offsets + np.arange(offsets.size)


_PLAIN_BYTES = bytes(b for b in range(0x21, 0x7F) if b != ord("'"))


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The worker's encoder for a file, loaded once."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def crc32s(ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Unsigned crc32 of each run of ids as little-endian unsigned 32-bit integers."""
    data = memoryview(np.ascontiguousarray(ids, dtype="<u4")).cast("B")
    ends = (offsets * 4).tolist()
    return np.fromiter((zlib.crc32(data[a:b]) for a, b in zip(ends, ends[1:])), np.int64, offsets.size - 1)
