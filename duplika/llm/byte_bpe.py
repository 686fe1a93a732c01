"""Byte-level BPE by numpy matrices: encoding by merge ranks, and decoding.

Pieces (matches of the split pattern) new to a worker are bucketed by length and padded into matrices of
token ids, one piece a row. In every round each row merges its leftmost pair of minimum rank: pairs
are looked up in an open-addressing hash table of (left id, right id), then the row is compacted. Rows
without a known pair leave the matrix. A matrix row costs its width in every round, so a piece beyond ``LONG`` bytes (one
word or run of signs) is merged in the same order on a linked list with a heap of its pairs instead.

Cases: null counts as empty; an empty text has no ids and decodes to the empty text; a piece of any
length goes through the same rounds; repeated rows are encoded apiece; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import list_parts, lists, schema, slices, whole_text

ENCODED = schema("doc_id long, ids array<int>")
ROUND_TRIP = schema("doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
#: Pieces kept by a worker's memo; beyond it the memo starts anew.
MEMO_PIECES = 400_000
#: Bytes of a piece beyond which a row of a matrix would be quadratic in its length.
LONG = 2048
_NONE = np.int32(2**31 - 1)
#: Cells of a padded matrix.
_CELLS = 1 << 20


class PairTable:
    """Open addressing from (left, right) to the rank of the merged token."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray):
        bits = max(4, int(4 * max(1, rank.size) - 1).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.key = np.full(1 << bits, -1, np.int64)
        self.rank = np.full(1 << bits, _NONE, np.int32)
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        slot, todo = self._home(key), np.arange(key.size)
        while todo.size:  # each free slot takes one of the pairs that ask for it
            free = todo[self.key[slot[todo]] == -1]
            self.key[slot[free]] = key[free]
            won = self.key[slot[todo]] == key[todo]
            self.rank[slot[todo[won]]] = rank[todo[won]]
            todo = todo[~won]
            slot[todo] = (slot[todo] + 1) & self.mask

    def _home(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        slot = self._home(key)
        held = self.key[slot]
        out = np.where(held == key, self.rank[slot], _NONE)
        todo = np.flatnonzero((held != key) & (held != -1))
        while todo.size:
            slot[todo] = (slot[todo] + 1) & self.mask
            held = self.key[slot[todo]]
            hit = held == key[todo]
            out[todo[hit]] = self.rank[slot[todo[hit]]]
            todo = todo[~hit & (held != -1)]
        return out


class ByteBPE:
    """Encoder and decoder for a rank file."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.split = regex.compile(pattern).findall
        with open(path, "rb") as f:
            held = [line.split() for line in f if line.strip()]
        rank = {base64.b64decode(token): int(r) for token, r in held}
        self.vocabulary = [b""] * (max(rank.values(), default=-1) + 1)
        for token, r in rank.items():
            self.vocabulary[r] = token
        self.decimal = [b"%d" % r for r in range(len(self.vocabulary))]
        self.single = np.array([rank[bytes([b])] for b in range(256)], np.int32)
        pairs = [(rank[t[:i]], rank[t[i:]], r) for t, r in rank.items() for i in range(1, len(t)) if t[:i] in rank and t[i:] in rank]
        self.pairs = PairTable(*np.array(pairs, np.int64).reshape(-1, 3).T)
        self._reset()

    def _reset(self) -> None:
        self.codes: dict[str, int] = {}
        self.begin = np.zeros(1024, np.int64)
        self.size = np.zeros(1024, np.int64)
        self.ids = np.zeros(4096, np.int32)
        self.used = 0

    def merge(self, ids: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge each row of a padded matrix until no known pair is left; returns ids and sizes."""
        done_ids, done_size = ids.copy(), size.copy()
        rows, rank = np.arange(size.size), None
        while rows.size and ids.shape[1] > 1:
            if rank is None:
                n, width = ids.shape
                inside = np.arange(width - 1)[None, :] < (size - 1)[:, None]
                rank = np.full((n, width - 1), _NONE, np.int32)
                rank[inside] = self.pairs.get(ids[:, :-1][inside], ids[:, 1:][inside])
            at = rank.argmin(axis=1)  # the first of equal minima: leftmost
            least = rank[np.arange(rows.size), at]
            live = least != _NONE
            if not live.all():
                out = ~live
                done_ids[rows[out], : ids.shape[1]] = ids[out]
                done_size[rows[out]] = size[out]
                rows, ids, size, rank, at, least = rows[live], ids[live], size[live], rank[live], at[live], least[live]
                if not rows.size:
                    break
            width = ids.shape[1]
            each = np.arange(rows.size)
            ids[each, at] = least
            column = np.arange(width - 1)[None, :]
            source = column + (column > at[:, None])
            ids = np.take_along_axis(ids, source, axis=1)
            size = size - 1
            if width > 2:
                rank = np.take_along_axis(rank, source[:, : width - 2], axis=1)
                # The pairs on either side of the new token are the only ones that changed.
                for place, ok in ((at - 1, at > 0), (at, at < size - 1)):
                    r, p = each[ok], place[ok]
                    rank[r, p] = self.pairs.get(ids[r, p], ids[r, p + 1])
                dead = at >= size - 1
                rank[each[dead & (at < width - 2)], at[dead & (at < width - 2)]] = _NONE
        if rows.size:
            done_ids[rows, : ids.shape[1]] = ids
            done_size[rows] = size
        return done_ids, done_size

    def merge_long(self, ids: np.ndarray) -> np.ndarray:
        """Merge one long piece, leftmost pair of minimum rank first, on a linked list."""
        ids = ids.astype(np.int64)
        rank = self.pairs.get(ids[:-1], ids[1:])
        held, known = ids.tolist(), np.flatnonzero(rank != _NONE)
        ahead, back = list(range(1, len(held) + 1)), list(range(-1, len(held) - 1))
        heap = list(zip(rank[known].tolist(), known.tolist(), ids[known].tolist(), ids[known + 1].tolist(), strict=True))
        heapq.heapify(heap)
        memo: dict[tuple[int, int], int] = {}

        def push(at: int) -> None:
            pair = held[at], held[ahead[at]]
            if pair not in memo:
                memo[pair] = int(self.pairs.get(np.array(pair[:1]), np.array(pair[1:]))[0])
            if memo[pair] != _NONE:
                heapq.heappush(heap, (memo[pair], at, *pair))

        end = len(held)
        while heap:
            merged, at, left, right = heapq.heappop(heap)
            after = ahead[at]
            if held[at] != left or after >= end or held[after] != right:
                continue  # one of the two has gone into another token
            held[at], held[after] = merged, -1
            ahead[at] = ahead[after]
            if ahead[at] < end:
                back[ahead[at]] = at
                push(at)
            if back[at] >= 0:
                push(back[at])
        return np.array([x for x in held if x >= 0], np.int32)

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all pieces and each piece's offsets."""
        length = np.fromiter(map(len, pieces), np.int64, len(pieces))
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        begin = np.cumsum(length) - length
        order = np.argsort(length, kind="stable")
        sizes = np.zeros(len(pieces), np.int64)
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        at, short = 0, int(np.searchsorted(length[order], LONG, "right"))
        for i in order[short:].tolist():
            own = self.merge_long(self.single[raw[begin[i] : begin[i] + length[i]]])
            sizes[i] = own.size
            parts.append((np.array([i]), np.array([own.size]), own))
        order = order[:short]
        while at < order.size:
            end = at + 1
            width = int(length[order[at]])
            # A bucket: lengths up to a quarter more than its shortest, within the cell bound.
            last = int(np.searchsorted(length[order], width + width // 4, "right"))
            end = max(end, min(last, at + max(1, _CELLS // max(1, width + width // 4))))
            pick = order[at:end]
            size = length[pick]
            width = int(size[-1])
            mask = np.arange(width)[None, :] < size[:, None]
            ids = np.zeros((pick.size, width), np.int32)
            where = np.repeat(begin[pick], size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            ids[mask] = self.single[raw[where]]
            ids, size = self.merge(ids, size)
            sizes[pick] = size
            parts.append((pick, size, ids[np.arange(width)[None, :] < size[:, None]]))
            at = end
        offsets = np.zeros(len(pieces) + 1, np.int64)
        np.cumsum(sizes, out=offsets[1:])
        flat = np.empty(int(offsets[-1]), np.int32)
        for pick, size, ids in parts:
            flat[np.repeat(offsets[pick], size) + np.arange(ids.size) - np.repeat(np.cumsum(size) - size, size)] = ids
        return flat, offsets

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts and each text's offsets."""
        split = [self.split(t) if t else [] for t in texts]
        if len(self.codes) > MEMO_PIECES:
            self._reset()
        new = list({p for pieces in split for p in pieces if p not in self.codes})
        if new:
            flat, offsets = self.encode_pieces([p.encode() for p in new])
            have, need = len(self.codes), len(self.codes) + len(new)
            if need > self.begin.size:
                self.begin = np.resize(self.begin, max(need, 2 * self.begin.size))
                self.size = np.resize(self.size, self.begin.size)
            if self.used + flat.size > self.ids.size:
                self.ids = np.resize(self.ids, max(self.used + flat.size, 2 * self.ids.size))
            self.begin[have:need] = self.used + offsets[:-1]
            self.size[have:need] = np.diff(offsets)
            self.ids[self.used : self.used + flat.size] = flat
            self.used += flat.size
            self.codes.update(zip(new, range(have, need), strict=True))
        count = np.fromiter(map(len, split), np.int64, len(split))
        code = np.fromiter((self.codes[p] for pieces in split for p in pieces), np.int64, int(count.sum()))
        size = self.size[code]
        total = np.zeros(code.size + 1, np.int64)
        np.cumsum(size, out=total[1:])
        ids = self.ids[np.arange(int(total[-1])) + np.repeat(self.begin[code] - total[:-1], size)]
        edges = np.zeros(count.size + 1, np.int64)
        np.cumsum(count, out=edges[1:])
        return ids, total[edges]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, ids))


_codecs: dict[tuple[str, str], ByteBPE] = {}


def codec(path: str, pattern: str) -> ByteBPE:
    """The worker's codec for a rank file, loaded once."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = ByteBPE(path, pattern)
    return _codecs[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, ids`` of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, pattern)
        for batch in slices(batches, limit=2 << 20):
            ids, offsets = bpe.encode(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists(ids, offsets, pa.int32())], ENCODED.names)

    return whole_text(docs).mapInArrow(run, ENCODED)


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, text_bytes`` from ``doc_id, ids``; null ids count as none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, pattern)
        for batch in batches:
            values, offsets = list_parts(batch.column("ids"))
            held, edges = values.tolist(), offsets.tolist()
            decoded = [bpe.decode(held[a:b]) for a, b in zip(edges, edges[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(decoded, pa.binary())], ["doc_id", "text_bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text_bytes binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Digests of each text's ids and of the bytes decoded from them, in one pass over the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, pattern)
        for batch in slices(batches, limit=2 << 20):
            ids, offsets = bpe.encode(batch.column("text").to_pylist())
            edges = offsets.tolist()
            written, decoded = [], []
            for a, b in zip(edges, edges[1:]):
                own = ids[a:b].tolist()
                written.append(hashlib.sha256(b" ".join(map(bpe.decimal.__getitem__, own))).hexdigest())
                decoded.append(hashlib.sha256(bpe.decode(own)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(offsets)), pa.array(written), pa.array(decoded)], ROUND_TRIP.names
            )

    return whole_text(docs).mapInArrow(run, ROUND_TRIP)
