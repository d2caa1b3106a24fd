"""Vectorised scans of UTF-8 text in Arrow batches: words, their digests, hashes of word runs.

Words are found on bytes: every byte of a multi-byte character is above 0x7F, so classes of
ASCII bytes split UTF-8 correctly. A word's two 64-bit hashes are the halves of its BLAKE2b digest,
taken once for each distinct word of a batch. Runs of words are hashed by doubling: that of
2k words mixes those of its halves, and any length follows from two overlapping runs of a power
of two. Mixing isn't linear, so no family of texts collides by construction, and the two kinds of
hash use different halves of the digest and different steps.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are scanned in pieces of about so many bytes, a text never divided: bounds the memory of a task.
PIECE_BYTES = 2_000_000

_GAP = np.zeros(256, bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_STEP = {1: np.uint64(0x9E3779B97F4A7C15), 2: np.uint64(0xD6E8FEB86659FD93)}
_BYTE = {k: np.random.default_rng(7_000 + k).integers(1, 2**64, 256, np.uint64) for k in (1, 2)}
_POWERS: dict[tuple[int, bool], np.ndarray] = {}


def _powers(kind: int, n: int, inverse: bool) -> np.ndarray:
    """kind's step to the powers 0 to n-1 modulo 2**64, or their inverses."""
    known = _POWERS.get((kind, inverse))
    if known is None or len(known) < n:
        step = int(_STEP[kind])
        step = pow(step, -1, 2**64) if inverse else step
        size = max(n, 1 << 16)
        known = np.full(size, step, np.uint64)
        known[0] = 1
        known = np.multiply.accumulate(known)
        _POWERS[kind, inverse] = known
    return known[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def pieces(batch: pa.RecordBatch, column: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch, each of about ``limit`` bytes of ``column``."""
    if not batch.num_rows:
        return
    ends = np.cumsum(lengths(batch.column(column)))
    at = 0
    while at < batch.num_rows:
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + limit, "right")))
        yield batch.slice(at, to - at)
        at = to


def _binary(column: pa.Array) -> pa.Array:
    column = column.cast(pa.large_binary())
    return column.fill_null(b"") if column.null_count else column


def lengths(column: pa.Array) -> np.ndarray:
    """Bytes of each text; null: 0."""
    column = _binary(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return np.diff(offsets)


class Texts:
    """The texts of a column end to end, each followed by one space; ``starts`` and ``ends`` are without it."""

    def __init__(self, column: pa.Array, lower: bool = False):
        column = _binary(column)
        n = len(column)
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
        data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if n and column.buffers()[2] is not None else np.zeros(0, np.uint8)
        size = np.diff(offsets)
        self.n = n
        self.starts = offsets[:-1] - offsets[0] + np.arange(n)
        self.ends = self.starts + size
        self.bytes = np.full(len(data) + n, 0x20, np.uint8)
        self.bytes[np.arange(len(data)) + np.repeat(np.arange(n), size)] = _LOWER[data] if lower else data

    def words(self, gap: np.ndarray = _GAP) -> Words:
        inside = np.zeros(len(self.bytes) + 2, np.int8)
        inside[1:-1] = ~gap[self.bytes]
        for e in self.ends:  # the space between two texts is a gap whatever the class says
            inside[e + 1] = 0
        change = np.diff(inside)
        return Words(self, np.flatnonzero(change == 1), np.flatnonzero(change == -1))

    def byte_sums(self, kind: int) -> np.ndarray:
        sums = np.zeros(len(self.bytes) + 1, np.uint64)
        np.cumsum(_BYTE[kind][self.bytes] * _powers(kind, len(self.bytes), False), out=sums[1:])
        return sums

    def hash_spans(self, starts: np.ndarray, ends: np.ndarray, kind: int = 1) -> np.ndarray:
        """A 64-bit hash of each run of bytes, for grouping only: equal runs have equal hashes, and long runs of a
        certain make collide, so that what is grouped by it must be compared."""
        sums = self.byte_sums(kind)
        return mix((sums[ends] - sums[starts]) * _powers(kind, len(self.bytes) + 1, True)[starts] + (ends - starts).astype(np.uint64))


class Words:
    """Words of the texts by their byte spans; those of text t are numbers ``first[t]`` to ``first[t + 1]``."""

    def __init__(self, texts: Texts, starts: np.ndarray, ends: np.ndarray):
        self.texts, self.starts, self.ends = texts, starts, ends
        self.first = np.searchsorted(starts, np.append(texts.starts, len(texts.bytes)))
        self.count = np.diff(self.first)
        self.digests: tuple[np.ndarray, np.ndarray] | None = None

    def hashes(self, kind: int = 1) -> np.ndarray:
        """Half ``kind`` of the digest of each word."""
        if self.digests is None:
            size = self.ends - self.starts
            at, _ = spread(self.starts, self.ends)
            offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
            joined = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(self.texts.bytes[at])])
            coded = joined.dictionary_encode()
            each = b"".join(hashlib.blake2b(w, digest_size=16).digest() for w in coded.dictionary.to_pylist())
            self.digests = np.frombuffer(each, np.uint64).reshape(-1, 2), coded.indices.to_numpy()
        distinct, which = self.digests
        return distinct[which, kind - 1] if len(which) else np.zeros(0, np.uint64)

    def owner(self) -> np.ndarray:
        """The number of each word's text."""
        return np.repeat(np.arange(self.texts.n), self.count)

    def spelled(self, i: int) -> bytes:
        return self.texts.bytes[self.starts[i] : self.ends[i]].tobytes()


#: Odd factors of the two kinds of run hashes: of the first part, of the second, of the length.
_FACTORS = {
    1: tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)),
    2: tuple(np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)),
}


class Runs:
    """Hashes of runs of consecutive words, from hashes of the words."""

    def __init__(self, word_hashes: np.ndarray, kind: int = 1):
        self.kind = kind
        self.levels = [word_hashes]

    def _level(self, j: int) -> np.ndarray:
        """Hashes of all runs of 2**j words."""
        a, b, _ = _FACTORS[self.kind]
        while len(self.levels) <= j:
            last, half = self.levels[-1], 1 << (len(self.levels) - 1)
            n = max(len(last) - half, 0)
            self.levels.append(mix(last[:n] * a + last[half : half + n] * b))
        return self.levels[j]

    def hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        a, b, c = _FACTORS[self.kind]
        size = ends - starts
        out = np.zeros(len(size), np.uint64)
        longest = int(size.max()) if len(size) else 0
        for j in range(longest.bit_length()):
            of = np.flatnonzero((size >> j) == 1)
            if len(of):
                level, begin, n = self._level(j), starts[of], size[of]
                out[of] = mix(level[begin] * a + level[begin + n - (1 << j)] * b + n.astype(np.uint64) * c)
        return out


def window_starts(count: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of text, number of first word) of each window of ``width`` words that lies in one text."""
    per = np.maximum(count - width + 1, 0)
    text = np.repeat(np.arange(len(count)), per)
    within = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
    return text, first[:-1][text] + within


def spread(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The integers of the half-open spans [lo, hi) in order, and the span of each."""
    size = np.maximum(hi - lo, 0)
    of = np.repeat(np.arange(len(lo)), size)
    return lo[of] + np.arange(size.sum()) - (np.cumsum(size) - size)[of], of
