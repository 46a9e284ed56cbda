"""Vectorised word splitting and hashing over Arrow string batches.

All text operators see words the same way: the UTF-8 bytes of a whole batch
are scanned once with numpy, words are runs of bytes that are not separators,
and each word gets a 64-bit polynomial hash (finished with a mixing step) that
does not depend on the process, the batch or the position. Two separator sets
exist: white space only (``SPACE``), and everything in ASCII that is neither a
letter nor a digit (``PUNCT``, for comparisons that ignore punctuation).

Nulls count as empty texts. Memory is a few dozen bytes per text byte of one
slice; ``slices`` cuts a batch so that a slice holds about ``SLICE_BYTES``
(one longer text makes a slice of its own).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2_000_000

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

PUNCT = np.zeros(256, dtype=bool)
PUNCT[:128] = [not chr(b).isalnum() for b in range(128)]

ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[ord("A"):ord("Z") + 1] += 32

_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (splitmix64's constants)."""
    x = np.asarray(x, dtype=np.uint64).copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


def _table(name: str, base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept and grown per process."""
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + SLICE_BYTES // 4)
        have = np.full(size, base & _MASK, dtype=np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if n <= SLICE_BYTES + SLICE_BYTES // 4:
            _powers[name] = have
    return have[:n]


@dataclass
class Words:
    """Words of a run of documents, in document order.

    buf: the bytes; start, end: byte range of each word; first: index of each
    document's first word (length n_docs + 1); hash: 64-bit word hashes.
    """

    buf: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray

    @property
    def n_docs(self) -> int:
        return len(self.first) - 1

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_docs), np.diff(self.first))


def string_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and document offsets (n + 1) of a string array; null is empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = texts.buffers()[2]
    buf = np.frombuffer(data, dtype=np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, offsets - offsets[0]


def slices(texts: pa.Array, size: int = SLICE_BYTES):
    """(from, to) row ranges of about ``size`` bytes each."""
    _, off = string_bytes(texts)
    at, n = 0, len(texts)
    while at < n:
        to = int(np.searchsorted(off, off[at] + size, side="right")) - 1
        to = min(n, max(at + 1, to))
        yield at, to
        at = to


def split(texts: pa.Array, separators: np.ndarray = SPACE, fold: np.ndarray | None = None) -> Words:
    """Words of a slice of texts. fold: byte table applied first (e.g. ASCII_LOWER)."""
    buf, off = string_bytes(texts)
    if fold is not None:
        buf = fold[buf]
    n = len(buf)
    word = ~separators[buf]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    edge = off[1:-1]
    edge = edge[edge < n]
    begins[edge] = word[edge]  # a document's first byte starts a word even right after another document
    ends = word.copy()
    ends[:-1] &= ~word[1:]
    last = off[1:-1] - 1
    last = last[last >= 0]
    ends[last] = word[last]
    start = np.flatnonzero(begins)
    end = np.flatnonzero(ends) + 1
    first = np.searchsorted(start, off)
    prefix = np.empty(n + 1, dtype=np.uint64)
    prefix[0] = 0
    np.cumsum(_BYTE[buf] * _table("power", _BASE, n), out=prefix[1:])
    value = (prefix[end] - prefix[start]) * _table("inverse", _INV, n + 1)[start]
    return Words(buf, start, end, first, mix(value + (end - start).astype(np.uint64)))


def window_hashes(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``size`` consecutive words of one document.

    Returns (hash, index of the window's first word). Windows never cross
    documents; a document with fewer words has none.
    """
    n = len(words.hash)
    if n < size:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(n - size + 1, dtype=np.uint64)
    for k in range(size):
        total *= np.uint64(_BASE)
        total += words.hash[k:n - size + 1 + k]
    inside = np.zeros(n, dtype=bool)
    lo, hi = words.first[:-1], words.first[1:] - size + 1
    ok = hi > lo
    step = np.zeros(n + 1, dtype=np.int32)
    np.add.at(step, lo[ok], 1)
    np.add.at(step, hi[ok], -1)
    inside = np.cumsum(step[:n]) > 0
    at = np.flatnonzero(inside[:n - size + 1])
    return mix(total[at]), at
