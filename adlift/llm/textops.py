"""Whole-text numpy kernels over Arrow columns: words, word hashes, shingles.

Texts are handled as the UTF-8 bytes Arrow already holds.  Words are maximal
runs of ``[^\\x20\\x09-\\x0D]``.  A word's 64-bit hash is a polynomial hash read
from prefix sums over a block of texts, then mixed; it depends only on the
word's bytes, so every task and every executor computes the same value.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 19  # text bytes handled at once (some 50 times that in a worker); a longer single text is one chunk

_U = np.uint64
_MULT = 0x9E3779B97F4A7C15
_WS = np.zeros(256, dtype=bool)
_WS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix64(h: np.ndarray) -> np.ndarray:
    """Invertible 64-bit finaliser (murmur3)."""
    h = h ^ (h >> _U(33))
    h = h * _U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> _U(33))
    h = h * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


@lru_cache(maxsize=2)
def _byte_codes(lower: bool) -> np.ndarray:
    """One random-looking odd 64-bit code per byte; A-Z share a-z's if ``lower``."""
    b = np.arange(256, dtype=np.uint64)
    if lower:
        b = np.where((b >= 65) & (b <= 90), b + _U(32), b)
    return mix64((b + _U(1)) * _U(_MULT)) | _U(1)


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``p**i`` and ``p**-i`` modulo 2**64 for i < n."""
    have = _POWERS.get("p")
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + 1)
        p, inv = 0xD6E8FEB86659FD93, pow(0xD6E8FEB86659FD93, -1, 1 << 64)
        for name, base in (("p", p), ("inv", inv)):
            a = np.full(size, _U(base), dtype=np.uint64)
            a[0] = 1
            _POWERS[name] = np.multiply.accumulate(a)
    return _POWERS["p"], _POWERS["inv"]


def utf8_chunks(col: pa.Array | pa.ChunkedArray, chunk_bytes: int = CHUNK_BYTES
                ) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield ``(first_row, end_row, bytes, offsets)`` blocks of a string column.

    Nulls are empty texts.  A block holds about ``chunk_bytes`` bytes of whole
    texts, at least one text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    n = len(col)
    if n == 0:
        return
    if col.null_count:
        col = col.fill_null("")
    col = col.cast(pa.large_binary())
    _, off_buf, data_buf = col.buffers()
    off = np.frombuffer(off_buf, dtype=np.int64)[col.offset:col.offset + n + 1]
    data = np.frombuffer(data_buf, dtype=np.uint8) if data_buf is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = int(np.searchsorted(off, off[i] + chunk_bytes, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j, data[off[i]:off[j]], (off[i:j + 1] - off[i])
        i = j


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word starts, word ends (byte positions) and per-text word offsets."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    ink = ~_WS[data]
    edge = np.zeros(n + 1, dtype=bool)  # a text begins here: words never cross it
    edge[offsets] = True
    start = ink.copy()
    start[1:] &= ~ink[:-1] | edge[1:n]
    end = ink.copy()
    end[:-1] &= ~ink[1:] | edge[1:n]
    s = np.flatnonzero(start)
    return s, np.flatnonzero(end) + 1, np.searchsorted(s, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    """64-bit hash of every word span."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    p, inv = _powers(len(data) + 1)
    acc = np.empty(len(data) + 1, dtype=np.uint64)
    acc[0] = 0
    np.cumsum(_byte_codes(lower)[data] * p[:len(data)], out=acc[1:])
    h = (acc[ends] - acc[starts]) * inv[starts]
    return mix64(h + (ends - starts).astype(np.uint64) * _U(_MULT))


def window_hashes(words: np.ndarray, word_off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``k``-word windows and the per-text offsets of windows."""
    n = len(words)
    counts = np.maximum(np.diff(word_off) - (k - 1), 0)
    off = np.concatenate(([0], np.cumsum(counts)))
    if off[-1] == 0:
        return np.zeros(0, np.uint64), off
    h = np.zeros(n - k + 1, dtype=np.uint64)
    for j in range(k):
        h = mix64(h * _U(_MULT) + words[j:n - k + 1 + j])
    first = np.repeat(word_off[:-1] - off[:-1], counts) + np.arange(off[-1])
    return h[first], off


def sequence_hash(words: np.ndarray) -> np.ndarray:
    """Hash of one whole word sequence (texts shorter than a window)."""
    h = np.full(1, _U(0x51ED270B9F0E8C63) + _U(len(words)), dtype=np.uint64)
    for w in words:
        h = mix64(h * _U(_MULT) + w)
    return h


def shingle_sets(col: pa.Array, k: int = 5) -> Iterator[np.ndarray]:
    """Per row: the sorted distinct hashes of its lower-cased (A-Z) ``k``-word
    windows; texts of 1..k-1 words give one hash; null or blank texts none."""
    for i, j, data, off in utf8_chunks(col):
        s, e, woff = word_spans(data, off)
        words = word_hashes(data, s, e, lower=True)
        win, off_w = window_hashes(words, woff, k)
        for r in range(j - i):
            a, b = off_w[r], off_w[r + 1]
            if b > a:
                yield np.unique(win[a:b])
            elif woff[r + 1] > woff[r]:
                yield sequence_hash(words[woff[r]:woff[r + 1]])
            else:
                yield np.zeros(0, np.uint64)
