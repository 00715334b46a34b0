"""Whole-array scans over the UTF-8 bytes of many texts at once.

A batch of texts is one byte array and an array of boundaries, taken from Arrow buffers
without making Python strings. Words and fixed windows get 64-bit polynomial hashes
(arithmetic modulo 2**64) with a final mix.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes of text scanned at once; bounds the arrays of a scan (a longer text is one block).
BLOCK_BYTES = 1 << 19
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
U = np.uint64


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(data, ptr)`` of a string column: text i is ``data[ptr[i]:ptr[i + 1]]``; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    ptr = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[ptr[0] : ptr[-1]], ptr - ptr[0]


def blocks(ptr: np.ndarray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts with at most ``most`` bytes, or one longer text."""
    i, n = 0, len(ptr) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(ptr, ptr[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


@lru_cache(maxsize=4)
def separators(kind: str) -> np.ndarray:
    """Which bytes part words. ``space``: ASCII white space. ``plain``: all ASCII but
    digits and lower-case letters (texts are lower-cased first)."""
    sep = np.zeros(256, bool)
    if kind == "space":
        sep[[0x20, *range(0x09, 0x0E)]] = True
    else:
        sep[:0x80] = True
        sep[0x30:0x3A] = False
        sep[0x61:0x7B] = False
    return sep


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (xor-shift and multiply)."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U(27))
    h = h * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def words(data: np.ndarray, ptr: np.ndarray, sep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and each text's range of words; none crosses texts."""
    if len(data) == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(ptr), np.int64)
    inside = ~sep[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cut = ptr[(ptr > 0) & (ptr < len(data))]
    first[cut] = inside[cut]
    last[cut - 1] = inside[cut - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, ptr)


@lru_cache(maxsize=3)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = U(pow(int(BASE), -1, 1 << 64))
    one = np.ones(1, U)
    up = np.concatenate([one, np.cumprod(np.full(n, BASE, U), dtype=U)])
    down = np.concatenate([one, np.cumprod(np.full(n, inverse, U), dtype=U)])
    return up, down


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word; equal words have equal hashes in all batches."""
    size = BLOCK_BYTES if len(data) <= BLOCK_BYTES else 1 << int(len(data) - 1).bit_length()
    up, down = _powers(size)
    total = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1)) * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U))


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each window of ``k`` bytes, by doubling."""
    n = len(data) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    have, width, parts = data.astype(U) + U(1), 1, []
    base = int(BASE)
    while True:
        if k & width:
            parts.append((width, have))
        if width * 2 > k:
            break
        have = have[:-width] * U(pow(base, width, 1 << 64)) + have[width:]
        width *= 2
    at, total = 0, np.zeros(n, U)
    for width, h in reversed(parts):
        total = total * U(pow(base, width, 1 << 64)) + h[at : at + n]
        at += width
    return mix(total)


def text_words(text: str | None, kind: str) -> list[bytes]:
    """The words of one text, lower-cased (A-Z)."""
    data = lower_ascii(np.frombuffer((text or "").encode(), np.uint8))
    starts, ends, _ = words(data, np.array([0, len(data)]), separators(kind))
    raw = data.tobytes()
    return [raw[s:e] for s, e in zip(starts, ends)]
