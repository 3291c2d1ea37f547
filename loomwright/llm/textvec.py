"""Vectorised text kernels shared by the operators of this subpackage.

Everything works on the raw buffers of an Arrow string column (one byte array plus row offsets), so a batch of
texts costs a handful of NumPy passes instead of a Python loop over characters or words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_WORD = np.zeros(256, dtype=bool)
_WORD[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_"]] = True

#: Bytes of text that are worked on at once; bounds a worker's temporary arrays to some tens of MB.
SLICE_BYTES = 1 << 20

_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n (kept, and grown when a longer text comes)."""
    have = len(_powers.get("up", ()))
    if have < n:
        size = max(n, SLICE_BYTES + 1, 2 * have)
        for name, base in (("up", _BASE), ("down", _BASE_INV)):
            x = np.full(size, base, dtype=U64)
            x[0] = 1
            _powers[name] = np.cumprod(x, dtype=U64)
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that all bits of a hash are usable."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    column = column.cast(pa.large_string())
    _, off, data = column.buffers()
    n, o = len(column), column.offset
    if n == 0 or off is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(off, dtype=np.int64, count=n + 1 + o)[o:]
    if data is None or not data.size:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8), offsets


def is_word(data: np.ndarray) -> np.ndarray:
    """Which bytes are ASCII letters, digits or underscores."""
    return _WORD[data]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts together have about ``limit`` bytes; a longer text stands alone, whole."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (longest runs of ASCII letters, digits, underscores) and the row of each.

    ``data`` holds exactly the rows' bytes and ``offsets`` starts at 0. No word runs from one row into another.
    """
    n = len(data)
    if not n:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    is_word = _WORD[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    first = is_word.copy()
    first[1:] &= ~is_word[:-1] | edge[1:n]
    last = is_word.copy()
    last[:-1] &= ~is_word[1:] | edge[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last)
    up, down = powers(n)
    total = np.cumsum((data.astype(U64) + U64(1)) * up, dtype=U64)
    before = np.where(starts > 0, total[starts - 1], U64(0))
    h = mix((total[ends] - before) * down[starts])
    return h, np.searchsorted(offsets, starts, side="right") - 1


_LANES = np.array([0x2545F4914F6CDD1D, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB,
                   0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165], dtype=U64)


def phrases(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all sequences of ``n`` consecutive words of each row, and the row of each sequence."""
    h, row = words(data, offsets)
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    x = h[:m] * _LANES[0]
    for k in range(1, n):
        x += h[k : m + k] * _LANES[k]
    keep = row[:m] == row[n - 1 :]
    return mix(x[keep]), row[:m][keep]


def phrase_sets(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    """The sorted distinct phrase hashes of each row."""
    data, offsets = buffers(column)
    for i, j in slices(offsets):
        lo, hi = offsets[i], offsets[j]
        h, row = phrases(data[lo:hi], offsets[i : j + 1] - lo, n)
        cut = np.searchsorted(row, np.arange(j - i + 1))
        for k in range(j - i):
            yield np.unique(h[cut[k] : cut[k + 1]])


def set_key(phrases_of_row: np.ndarray) -> tuple[int, int]:
    """A 128-bit key of a set of hashes, the same for equal sets only (but for a chance of 2**-128)."""
    x = phrases_of_row
    a = int(mix(x ^ U64(0x6A09E667F3BCC909)).sum(dtype=U64)) if len(x) else 0
    b = int(mix(x + U64(0xBB67AE8584CAA73B)).sum(dtype=U64)) if len(x) else len(x)
    return a - (1 << 64) if a >> 63 else a, b - (1 << 64) if b >> 63 else b
