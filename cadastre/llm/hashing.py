"""Vectorised hashing of bytes and words inside Python tasks.

Everything works on ``uint64`` numpy arrays, one document at a time, straight
from the UTF-8 buffer of an Arrow column.  A range hash is a polynomial over
the symbols of the range (modulo 2**64, odd base) passed through a bijective
mixer, so equal ranges hash equally wherever they stand.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
#: Odd base of the polynomial; any odd number with well spread bits does.
BASE = 0x9E3779B97F4A7C15
#: Bits of the packed minimum that hold a position.
POS_BITS = 24
_POS = U64((1 << POS_BITS) - 1)
#: Windows handled at once, so that a position always fits in POS_BITS.
BLOCK = 1 << 23

#: White space of the pattern [\x20\x09-\x0D].
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Maps A-Z to a-z and keeps every other byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_pow = np.ones(1, dtype=U64)
_inv = np.ones(1, dtype=U64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of each."""
    global _pow, _inv
    if len(_pow) < n:
        size = max(n, 2 * len(_pow), 1 << 16)
        inverse = pow(BASE, -1, 1 << 64)
        for_base, for_inverse = np.full(size, BASE, dtype=U64), np.full(size, inverse, dtype=U64)
        for_base[0] = for_inverse[0] = 1
        _pow, _inv = np.cumprod(for_base, dtype=U64), np.cumprod(for_inverse, dtype=U64)
    return _pow, _inv


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (multiply and xor-shift rounds)."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def prefix_sums(symbols: np.ndarray) -> np.ndarray:
    """Running polynomial of the symbols; entry i covers the first i of them."""
    n = len(symbols)
    base, _ = powers(n + 1)
    out = np.zeros(n + 1, dtype=U64)
    np.cumsum(symbols * base[:n], dtype=U64, out=out[1:])
    return out


def range_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the symbols in [start, end), for arrays of bounds."""
    _, inverse = powers(len(sums))
    return mix((sums[end] - sums[start]) * inverse[start])


def words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+ in a byte array."""
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = ~SPACE[data]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def byte_symbols(data: np.ndarray) -> np.ndarray:
    return data.astype(U64) + U64(1)


def word_symbols(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A 64-bit symbol for each word, with the words' byte bounds."""
    start, end = words(data)
    return range_hash(prefix_sums(byte_symbols(data)), start, end), start, end


def window_hashes(symbols: np.ndarray, window: int) -> np.ndarray:
    """Hash of every window of that many symbols, by start."""
    n = len(symbols) - window + 1
    if n <= 0:
        return np.empty(0, dtype=U64)
    sums = prefix_sums(symbols)
    _, inverse = powers(len(sums))
    return mix((sums[window:] - sums[:n]) * inverse[:n])


def shingles(data: np.ndarray, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the lower-cased word shingles of a text.

    A text of fewer words than ``width``, but not none, is one shingle.
    """
    symbols, _, _ = word_symbols(LOWER[data])
    if len(symbols) == 0:
        return np.empty(0, dtype=U64)
    return np.unique(window_hashes(symbols, min(width, len(symbols))))


def sliding_min(x: np.ndarray, span: int) -> np.ndarray:
    """Minimum of every ``span`` consecutive entries, by doubling."""
    width = 1
    while 2 * width <= span:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    rest = span - width
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def anchors(symbols: np.ndarray, gram: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Content-defined phrases that together cover every window.

    The trigger of a window is its gram of least hash (leftmost on ties), so it
    depends on the window's content alone.  Consecutive windows with one trigger
    form a phrase.  Returned for each phrase: hash of the trigger gram, hash of
    the phrase's content, start of its first window, number of its windows.
    """
    count = len(symbols) - window + 1
    if count <= 0:
        return (np.empty(0, dtype=U64),) * 2 + (np.empty(0, dtype=np.int64),) * 2
    grams, sums, span = window_hashes(symbols, gram), prefix_sums(symbols), window - gram + 1
    parts = []
    for at in range(0, count, BLOCK):
        n = min(BLOCK, count - at)
        own = grams[at : at + n + span - 1]
        packed = (own & ~_POS) | np.arange(len(own), dtype=U64)
        trigger = sliding_min(packed, span) & _POS
        first = np.concatenate(([0], np.flatnonzero(np.diff(trigger)) + 1))
        size = np.diff(np.append(first, n))
        hashes = range_hash(sums, first + at, first + at + size - 1 + window)
        parts.append((own[trigger[first].astype(np.int64)], hashes, first + at, size))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))
