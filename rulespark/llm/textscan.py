"""Columns of texts as flat numpy arrays: words, hashes and byte windows.

All functions work on one Arrow column at a time. Bytes of all rows lie in one
array; ``offsets`` (n + 1 values) says where each row starts. Hashes are
polynomials modulo 2**64 with an odd base, followed by a bijective mix.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute

U = np.uint64
MASK = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
BASE_2 = 0xD6E8FEB86659FD93
BASE_2_INVERSE = pow(BASE_2, -1, 1 << 64)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F] after lower-casing
WORD_ALNUM = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])
#: [^\x20\x09-\x0D]
WORD_NONSPACE = np.array([not (b == 32 or 9 <= b <= 13) for b in range(256)])

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64; kept and grown per process."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(12, (n - 1).bit_length())
        have = np.ones(size, dtype=U)
        filled = 1
        while filled < size:
            have[filled : 2 * filled] = have[:filled] * U(pow(base, filled, 1 << 64))
            filled *= 2
        _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null counts as empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = pa.compute.fill_null(column, b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    if not len(column):
        return data[:0], np.zeros(1, np.int64)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def runs(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True, broken at row starts."""
    n = len(mask)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    starts, ends = mask.copy(), mask.copy()
    starts[1:] &= ~mask[:-1]
    ends[:-1] &= ~mask[1:]
    first = offsets[:-1][offsets[:-1] < n]
    starts[first] = mask[first]
    last = offsets[1:][offsets[1:] > 0] - 1
    ends[last] = mask[last]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, start of each word, first word of each row as n + 1
    offsets). ``data`` must be lower-cased; ``kind`` marks the word bytes."""
    hashes, starts, _, first = words_and_ends(data, offsets, kind)
    return hashes, starts, first


def words_and_ends(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As ``words``, with the end of each word after its start."""
    starts, ends = runs(kind[data], offsets)
    hashes = span_hashes(data, starts, ends, BASE, BASE_INVERSE)
    return hashes, starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int, inverse: int) -> np.ndarray:
    """One mixed hash for each byte span."""
    n = len(data)
    sums = np.empty(n + 1, dtype=U)
    sums[0] = 0
    terms = data.astype(U)
    terms += U(1)
    terms *= powers(base, n) if n else U(1)
    np.cumsum(terms, out=sums[1:])
    if not len(starts):
        return np.empty(0, U)
    return mix((sums[ends] - sums[starts]) * powers(inverse, n + 1)[starts])


def window_hashes(data: np.ndarray, k: int, base: int) -> np.ndarray:
    """Mixed hash of every k-byte window, by doubling."""
    n = len(data)
    if n < k:
        return np.empty(0, U)
    level, size = data.astype(U) + U(1), 1
    levels = {1: level}
    while size * 2 <= k:
        level = level[:-size] * U(pow(base, size, 1 << 64)) + level[size:]
        size *= 2
        levels[size] = level
    total, done = None, 0
    for bit in sorted(levels, reverse=True):
        if k & bit:
            part = levels[bit][done : done + n - k + 1]
            total = part.copy() if total is None else total * U(pow(base, bit, 1 << 64)) + part
            done += bit
    return mix(total)


def row_of(positions: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The row that holds each position."""
    return np.searchsorted(offsets, positions, side="right") - 1
