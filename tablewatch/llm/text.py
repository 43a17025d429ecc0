"""Vectorised work on whole batches of texts: words, hashes of words and of byte strings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
SLICE = 1 << 20

_rng = np.random.Generator(np.random.PCG64(20240229))
BYTE_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
WORD_CODE = _rng.integers(1, 2**63, 64, dtype=np.uint64) * U64(2) + U64(1)
_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over all 64 output bits."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse, modulo 2**64. Those of a slice are kept for life, those of longer texts are not."""
    global _powers, _inverse
    if n <= len(_powers):
        return _powers[:n], _inverse[:n]
    up, down = (_powers_of(x, max(n, SLICE + 64)) for x in (_BASE, pow(_BASE, -1, 1 << 64)))
    if n <= SLICE + 64:
        _powers, _inverse = up, down
    return up[:n], down[:n]


def _powers_of(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out, out=out)


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """H with H[j] - H[i] = the sum of code(byte) * base**position over [i, j)."""
    up, _ = powers(len(data))
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_CODE[data] * up, out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of the bytes in each [start, end), the same wherever they stand."""
    _, down = powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start])


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string or binary column; null counts as empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32, len(column) + 1 + column.offset)[column.offset :].astype(np.int64) if offsets is not None and len(column) else np.zeros(len(column) + 1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array, size: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) in runs of whole texts of about ``size`` bytes."""
    data, offsets = buffers(column)
    row, n = 0, len(column)
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1
        end = min(n, max(end, row + 1))
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def lower_table(separators: np.ndarray) -> np.ndarray:
    """A map of bytes: A-Z to a-z, separators to 0."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    table[separators] = 0
    return table


#: Words are runs of anything but a space and the controls from tab to carriage return.
SPACED = lower_table(np.array([0x20, *range(0x09, 0x0E)]))
#: Words are runs of digits, letters and anything outside ASCII.
ALNUM = lower_table(np.array([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))


def words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, ...]:
    """Lowered bytes, word starts and ends, and the first word of each text (n + 1 values).

    ``separators``: true for a byte that stands between words; texts never share a word.
    """
    inside = ~separators[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    at = offsets[:-1]
    at = at[at < len(data)]
    first[at] = inside[at]
    at = at[at > 0] - 1
    last[at] = inside[at]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, offsets)


def separator_mask(table: np.ndarray) -> np.ndarray:
    """Which bytes ``table`` sends to 0; a NUL is one only where A-Z and digits alone are words."""
    mask = table == 0
    mask[0] = table is ALNUM
    return mask


def word_hashes(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, ...]:
    """Hash, start and end of every lowered word, and the first word of each text (n + 1 values)."""
    start, end, first = words(data, offsets, separator_mask(table))
    return span_hash(prefix_hash(table[data]), start, end), start, end, first


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of every run of ``width`` words, across texts too: callers drop those."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(width):
        out += hashes[j : j + n] * WORD_CODE[j % 64] * U64(2 * (j // 64) + 1)
    return mix(out)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its ``width``-word shingles.

    A text with fewer words has its whole sequence as one; one without words has none.
    """
    hashes, _, _, first = word_hashes(data, offsets, SPACED)
    windows = window_hashes(hashes, width)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= width:
            yield np.unique(windows[a : b - width + 1])
        elif b > a:
            yield window_hashes(hashes[a:b], b - a)
        else:
            yield windows[:0]
