"""Words and word shingles of Arrow texts as 64-bit hashes, computed over whole batches with numpy."""

from __future__ import annotations

import numpy as np

SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit integers that spreads every bit (wrapping arithmetic)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
BASE = np.uint64(0x9E3779B97F4A7C55)  # odd, so its powers never vanish


def powers(n: int, base: np.uint64 = BASE) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def runs(data: np.ndarray, off: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the maximal runs of bytes of one kind (kind 0 separates) and each row's offsets into them.

    ``kinds`` maps a byte to its kind; a run never crosses rows.
    """
    kind = kinds[data].astype(np.int8)
    begins = np.empty(len(data) + 1, bool)
    begins[0] = begins[-1] = True
    np.not_equal(kind[1:], kind[:-1], out=begins[1:-1])
    begins[off] = True
    begins = begins[:-1]
    inside = kind != 0
    starts = np.flatnonzero(begins & inside)
    rows = np.searchsorted(starts, off)
    if not len(starts):
        return np.zeros(0, np.uint64), rows
    chars = data[inside]
    first = np.flatnonzero(begins[inside])
    length = np.diff(np.append(first, len(chars)))
    place = np.arange(len(chars)) - np.repeat(first, length)
    hashes = np.add.reduceat(BYTE[chars] * powers(int(length.max()))[place], first)
    return mix64(hashes ^ (length.astype(np.uint64) << np.uint64(40))), rows


def words(data: np.ndarray, off: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    r"""Hashes of the words ``[^\x20\x09-\x0D]+`` of each row; ``lower`` lower-cases A-Z first."""
    return runs(LOWER[data] if lower else data, off, (~SPACE).astype(np.int8))


def distinct(values: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each row, and the new row offsets. Sorts ``values`` in place."""
    for a, b in zip(rows[:-1].tolist(), rows[1:].tolist()):
        values[a:b].sort()
    keep = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=keep[1:])
    keep[rows[:-1][rows[:-1] < len(values)]] = True
    total = np.concatenate([[0], np.cumsum(keep)])
    return values[keep], total[rows]


def shingle_sets(data: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's sorted distinct hashes of its k-word shingles, A-Z lower-cased; a shorter row that has
    words is one shingle of them all."""
    h, rows = words(data, off, lower=True)
    turn = powers(k + 1, np.uint64(0xD6E8FEB86659FD93))
    n = np.diff(rows)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    out_rows = np.concatenate([[0], np.cumsum(count)])
    out = np.zeros(out_rows[-1], np.uint64)
    if len(h) >= k:
        window = h[:len(h) - k + 1] * turn[0]
        for j in range(1, k):
            window = window + h[j:len(h) - k + 1 + j] * turn[j]
        row_of = np.repeat(np.arange(len(n)), n)
        whole = row_of[:len(window)] == row_of[k - 1:]
        out[np.repeat(n >= k, count)] = mix64(window[whole])
    for r in np.flatnonzero((n > 0) & (n < k)).tolist():
        part = h[rows[r]:rows[r + 1]]
        out[out_rows[r]] = mix64((part * turn[:len(part)]).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(part)))[0]
    return distinct(out, out_rows)
