"""Word shingles of UTF-8 texts as 64-bit hashes, in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from terrafringe.llm.common import chunks, text_bytes

_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SALT = np.random.default_rng(20240229).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first `n` powers of the step and of its inverse, modulo 2^64."""
    if len(_POWERS["up"]) < n:
        size = 1 << (n - 1).bit_length()
        for name, base in (("up", _STEP), ("down", _BACK)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums of salted byte values times powers of the step; `span_hash` reads spans from them."""
    up, _ = _powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_SALT[data] * up[: len(data)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the byte spans [start, end): equal spans get equal hashes wherever they stand."""
    _, down = _powers(len(sums))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row, start and end of every word `[^\\x20\\x09-\\x0D]+` of the rows; A-Z are lower-cased first if asked."""
    if not len(data):
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))
    white = _WHITE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    inside = ~white
    start = np.flatnonzero(inside & (edge[:-1] | np.concatenate([[True], white[:-1]])))
    end = np.flatnonzero(inside & (edge[1:] | np.concatenate([white[1:], [True]]))) + 1
    hashes = span_hash(prefix_sums(_LOWER[data] if lower else data), start, end)
    return hashes, np.searchsorted(offsets, start, "right") - 1, start, end


def shingle_hashes(word: np.ndarray, row: np.ndarray, rows: int, width: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row and first word of every `width`-word shingle; a row of fewer words has its whole sequence as one."""
    n = np.bincount(row, minlength=rows)
    first = np.cumsum(n) - n
    counts = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    at_row = np.repeat(np.arange(rows), counts)
    at = np.arange(len(at_row)) - np.repeat(np.cumsum(counts) - counts, counts) + first[at_row]
    total = np.zeros(len(at), np.uint64)
    size = np.minimum(n, width)[at_row]
    factor = np.uint64(1)
    for k in range(width):
        part = word[np.minimum(at + k, max(len(word) - 1, 0))] if len(word) else np.zeros(0, np.uint64)
        total += np.where(k < size, part, np.uint64(0)) * factor
        factor = np.uint64((int(factor) * 0xA24BAED4963EE407) & (1 << 64) - 1)
    return mix(total + size.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)), at_row, at


def row_sets(column: pa.Array, width: int = 5):
    """Yields (first row, last row, hashes, row of each hash) for ranges of rows, each row's hashes distinct and ascending."""
    data, offsets = text_bytes(column)
    for a, b in chunks(offsets):
        off = offsets[a : b + 1] - offsets[a]
        word, row, _, _ = words(data[offsets[a] : offsets[b]], off)
        h, at, _ = shingle_hashes(word, row, b - a, width)
        order = np.lexsort((h, at))
        h, at = h[order], at[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (at[1:] != at[:-1])
        yield a, b, h[new], at[new]
