"""Words, word hashes and shingle sets of Arrow string columns, as numpy arrays.

All work is on the UTF-8 bytes: the separators of the contracts are ASCII bytes, which never
occur inside a longer code point. Rows are taken in blocks of about a million bytes, so that the
working arrays stay in cache and memory does not depend on the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLOCK = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def _powers(n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    x = 1
    for i in range(min(n, 64)):
        out[i] = x
        x = x * _BASE & _MASK
    done = min(n, 64)
    while done < n:
        more = min(done, n - done)
        step = np.uint64(pow(_BASE, done, 1 << 64))
        out[done : done + more] = out[:more] * step
        done += more
    return out


_POWERS = _powers(4096)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows one after the other, and each row's offset (one more at the end)."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offs


def blocks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of rows with about BLOCK bytes."""
    raw, offs = flat(column)
    at, n = 0, len(column)
    while at < n:
        end = max(at + 1, int(np.searchsorted(offs, offs[at] + BLOCK, side="right")) - 1)
        end = min(end, n)
        yield at, end, raw[offs[at] : offs[end]], offs[at : end + 1] - offs[at]
        at = end


def words(data: np.ndarray, offs: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes (A-Z lower-cased; `space` tells the separating bytes), the row of each word, and each row's first word (one more)."""
    n, rows = len(data), len(offs) - 1
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(rows + 1, np.int64)
    isw = ~space[data]
    start = isw.copy()
    start[1:] &= ~isw[:-1]
    firsts = offs[:-1][np.diff(offs) > 0]
    start[firsts] = isw[firsts]
    at = np.flatnonzero(start)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(rows + 1, np.int64)
    begin = np.zeros(n, np.int32)
    begin[at] = at
    place = np.arange(n, dtype=np.int32) - np.maximum.accumulate(begin)
    longest = int(place[isw].max()) + 1
    powers = _POWERS if longest <= len(_POWERS) else _powers(longest)
    place[~isw] = 0
    worth = (LOWER[data].astype(np.uint64) + np.uint64(1)) * powers[place]
    worth[~isw] = 0
    hashes = mix(np.add.reduceat(worth, at))
    first = np.searchsorted(at, offs)
    return hashes, np.repeat(np.arange(rows), np.diff(first)), first


def grams(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word windows, and each row's first window (one more). Rows of 1 to k-1 words have one window, all their words."""
    n_words = np.diff(first)
    n_grams = np.where(n_words >= k, n_words - k + 1, (n_words > 0).astype(n_words.dtype))
    out_first = np.concatenate([[0], np.cumsum(n_grams)])
    start = np.repeat(first[:-1] - out_first[:-1], n_grams) + np.arange(out_first[-1])
    size = np.repeat(np.minimum(n_words, k), n_grams)
    total = size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    padded = np.concatenate([hashes, np.zeros(k, np.uint64)])
    for j in range(k):
        part = mix(padded[start + j] + np.uint64((j + 1) * 0xA0761D6478BD642F & _MASK))
        part[size <= j] = 0
        total += part
    return mix(total), out_first


def gram_sets(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """As grams(), but each row's distinct hashes in ascending order."""
    h, at = grams(hashes, first, k)
    for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        h[s:e].sort()
    keep = np.ones(len(h), bool)
    keep[1:] = h[1:] != h[:-1]
    keep[at[:-1][np.diff(at) > 0]] = True
    count = np.concatenate([[0], np.cumsum(keep)])
    return h[keep], count[at]
