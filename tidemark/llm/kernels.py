"""Vectorised text kernels: Arrow buffers in, numpy arrays out, no Python loop over words."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes that part words: space and \x09-\x0D.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
CHUNK = 1 << 20
#: A longer word is hashed by itself, so that no table grows with a word.
LONG_WORD = 1 << 16
_BASE = 0x9E3779B97F4A7C15 | 1
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_tables: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of a uint64 over all bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def byte_table(lower: bool) -> np.ndarray:
    if (key := f"bytes{lower}") not in _tables:
        t = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        if lower:
            t[65:91] = t[97:123]
        _tables[key] = t
    return _tables[key]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** i and its inverse mod 2 ** 64, for i < n."""
    have = _tables.get("pow")
    if have is None or len(have) < n:
        n = max(n, CHUNK + 4096)
        inverse = pow(_BASE, -1, 1 << 64)
        for name, base in (("pow", _BASE), ("inv", inverse)):
            a = np.full(n, np.uint64(base), np.uint64)
            a[0] = 1
            _tables[name] = np.multiply.accumulate(a)
    return _tables["pow"], _tables["inv"]


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """A string column's UTF-8 bytes and its n + 1 row bounds; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, bounds, data = column.buffers()
    if len(column) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(bounds, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def words(data: np.ndarray, rows: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words (case of A-Z ignored if lower), their first and past-the-end bytes, and each row's bounds in these."""
    table = byte_table(lower)
    hashes, begins, ends = [], [], []

    def alone(a: int, z: int) -> np.ndarray:
        word = data[a:z].tobytes()
        return np.frombuffer(hashlib.blake2b(word.translate(_LOWER) if lower else word, digest_size=8).digest(), np.uint64)

    at, total = 0, len(data)
    cuts = rows[1:-1]
    while at < total:
        to = min(at + CHUNK, total)
        if to < total:  # cut where no word is cut: behind a space, or between rows
            last = np.flatnonzero(IS_SPACE[data[at:to]])
            row = rows[np.searchsorted(rows, to, "right") - 1]
            cut = max(at + last[-1] + 1 if len(last) else at, row)
            if cut <= at:  # a word that is longer than a piece
                row_end = int(rows[np.searchsorted(rows, at, "right")])
                while to < row_end and not len(last := np.flatnonzero(IS_SPACE[data[to : min(to + CHUNK, row_end)]])):
                    to = min(to + CHUNK, row_end)
                to = min(to + int(last[0]), row_end) if to < row_end else row_end
                hashes.append(alone(at, to))
                begins.append(np.array([at]))
                ends.append(np.array([to]))
                at = to
                continue
            to = cut
        b = data[at:to]
        ink = ~IS_SPACE[b]
        fresh = np.ones(len(b), bool)
        fresh[1:] = ~ink[:-1]
        fresh[cuts[np.searchsorted(cuts, at) : np.searchsorted(cuts, to)] - at] = True
        begin = np.flatnonzero(ink & fresh)
        last = np.ones(len(b), bool)
        last[:-1] = ~ink[1:] | fresh[1:]
        end = np.flatnonzero(ink & last) + 1
        up, down = powers(len(b) + 1)
        sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(table[b] * up[: len(b)], out=sums[1:])
        found = mix((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64))
        for k in np.flatnonzero(end - begin > LONG_WORD):
            found[k] = alone(at + int(begin[k]), at + int(end[k]))[0]
        hashes.append(found)
        begins.append(begin + at)
        ends.append(end + at)
        at = to
    if not hashes:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, np.zeros(len(rows), np.int64)
    begin = np.concatenate(begins)
    return np.concatenate(hashes), begin, np.concatenate(ends), np.searchsorted(begin, rows)


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n words in a row (also over row bounds: the caller leaves those out), by doubling."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    size, have, out, taken = 1, hashes, None, 0
    while True:
        if n & size:
            part = have[taken : len(hashes) - n + 1 + taken] if taken else have[: len(hashes) - n + 1]
            out = mix(part + np.uint64(size)) if out is None else mix(out * np.uint64(_BASE) + part)
            taken += size
        if size * 2 > n:
            return out
        have = mix(have[:-size] * np.uint64(0xA24BAED4963EE407 | 1) + have[size:])
        size *= 2


def per_row(bounds: np.ndarray) -> Iterator[tuple[int, int, int]]:
    for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
        yield i, a, b


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each pair, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(lengths) - lengths
    return np.arange(total) + np.repeat(starts - first, lengths)
