"""Vectorised 64-bit hashes of white-space separated words, over UTF-8 bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes hashed at once; longer inputs are cut at white space.
BLOCK = 1 << 20
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_rng = np.random.Generator(np.random.PCG64(20240229))
_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2 ** 64."""
    size = max(BLOCK * 2, 1 << (n + 1).bit_length())
    if size not in _powers:
        out = []
        for base in (_BASE, _INVERSE):
            x = np.full(size, base, dtype=np.uint64)
            x[0] = 1
            out.append(np.multiply.accumulate(x))
        _powers.clear()
        _powers[size] = out[0], out[1]
    return next(iter(_powers.values()))


def _block(b: np.ndarray, gap: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    space = gap[b]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    power, inverse = _tables(len(b))
    sums = np.empty(len(b) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum(values[_LOWER[b]] * power[: len(b)], out=sums[1:])
    return starts, ends, mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def values_of(seed: int) -> np.ndarray:
    """Byte values of another hash of the same kind, for words that this one does not tell apart."""
    return np.random.Generator(np.random.PCG64(seed)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def spans(data: np.ndarray, gap: np.ndarray = _SPACE, values: np.ndarray = _VALUE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of each word (A-Z lower-cased) in a uint8 array; gap: 256 flags, the bytes
    that part words."""
    found, at = [], 0
    while at < len(data):
        stop = min(len(data), at + BLOCK)
        while stop < len(data) and not gap[data[stop]]:
            more = np.flatnonzero(gap[data[stop : stop + BLOCK]])
            stop += int(more[0]) if len(more) else len(data[stop : stop + BLOCK])
        s, e, h = _block(data[at:stop], gap, values)
        found.append((s + at, e + at, h))
        at = stop
    if not found:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
    return tuple(np.concatenate(x) for x in zip(*found))


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word (A-Z lower-cased) in a uint8 array."""
    starts, _, hashes = spans(data)
    return starts, hashes


def column_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a string column, all texts in a row, and the bounds of each text's words
    (one more than texts). Null counts as empty."""
    column = column.cast(pa.large_binary())
    texts = [x or b"" for x in column.to_pylist()]
    joined = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    offsets = np.cumsum([0] + [len(t) + 1 for t in texts])
    starts, hashes = word_hashes(joined)
    return hashes, np.searchsorted(starts, offsets)
