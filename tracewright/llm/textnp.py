"""Vectorised text primitives over the byte buffers of Arrow string columns.

A word is a maximal run of bytes other than space and U+0009-U+000D; these are single
bytes in UTF-8, so words are found without decoding. Hashes are polynomials with random
byte weights modulo 2**64, taken from prefix sums block by block, then mixed: equal words
hash equally wherever they stand, and memory stays bounded however long a text is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_SHIFT = 18
BLOCK = 1 << _SHIFT
CHUNK_BYTES = 1 << 20
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_rng = np.random.default_rng(20240229)
WEIGHT = _rng.integers(1 << 40, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
LOWER_WEIGHT = WEIGHT.copy()
LOWER_WEIGHT[65:91] = WEIGHT[97:123]
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    done = 1
    while done < n:
        step = min(done, n - done)
        out[done : done + step] = out[:step] * np.uint64(pow(base, done, 1 << 64))
        done += step
    return out


POW = _powers(_BASE, BLOCK)
INV_POW = _powers(_INV, BLOCK)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets (int64, one more than rows) of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    kind = np.int64 if large else np.int32
    offsets = np.frombuffer(offs, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if offs is not None and len(column) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf, offsets


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of at most ``limit`` bytes (one longer row alone): first, end, bytes, offsets from 0."""
    buf, offs = utf8(column)
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield i, j, buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def prefix_at(buf: np.ndarray, at: np.ndarray, weight: np.ndarray = WEIGHT) -> np.ndarray:
    """Sums of weight[byte] * base**position before each of the ascending positions."""
    out = np.zeros(len(at), np.uint64)
    total, scale = np.uint64(0), 1
    edges = np.searchsorted(at, np.arange(0, len(buf) + BLOCK, BLOCK), "left")
    with np.errstate(over="ignore"):
        for k, s in enumerate(range(0, len(buf), BLOCK)):
            part = buf[s : s + BLOCK]
            sums = np.empty(len(part) + 1, np.uint64)
            sums[0] = 0
            np.cumsum(weight[part] * POW[: len(part)], out=sums[1:])
            lo, hi = edges[k], edges[k + 1]
            out[lo:hi] = total + sums[at[lo:hi] - s] * np.uint64(scale)
            total = total + sums[-1] * np.uint64(scale)
            scale = scale * pow(_BASE, BLOCK, 1 << 64) & _MASK
        out[at >= len(buf)] = total
    return out


def inverse_power(at: np.ndarray) -> np.ndarray:
    high = at >> _SHIFT
    table = np.array([pow(_INV, BLOCK * int(k), 1 << 64) for k in range(int(high.max()) + 1 if len(at) else 1)], np.uint64)
    with np.errstate(over="ignore"):
        return INV_POW[at & (BLOCK - 1)] * table[high]


def span_hash(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, weight: np.ndarray = WEIGHT) -> np.ndarray:
    """A mixed hash of each byte span; starts and ends ascend."""
    with np.errstate(over="ignore"):
        return mix((prefix_at(buf, ends, weight) - prefix_at(buf, starts, weight)) * inverse_power(starts))


def words(buf: np.ndarray, offs: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, hash of every word, and the first word of each row (one more than rows)."""
    inside = ~IS_SPACE[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[offs] = True
    before = np.zeros(len(buf), bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.zeros(len(buf), bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    both = np.stack([starts, ends], 1).ravel()  # ascending, so one pass gives the sums before both
    sums = prefix_at(buf, both, LOWER_WEIGHT if lower else WEIGHT)
    with np.errstate(over="ignore"):
        hashes = mix((sums[1::2] - sums[::2]) * inverse_power(starts))
    return starts, ends, hashes, np.searchsorted(starts, offs, "left")


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k words; of the whole sequence as one where it is shorter."""
    n = len(hashes)
    width = min(k, n)
    if not width:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.full(n - width + 1, width, np.uint64)
        for i in range(width):
            out = mix(out * np.uint64(_BASE) + hashes[i : n - width + 1 + i])
    return out
