"""Vectorised helpers over Arrow text columns, used inside tasks.

All hashes are polynomial (Rabin-Karp) hashes modulo 2**64 of mixed units, so the
hash of any slice comes from two prefix sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}
#: Bytes of text handled in one vectorised step.
STEP_BYTES = 1 << 18

WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on unsigned 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


BYTE_UNITS = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n."""
    if len(_powers.get("up", ())) < n:
        size = max(n, 2 * STEP_BYTES)
        for name, base in (("up", BASE), ("down", _INVERSE)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"][:n], _powers["down"][:n]


def prefix(units: np.ndarray) -> np.ndarray:
    """Prefix sums P with hash(i, j) = (P[j] - P[i]) * BASE**-i."""
    out = np.zeros(len(units) + 1, dtype=np.uint64)
    np.cumsum(units * powers(len(units))[0], out=out[1:])
    return out


def slices(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return (sums[ends] - sums[starts]) * powers(len(sums))[1][starts]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a text column; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return data, offsets


def steps(offsets: np.ndarray, limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, or a single longer row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, j
        i = j


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of true positions; a run never crosses a row."""
    if not len(inside):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    edge = np.zeros(len(inside) + 1, dtype=bool)
    edge[offsets] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last[:-1] &= ~inside[1:] | edge[1:-1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def word_hashes(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray | None = None):
    """Hash of every word of a step and the number of words per row.

    ``offsets`` start at 0; ``inside`` marks the bytes of words (default: anything but white space).
    """
    starts, ends = runs(~WHITE[data] if inside is None else inside, offsets)
    hashes = mix(slices(prefix(BYTE_UNITS[data]), starts, ends) + (ends - starts).astype(np.uint64))
    counts = np.diff(np.searchsorted(starts, offsets))
    return hashes, counts, starts, ends


def spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and number of code points of byte spans that follow each other; long spans are taken one by one."""
    hashes, chars = np.zeros(len(starts), dtype=np.uint64), np.zeros(len(starts), dtype=np.int64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + STEP_BYTES, side="right")))
        part, s, e = data[starts[i] : ends[j - 1]], starts[i:j] - starts[i], ends[i:j] - starts[i]
        if len(part) > STEP_BYTES:
            hashes[i], chars[i] = xxhash.xxh64_intdigest(part), np.count_nonzero((part & 0xC0) != 0x80)
        else:
            hashes[i:j] = mix(slices(prefix(BYTE_UNITS[part]), s, e) + (e - s).astype(np.uint64))
            lead = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])
            chars[i:j] = lead[e] - lead[s]
        i = j
    return hashes, chars


def as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
