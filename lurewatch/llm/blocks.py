"""Content-chosen blocks: which windows of a fixed length can be repeated at all, without shuffling every window.

Every window of ``length`` units contains grams of ``gram`` units; the window belongs to its gram of least
hash (the leftmost of equals). Consecutive windows that belong to one gram form a block. Equal windows have
equal least grams at equal offsets, so a window whose gram occurs once is not repeated, and blocks with
equal content hold equal windows. Units are bytes or words; a document is cut into segments of at most
``SEGMENT`` windows first, which changes blocks but not which windows are equal.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lurewatch.llm import text as T

SEGMENT = 1 << 18
_POSITION = np.uint64((1 << 20) - 1)
ANCHORS = "doc_id long, at long, shape int, gram long, sig long"


def byte_units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Units of a step of texts and the offsets of each text's units."""
    return T.BYTE_UNITS[data], offsets


def word_units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hashes, counts, _, _ = T.word_hashes(data, offsets)
    return hashes, np.concatenate([[0], np.cumsum(counts)])


def _segments(units: np.ndarray, offsets: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(row numbers, first unit in the row, units, offsets) of pieces that fit one vectorised step."""
    sizes = np.diff(offsets)
    rows = np.arange(len(sizes))
    long = sizes > SEGMENT
    for r in rows[long]:
        for at in range(0, max(1, int(sizes[r]) - length + 1), SEGMENT):
            piece = units[offsets[r] + at : min(offsets[r] + at + SEGMENT + length - 1, offsets[r + 1])]
            yield np.array([r]), np.array([at]), piece, np.array([0, len(piece)])
    if not long.any():
        yield rows, np.zeros(len(rows), dtype=np.int64), units, offsets
    elif not long.all():
        keep = np.repeat(~long, sizes)
        yield rows[~long], np.zeros((~long).sum(), dtype=np.int64), units[keep], np.concatenate([[0], np.cumsum(sizes[~long])])


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """Sliding minimum over ``width`` positions."""
    low, have = keys, 1
    while 2 * have <= width:
        low, have = np.minimum(low[:-have], low[have:]), 2 * have
    rest = width - have
    return np.minimum(low[: len(low) - rest], low[rest:]) if rest else low


def blocks(units: np.ndarray, offsets: np.ndarray, length: int, gram: int):
    """row, at (first window), span (windows - 1), off (gram start in the block), gram hash, block hash."""
    windows = np.maximum(np.diff(offsets) - length + 1, 0)
    total = int(windows.sum())
    if not total:
        return (np.zeros(0, dtype=np.int64),) * 4 + (np.zeros(0, dtype=np.uint64),) * 2
    sums = T.prefix(units)
    down = T.powers(len(sums))[1]
    grams = T.mix((sums[gram:] - sums[:-gram]) * down[: len(sums) - gram])
    keys = (grams & ~_POSITION) | np.arange(len(grams), dtype=np.uint64)
    least = _least(keys, length - gram + 1)
    row = np.repeat(np.arange(len(windows)), windows)
    start = np.arange(total) + np.repeat(offsets[:-1] - np.concatenate([[0], np.cumsum(windows)[:-1]]), windows)
    owner = (least[start] & _POSITION).astype(np.int64)
    new = np.ones(total, dtype=bool)
    new[1:] = (owner[1:] != owner[:-1]) | (row[1:] != row[:-1])
    head = np.flatnonzero(new)
    first, last, at = start[head], start[np.append(head[1:], total) - 1], owner[head]
    span, off = last - first, at - first
    shape = T.mix(((off << 16) | span).astype(np.uint64) + np.uint64(1))
    sig = T.mix((sums[last + length] - sums[first]) * down[first] + shape)
    return row[head], first - offsets[row[head]], span, off, grams[at], sig


def anchors(docs: DataFrame, units: Callable, length: int, gram: int) -> DataFrame:
    """(doc_id, at, shape = off << 16 | span, gram, sig) of every block of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            data, offsets = T.buffers(batch.column(1))
            for i, j in T.steps(offsets):
                step, bounds = units(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                for rows, base, piece, cuts in _segments(step, bounds, length):
                    row, at, span, off, g, sig = blocks(piece, cuts, length, gram)
                    if len(row):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(ids[i + rows[row]]), pa.array(at + base[row]), pa.array(((off << 16) | span).astype(np.int32)),
                             pa.array(T.as_long(g)), pa.array(T.as_long(sig))], ["doc_id", "at", "shape", "gram", "sig"])

    return docs.select("doc_id", "text").mapInArrow(run, ANCHORS)


def packed_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, packed): texts compressed before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            data, offsets = T.buffers(batch.column(1))
            view = memoryview(np.ascontiguousarray(data))
            packed = pa.array([press.compress(view[offsets[i] : offsets[i + 1]]) for i in range(batch.num_rows)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), packed], ["doc_id", "packed"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, packed binary")


def unpack(packed: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(packed) if packed else b""


def pack_spans(rows: DataFrame) -> DataFrame:
    """(doc_id, lo, hi) -> (doc_id, spans): all spans of a document, as its removal list."""
    return rows.groupBy("doc_id").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))


def texts_with(docs: DataFrame, lists: DataFrame, how: str = "inner") -> DataFrame:
    """Packed texts next to a per-document list, joined on doc_id."""
    return packed_texts(docs).join(lists, "doc_id", how)


def list_column(column: pa.Array, *fields: str) -> tuple[np.ndarray, list[np.ndarray]]:
    """Offsets and flat field arrays of a column of lists of structs; a null list counts as empty."""
    sizes = np.array([0 if s is None else s for s in pa.compute.list_value_length(column).to_pylist()], dtype=np.int64)
    flat = column.flatten()
    return np.concatenate([[0], np.cumsum(sizes)]), [flat.field(f).to_numpy(zero_copy_only=False) for f in fields]


def covered(n: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Which of n units lie in a span [lo, hi)."""
    steps = np.bincount(lo, minlength=n + 1)[: n + 1] - np.bincount(hi, minlength=n + 1)[: n + 1]
    return np.cumsum(steps[:n]) > 0
