"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A document's features are the hashes of its words, neighbouring words, words one apart, parts of words (four and
six bytes) and their beginnings (four to six bytes), each counted once. Per-coordinate rates and the L1 penalty leave few weights other
than zero; they are sent to the tasks as two short arrays. Scoring hashes every position, drops what
misses a small filter of the learned hashes, and looks up the rest.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lurewatch.llm import text as T

#: Labelled rows of each class at most that a model is fitted on, taken by hash order.
SAMPLE_PER_CLASS = 1500
#: Toxic sample rows that must hold a feature for it to get a weight.
LEAST_ROWS = 3
THRESHOLD = 0.3
PARTS, BEGINNINGS = (4, 6), (4, 5, 6)
FILTER_BITS = 20
#: A longer text is cut into pieces of this many bytes that overlap by ``OVERLAP``.
PIECE, OVERLAP = 1 << 18, 1 << 10

_INSIDE = np.zeros(256, dtype=bool)
_INSIDE[[*range(48, 58), *range(97, 123), 39, *range(128, 256)]] = True
_KIND = T.mix(np.arange(1, 17, dtype=np.uint64))


def features(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, hash) of every feature occurrence of a step of texts, kind by kind."""
    data = T.LOWER[data]
    inside = _INSIDE[data]
    starts, ends = T.runs(inside, offsets)
    sums = T.prefix(T.BYTE_UNITS[data])
    words = T.mix(T.slices(sums, starts, ends) + (ends - starts).astype(np.uint64))
    row = np.searchsorted(offsets, starts, side="right") - 1
    yield row, words
    for kind, gap in ((1, 1), (2, 2)):
        same = row[:-gap] == row[gap:] if len(row) > gap else np.zeros(0, dtype=bool)
        yield row[: len(same)][same], T.mix(words[: len(same)][same] * _KIND[kind] + words[gap:][same] if len(same) else words[:0])
    for kind, size in enumerate(BEGINNINGS, 3 + len(PARTS)):
        long = ends - starts >= size
        yield row[long], T.mix(T.slices(sums, starts[long], starts[long] + size) + _KIND[kind])
    word_row = row
    for kind, size in enumerate(PARTS, 3):
        room = np.maximum(ends - starts - size + 1, 0)
        total = int(room.sum())
        word = np.repeat(np.arange(len(starts)), room)
        at = np.arange(total) + np.repeat(starts - (np.cumsum(room) - room), room)
        yield word_row[word], T.mix(T.slices(sums, at, at + size) + _KIND[kind])


def _pieces(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row numbers, bytes, offsets): steps of whole texts, or overlapping pieces of a long one, cut at white space if there is any."""
    for i, j in T.steps(offsets, PIECE):
        lo, hi = int(offsets[i]), int(offsets[j])
        if hi - lo <= PIECE:
            yield np.arange(i, j), data[lo:hi], offsets[i : j + 1] - lo
            continue
        at = lo
        while at < hi:
            end = min(at + PIECE, hi)
            if end < hi:
                gap = np.flatnonzero(T.WHITE[data[end - OVERLAP : end]])
                end = end - OVERLAP + int(gap[-1]) if len(gap) else end
            yield np.array([i]), data[at:end], np.array([0, end - at])
            if end >= hi:
                break
            back = np.flatnonzero(T.WHITE[data[end - OVERLAP : end]])
            at = end - OVERLAP + int(back[0]) if len(back) else end - OVERLAP


def feature_sets(column: pa.Array) -> list[np.ndarray]:
    """The distinct feature hashes of each text."""
    data, offsets = T.buffers(column)
    found: list[list[np.ndarray]] = [[] for _ in range(len(column))]
    for rows, piece, cuts in _pieces(data, offsets):
        for row, value in features(piece, cuts):
            for r, part in zip(rows, np.split(value, np.searchsorted(row, np.arange(1, len(rows)))), strict=True):
                found[r].append(part)
    return [np.unique(np.concatenate(f)) if f else np.zeros(0, dtype=np.uint64) for f in found]


@dataclass(frozen=True)
class Model:
    hashes: np.ndarray  # sorted
    weights: np.ndarray
    bias: float


def train(names: np.ndarray, rows: list[tuple[np.ndarray, int]], alpha: float = 1.0, beta: float = 1.0, l1: float = 6.0, l2: float = 1.0, rounds: int = 12,
          share: float | None = None, seed: int = 7) -> Model:
    """Sorted feature hashes and rows (distinct positions in them, 0 or 1) -> sparse model; without both classes a constant one.

    ``share`` is that of label 1 among all rows the sample was drawn from; the bias is shifted to it.
    """
    labels = np.array([y for _, y in rows], dtype=np.float64)
    if not len(rows) or labels.min() == labels.max():
        return Model(np.zeros(0, dtype=np.uint64), np.zeros(0), (4.0 if len(rows) and labels.min() else -4.0))
    ids = [np.append(part, len(names)) for part, _ in rows]
    z, n = np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    penalty = np.full(len(names) + 1, l1)
    penalty[-1] = 0

    def weights(i):
        return -np.sign(z[i]) * np.maximum(np.abs(z[i]) - penalty[i], 0) / ((beta + np.sqrt(n[i])) / alpha + l2)

    random = np.random.default_rng(seed)
    for _ in range(rounds):
        for r in random.permutation(len(rows)):
            i = ids[r]
            w = weights(i)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - labels[r]
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha * w
            n[i] += g * g
    w = weights(np.arange(len(names) + 1))
    some = w[:-1] != 0
    shift = 0.0 if share is None else np.log(share / (1 - share)) - np.log(labels.mean() / (1 - labels.mean()))
    return Model(names[some], w[:-1][some], float(w[-1] + shift))


def scores(model: Model, column: pa.Array) -> np.ndarray:
    data, offsets = T.buffers(column)
    shift = np.uint64(64 - FILTER_BITS)
    may = np.zeros(1 << FILTER_BITS, dtype=bool)
    may[(model.hashes >> shift).astype(np.int64)] = True
    rows, places = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for owner, piece, cuts in _pieces(data, offsets) if len(model.hashes) else ():
        for row, value in features(piece, cuts):
            some = may[(value >> shift).astype(np.int64)]
            value, row = value[some], row[some]
            place = np.minimum(np.searchsorted(model.hashes, value), len(model.hashes) - 1)
            hit = model.hashes[place] == value
            rows.append(owner[row[hit]])
            places.append(place[hit])
    size = max(1, len(model.hashes))
    once = np.unique(np.concatenate(rows) * size + np.concatenate(places))
    total = np.bincount(once // size, weights=model.weights[once % size] if len(once) else None, minlength=len(column))
    return 1 / (1 + np.exp(-np.clip(total + model.bias, -30, 30)))


def training_rows(some: DataFrame) -> tuple[np.ndarray, list[tuple[np.ndarray, int]]]:
    """Features of a bounded sample of (label, text): hashes, and per row their positions and the label.

    Features that fewer than ``LEAST_ROWS`` rows of label 1 hold are left out.
    """

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one in feature_sets(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(T.as_long(one))], ["id"])

    common = some.where("label = 1").select("text").mapInArrow(ids, "id long").groupBy("id").count().where(F.col("count") >= LEAST_ROWS)
    names = np.sort(common.select("id").toArrow().column("id").to_numpy().astype(np.int64).view(np.uint64))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = [np.flatnonzero(np.isin(names, s, assume_unique=True)).astype(np.int32) for s in feature_sets(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(places, pa.list_(pa.int32()))], ["label", "places"])

    found = some.select("label", "text").mapInArrow(rows, "label int, places array<int>").toArrow()
    labels, places = found.column("label").to_pylist(), found.column("places").combine_chunks()
    cuts = np.asarray(places.offsets)
    flat = places.values.to_numpy(zero_copy_only=False)
    order = sorted(range(len(labels)), key=lambda i: (labels[i], cuts[i + 1] - cuts[i], int(flat[cuts[i] : cuts[i + 1]].sum())))  # not the order in which tasks end
    return names, [(flat[cuts[i] : cuts[i + 1]], labels[i]) for i in order]


def held_out(docs: DataFrame) -> DataFrame:
    """``docs`` with ``held_out``: rows that no model of this operator learns from."""
    return docs.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False)))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> Model:
    """Model from the labelled documents that are not held out; labels are (doc_id, toxic)."""
    place = F.xxhash64(F.col("doc_id"), F.lit(5))
    known = held_out(labels.select("doc_id", F.col("toxic").cast("int").alias("label")).where("toxic in (0, 1)")).where("not held_out").select("doc_id", "label").distinct()
    chosen = known.where("label = 1").orderBy(place, "doc_id").limit(per_class).unionByName(
        known.where("label = 0").orderBy(place, "doc_id").limit(per_class))
    count = known.agg(F.sum("label").alias("ones"), F.count("*").alias("n")).first()
    share = count["ones"] / count["n"] if count["n"] and 0 < count["ones"] < count["n"] else None
    return train(*training_rows(docs.select("doc_id", "text").join(chosen, "doc_id").select("label", "text")), share=share)


def predict(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted: one row per row of ``docs``.

    Null and empty texts get the score of a text without features. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores(model, batch.column(1)))], ["doc_id", "score"])

    scored = held_out(docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
