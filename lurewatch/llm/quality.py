"""Quality classifier: a generalised additive model with pairwise interactions.

Surface statistics of a text are cut into quantile bins. Cyclic boosting visits one feature after the other
and adds, with a small step, a shallow regression tree fitted to the log-loss residuals; as a tree sees one feature,
all its rounds sum up to one lookup table per feature. The pairs whose joint bins explain most of
what is left get tables in the same way. A score is the sum of one table entry per feature and pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lurewatch.llm import text as T

#: Labelled rows of each class at most that a model is fitted on, taken by hash order.
SAMPLE_PER_CLASS = 6000
BINS, PAIR_BINS, PAIRS = 32, 8, 6
THRESHOLD = 0.5
FEATURES = ["bytes", "words", "word_bytes", "upper", "digit", "symbol", "white", "line_words", "distinct", "repeated", "stops", "short", "marked", "letters", "longest"]
#: A longer text is described piece by piece, and the counts are added.
PIECE = 1 << 20

_CLASS = np.zeros(256, dtype=np.int64)  # 0 other, 1 upper, 2 digit, 3 symbol, 4 white, 5 stop or comma, 6 lower
_CLASS[65:91], _CLASS[48:58] = 1, 2
_CLASS[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~!"]] = 3
_CLASS[T.WHITE], _CLASS[[ord(c) for c in ".,;:?"]] = 4, 5
_CLASS[97:123], _CLASS[128:] = 6, 6


def _counts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per row: additive counts; and (row, word hash) of every word."""
    n = len(offsets) - 1
    row = np.repeat(np.arange(n), np.diff(offsets))
    kinds = np.bincount(row * 7 + _CLASS[data], minlength=7 * n).reshape(n, 7)
    lines = np.bincount(row[data == 10], minlength=n)
    words, counts, starts, ends = T.word_hashes(data, offsets)
    owner = np.repeat(np.arange(n), counts)
    again = np.zeros(len(words), dtype=bool)
    again[1:] = (words[1:] == words[:-1]) & (owner[1:] == owner[:-1])
    short = np.bincount(owner[ends - starts <= 3], minlength=n)
    marked = np.bincount(owner[_CLASS[data[ends - 1]] == 3], minlength=n)
    longest = np.zeros(n, dtype=np.int64)
    np.maximum.at(longest, owner, ends - starts)
    return np.column_stack([np.diff(offsets), counts, kinds, lines, np.bincount(owner[again], minlength=n), short, marked, longest]), owner, words


def statistics(column: pa.Array) -> np.ndarray:
    """One row of ``FEATURES`` per text; null and empty texts give zeros."""
    data, offsets = T.buffers(column)
    out = np.zeros((len(column), len(FEATURES)))
    for i, j in T.steps(offsets, PIECE):
        total, owners, hashes = np.zeros((j - i, 14)), [], []
        for lo in range(int(offsets[i]), max(int(offsets[j]), int(offsets[i]) + 1), PIECE):
            hi = min(lo + PIECE, int(offsets[j]))
            cuts = np.clip(offsets[i : j + 1], lo, hi) - lo
            part, owner, words = _counts(data[lo:hi], cuts)
            longest = np.maximum(total[:, -1], part[:, -1])
            total += part
            total[:, -1] = longest
            owners.append(owner)
            hashes.append(words)
        owner, words = np.concatenate(owners), np.concatenate(hashes)
        order = np.lexsort((words, owner))
        new = np.ones(len(order), dtype=bool)
        new[1:] = (words[order][1:] != words[order][:-1]) | (owner[order][1:] != owner[order][:-1])
        distinct = np.bincount(owner[order][new], minlength=j - i)
        size, n = np.maximum(total[:, 0], 1), np.maximum(total[:, 1], 1)
        other, upper, digit, symbol, white, stop, lower = total[:, 2:9].T
        lines, again, short, marked, longest = total[:, 9:14].T
        out[i:j] = np.column_stack([
            np.log1p(total[:, 0]), np.log1p(total[:, 1]), (size - white) / n, upper / size, digit / size, symbol / size, white / size,
            np.log1p(n / (lines + 1)), distinct / n, again / n, stop / n, short / n, marked / n, (upper + lower) / size, np.log1p(longest)])
    return out


@dataclass(frozen=True)
class Model:
    edges: list[np.ndarray]  # per feature, upper bounds of all bins but the last
    tables: list[np.ndarray]  # per feature, one value per bin
    coarse: list[np.ndarray]  # per feature, pair bin of each bin
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]
    bias: float


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, least: float, l2: float) -> np.ndarray:
    """A shallow tree over ordered bins: residual sums g, weights h -> a value per bin; best splits first."""
    parts, out = [(0, len(g))], np.zeros(len(g))
    cg, ch = np.append(0, np.cumsum(g)), np.append(0, np.cumsum(h))
    gain_of = lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + l2)
    while len(parts) < leaves:
        best = (1e-9, None, 0)
        for k, (a, b) in enumerate(parts):
            cut = np.arange(a + 1, b)
            if len(cut):
                gain = (cg[cut] - cg[a]) ** 2 / (ch[cut] - ch[a] + l2) + (cg[b] - cg[cut]) ** 2 / (ch[b] - ch[cut] + l2) - gain_of(a, b)
                gain[(ch[cut] - ch[a] < least) | (ch[b] - ch[cut] < least)] = -1
                m = int(gain.argmax())
                if gain[m] > best[0]:
                    best = (gain[m], k, int(cut[m]))
        if best[1] is None:
            break
        a, b = parts.pop(best[1])
        parts += [(a, best[2]), (best[2], b)]
    for a, b in parts:
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + l2)
    return out


def _cells(g: np.ndarray, h: np.ndarray, least: float, l2: float) -> tuple[np.ndarray, float]:
    """A depth-two tree over two features: one cut of either, then one of the other in each half; (table, gain)."""
    best = (np.zeros_like(g), 0.0)
    for turned in (False, True):
        gg, hh = (g.T, h.T) if turned else (g, h)
        for cut in range(1, len(gg)):
            halves = [_tree(gg[s].sum(axis=0), hh[s].sum(axis=0), 2, least, l2) for s in (slice(0, cut), slice(cut, None))]
            gain = sum(float((v * gg[s].sum(axis=0)).sum()) for v, s in zip(halves, (slice(0, cut), slice(cut, None)), strict=True))
            if gain > best[1]:
                table = np.vstack([np.tile(halves[0], (cut, 1)), np.tile(halves[1], (len(gg) - cut, 1))])
                best = (table.T if turned else table, gain)
    return best


def train(x: np.ndarray, y: np.ndarray, rounds: int = 150, rate: float = 0.1, leaves: int = 3, least: float = 2.0, l2: float = 1.0) -> Model:
    """Statistics and labels (0, 1) -> model; without both classes a constant one."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.zeros(0) for c in x.T]
    bins = [np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)]
    sizes = [len(e) + 1 for e in edges]
    coarse = [np.arange(s) * PAIR_BINS // max(s, PAIR_BINS) for s in sizes]
    tables = [np.zeros(s) for s in sizes]
    if not len(y) or y.min() == y.max():
        return Model(edges, tables, coarse, [], [], 4.0 if len(y) and y.min() else -4.0)
    bias = float(np.log(y.mean() / (1 - y.mean())))
    z = np.full(len(y), bias)

    def residual():
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for k, b in enumerate(bins):
            g, h = residual()
            step = rate * _tree(np.bincount(b, weights=g, minlength=sizes[k]), np.bincount(b, weights=h, minlength=sizes[k]), leaves, least, l2)
            tables[k] += step
            z += step[b]
    small = [c[b] for c, b in zip(coarse, bins, strict=True)]

    def joint(i, j):
        g, h = residual()
        at = small[i] * PAIR_BINS + small[j]
        return tuple(np.bincount(at, weights=w, minlength=PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS) for w in (g, h))

    ranked = sorted(combinations(range(len(bins)), 2), key=lambda p: -_cells(*joint(*p), least, l2)[1])[:PAIRS]
    pair_tables = [np.zeros((PAIR_BINS, PAIR_BINS)) for _ in ranked]
    for _ in range(rounds // 5):
        for k, (i, j) in enumerate(ranked):
            step = rate * _cells(*joint(i, j), least, l2)[0]
            pair_tables[k] += step
            z += step[small[i], small[j]]
    for t, b in zip(tables, bins, strict=True):  # a feature's table has mean zero, what it says on average is the bias
        mean = t[b].mean()
        t -= mean
        bias += mean
    return Model(edges, tables, coarse, ranked, pair_tables, bias)


def scores(model: Model, x: np.ndarray) -> np.ndarray:
    bins = [np.searchsorted(e, c, side="left") for e, c in zip(model.edges, x.T, strict=True)]
    z = model.bias + sum((t[b] for t, b in zip(model.tables, bins, strict=True)), np.zeros(len(x)))
    for (i, j), t in zip(model.pairs, model.pair_tables, strict=True):
        z += t[model.coarse[i][bins[i]], model.coarse[j][bins[j]]]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def held_out(docs: DataFrame) -> DataFrame:
    """``docs`` with ``held_out``: rows that no model of this operator learns from."""
    return docs.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False)))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> Model:
    """Model from the labelled documents that are not held out; labels are (doc_id, quality).

    The bias follows the share of label 1 among all of them, not that of the sample.
    """
    place = F.xxhash64(F.col("doc_id"), F.lit(10))
    known = held_out(labels.select("doc_id", F.col("quality").cast("int").alias("label")).where("quality in (0, 1)")).where("not held_out").select("doc_id", "label").distinct()
    chosen = known.where("label = 1").orderBy(place, "doc_id").limit(per_class).unionByName(
        known.where("label = 0").orderBy(place, "doc_id").limit(per_class))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(statistics(batch.column(1))), pa.list_(pa.float64()))], ["label", "x"])

    rows = docs.select("doc_id", "text").join(chosen, "doc_id").select("label", "text").mapInArrow(describe, "label int, x array<double>").toPandas()
    x = np.array(rows["x"].tolist(), dtype=np.float64).reshape(-1, len(FEATURES))
    y = rows["label"].to_numpy(dtype=np.float64)
    order = np.lexsort(np.column_stack([x, y]).T)  # the order in which tasks end is no input
    model = train(x[order], y[order])
    count = known.agg(F.sum("label").alias("ones"), F.count("*").alias("n")).first()
    if not (0 < y.sum() < len(y)):
        return model
    share, mine = count["ones"] / count["n"], y.mean()
    return Model(model.edges, model.tables, model.coarse, model.pairs, model.pair_tables,
                 float(model.bias + np.log(share / (1 - share)) - np.log(mine / (1 - mine))))


def predict(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted: one row per row of ``docs``; null texts score as empty ones. Other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores(model, statistics(batch.column(1))))], ["doc_id", "score"])

    scored = held_out(docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
