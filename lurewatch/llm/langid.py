"""Language ID: multinomial logistic regression on TF-IDF character n-grams.

The weights come from follow-the-regularised-leader (FTRL-proximal, per-coordinate rates) with an elastic
net: the L1 part leaves most weights at exactly zero, the L2 part keeps the rest small. A held-back share of
the training rows then sets one temperature that calibrates the probabilities.
Features are hashed character n-grams of lower-cased letters, words padded by a space. Term frequencies
are shares of the document's n-grams, so that a document is scored by one weighted sum over its positions, whatever its length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Width of the hashed n-gram space.
WIDTH = 1 << 16
SIZES = (2, 3)
#: Labelled rows at most that a model is fitted on, taken by hash order within each language.
SAMPLE_PER_LANGUAGE = 1500
#: Weights at most, so that a model stays small however many languages there are: beyond 256 languages n-grams share
#: weights. All languages are learned; more than ``MAX_LANGUAGES`` (the column then is no language) raise an error.
WEIGHTS, MAX_LANGUAGES = 1 << 24, 1 << 14
#: Labelled rows at most of all languages together.
MAX_SAMPLE = 256 * SAMPLE_PER_LANGUAGE
STEP_CHARS = 1 << 18
#: Factor of all features: term frequencies are shares, which alone would be small next to the penalties.
SCALE = 10.0
_MULTIPLY = np.uint32(2654435761)


def _letters() -> np.ndarray:
    """Of every code point: its lower-case letter, or a space."""
    out = np.full(0x110000, 32, dtype=np.uint32)
    for c in range(0x40000):  # no letters beyond
        if not 0xD800 <= c < 0xE000 and chr(c).isalpha():
            low = chr(c).lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


_table: list[np.ndarray] = []


def letters() -> np.ndarray:
    if not _table:
        _table.append(_letters())
    return _table[0]


def grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, hashed n-gram) of every n-gram position of a step of texts, rows in order, for each size.

    Runs of anything but letters count as one space, one of which precedes and follows each text.
    """
    joined = " ".join(f" {t} " for t in texts)
    points = letters()[np.frombuffer(joined.encode("utf-32-le", "replace"), dtype=np.uint32)]
    sizes = np.array([len(t) + 3 for t in texts])
    sizes[-1] -= 1
    row = np.repeat(np.arange(len(texts)), sizes)
    keep = np.ones(len(points), dtype=bool)
    keep[1:] = (points[1:] != 32) | (points[:-1] != 32) | (row[1:] != row[:-1])
    points, row = points[keep], row[keep]
    for n in SIZES:
        count = max(0, len(points) - n + 1)
        h, solid = np.full(count, n, dtype=np.uint32), np.zeros(count, dtype=bool)
        for k in range(n):
            part = points[k : k + count]
            h = (h ^ (h >> np.uint32(15)) ^ part) * _MULTIPLY
            solid |= part != 32
        h ^= h >> np.uint32(16)
        same = solid & (row[:count] == row[n - 1 : n - 1 + count])
        yield row[:count][same], h[same] & np.uint32(WIDTH - 1)


def term_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of one text and their counts; a long text is counted piece by piece."""
    total = np.zeros(WIDTH, dtype=np.int64)
    for i in range(0, max(1, len(text)), STEP_CHARS):
        for _, gram in grams([text[i : i + STEP_CHARS]]):
            total += np.bincount(gram, minlength=WIDTH)
    ids = np.flatnonzero(total)
    return ids, total[ids]


@dataclass(frozen=True)
class Model:
    languages: list[str]
    weights: np.ndarray  # width x languages, idf included
    bias: np.ndarray
    temperature: float


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def width_for(languages: int) -> int:
    """Width of the n-gram space for a number of languages, a power of two."""
    return min(WIDTH, 1 << (WEIGHTS // max(1, languages)).bit_length() - 1)


def folded(ids: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """N-grams and counts in a narrower space."""
    if width == WIDTH:
        return ids, counts
    ids, place = np.unique(ids & (width - 1), return_inverse=True)
    return ids, np.bincount(place, counts)


def train(rows: list[tuple[np.ndarray, np.ndarray, str]], alpha: float = 2.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.002,
          rounds: int = 4, seed: int = 7) -> Model:
    """Rows (n-gram ids, counts, language) -> model. A fifth of the rows is held back for the temperature."""
    languages = sorted({r[2] for r in rows})
    if not languages:
        return Model([], np.zeros((WIDTH, 0)), np.zeros(0), 1.0)
    width = width_for(len(languages))
    rows = [(*folded(ids, counts, width), name) for ids, counts, name in rows]
    number = {v: i for i, v in enumerate(languages)}
    frequency = np.zeros(width)
    for ids, _, _ in rows:
        frequency[ids] += 1
    idf = np.log((1 + len(rows)) / (1 + frequency)) + 1
    order = np.random.default_rng(seed).permutation(len(rows))
    held = order[: len(rows) // 5] if len(rows) >= 5 else order
    fit = order[len(rows) // 5 :] if len(rows) >= 5 else order
    z = np.zeros((width + 1, len(languages)))
    n = np.zeros((width + 1, len(languages)))

    def vector(row):
        return np.append(row[0], width), np.append(idf[row[0]] * row[1] * (SCALE / row[1].sum()), 1.0)

    def weights(i):
        shrunk = np.sign(z[i]) * np.maximum(np.abs(z[i]) - l1, 0)
        return -shrunk / ((beta + np.sqrt(n[i])) / alpha + l2)

    for _ in range(rounds):
        for r in fit:
            ids, x = vector(rows[r])
            w = weights(ids)
            p = _softmax(x @ w)
            p[number[rows[r][2]]] -= 1
            g = x[:, None] * p
            sigma = (np.sqrt(n[ids] + g * g) - np.sqrt(n[ids])) / alpha
            z[ids] += g - sigma * w
            n[ids] += g * g
    w = weights(np.arange(width + 1))
    scores = np.array([(lambda v: v[1] @ w[v[0]])(vector(rows[r])) for r in held])
    truth = np.array([number[rows[r][2]] for r in held])
    grid = np.exp(np.linspace(np.log(0.05), np.log(20), 121))
    target = np.full(scores.shape, 1 / (len(truth) + 2) / len(languages))  # smoothed, or separable rows would call for a temperature of zero
    target[np.arange(len(truth)), truth] += 1 - 1 / (len(truth) + 2)
    loss = [-(target * np.log(np.maximum(_softmax(scores / t), 1e-300))).sum(axis=1).mean() for t in grid]
    return Model(languages, w[:width] * idf[:, None], w[width], float(grid[int(np.argmin(loss))]))


def column_size(column: pa.ChunkedArray, i: int) -> int:
    return column[i].as_buffer().size


def training_rows(labelled: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> list[tuple[np.ndarray, np.ndarray, str]]:
    """A bounded sample of (doc_id, text, lang): at most ``per_language`` rows of each of the languages, by hash order.

    Counts per language are taken over all rows; the sampling thresholds follow from them, so that only
    candidates near the bound are ordered. Term counts are made in the tasks. All languages together give at most
    ``MAX_SAMPLE`` rows, each at least one.
    """
    known = labelled.where("text is not null and lang is not null")
    sizes = known.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not sizes:
        return []
    per_language = max(1, min(per_language, MAX_SAMPLE // len(sizes)))
    share = known.sparkSession.createDataFrame([(r["lang"], min(1.0, 1.1 * per_language / r["count"])) for r in sizes], "lang string, share double")
    place = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(9)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    some = known.select("text", "lang", place.alias("place")).join(F.broadcast(share), "lang").where("place < share").select("text", "lang", "place")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            counted = [term_counts(t) for t in pdf["text"]]
            yield pd.DataFrame({"lang": pdf["lang"], "place": pdf["place"], "ids": [c[0].astype(np.int32).tobytes() for c in counted], "n": [c[1].astype(np.int32).tobytes() for c in counted]})

    rows = some.mapInPandas(count, "lang string, place double, ids binary, n binary").toArrow()  # bytes stay where Arrow put them; the rows are views
    chosen = rows.select(["lang", "place"]).to_pandas().sort_values(["lang", "place"], kind="stable").groupby("lang").head(per_language)
    ids, n = rows["ids"], rows["n"]
    view = lambda column, i: np.frombuffer(column[i].as_buffer(), dtype=np.int32)
    return [(view(ids, i), view(n, i), v) for i, v in zip(chosen.index.tolist(), chosen["lang"], strict=True) if column_size(ids, i)]


def _pieces(texts: list[str]) -> Iterator[tuple[list[str], np.ndarray]]:
    """Steps of (pieces of texts, the text each belongs to), of about ``STEP_CHARS`` characters."""
    step, owner, size = [], [], 0
    for i, t in enumerate(texts):
        for k in range(0, max(1, len(t)), STEP_CHARS):
            piece = t[k : k + STEP_CHARS]
            if step and size + len(piece) > STEP_CHARS:
                yield step, np.array(owner)
                step, owner, size = [], [], 0
            step.append(piece)
            owner.append(i)
            size += len(piece) + 3
    if step:
        yield step, np.array(owner)


def logits(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Uncalibrated scores of each text and its number of n-grams."""
    sums, total = np.zeros((len(texts), len(model.languages))), np.zeros(len(texts))
    table = model.weights.astype(np.float32)
    for step, owner in _pieces(texts):
        for row, gram in grams(step):
            if not len(row):
                continue
            heads = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
            np.add.at(sums, owner[row[heads]], np.add.reduceat(table[gram & np.uint32(len(table) - 1)], heads, axis=0))
            np.add.at(total, owner[row[heads]], np.diff(np.append(heads, len(row))))
    return SCALE * sums / np.maximum(total, 1)[:, None] + model.bias, total


def predict(docs: DataFrame, model: Model, unknown: str = "und") -> DataFrame:
    """doc_id, lang_pred, score (calibrated probability): one row per row of ``docs``.

    ``unknown`` with score 0 for null and empty texts, texts without a letter, and if no language was learned.
    Ties go to the language that sorts first; other columns are ignored; repeated rows are each returned; no rows, no
    rows. A text over ``STEP_CHARS`` characters is counted piece by piece, so that the few n-grams over a cut are missed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z, total = logits(model, [t.as_py() or "" for t in batch.column(1)])
            known = total > 0
            if model.languages:
                p = _softmax(z / model.temperature)
                best = p.argmax(axis=1)
                names, score = np.array(model.languages, dtype=object)[best], p[np.arange(len(best)), best]
            else:
                known[:] = False
                names, score = np.full(len(total), unknown, dtype=object), np.zeros(len(total))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.where(known, names, unknown), pa.string()), pa.array(np.where(known, score, 0.0))],
                ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def held_out(docs: DataFrame) -> DataFrame:
    """``docs`` with ``held_out``: rows that no model of this operator learns from."""
    return docs.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False)))


def fit(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> Model:
    """Model from text and lang of the documents that are not held out."""
    return train(training_rows(held_out(docs).where("not held_out"), per_language))


def identify(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of ``docs``, by a model fitted on its labelled rows."""
    return held_out(predict(docs, fit(docs, per_language))).select("doc_id", "held_out", "lang_pred", "score")
