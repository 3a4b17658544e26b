"""Quality rules by repetition coverage: how many characters lie in n-grams and lines that a text says again.

Words are hashed once; the hash of a window of n words rolls on to n + 1 words by one multiplication. A window of n + 1
words can only recur where one of n words does, so each length looks again only at what the one before it found. The
words under a window that occurred earlier are marked, and the code points of marked words are summed, so that the first
occurrence stays free and overlapping windows count once. Everything is done in numpy on the bytes of a batch, many short texts or one long text at a time.

A text is one row of one task: there is no shuffle, and memory is about twelve bytes for each byte of the longest text.
Equality of windows and lines is equality of 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lurewatch.llm import text as T

#: Texts with fewer words fail, as do texts with more than this per cent of words in recurring 3-word windows.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Words a window -> per cent of the words' characters that copies of windows of this length may cover.
NGRAM_LIMITS = {5: 15, 6: 14, 7: 13, 8: 12, 9: 11, 10: 10}
#: Per cent of the lines that may equal an earlier one, and of the words' characters that may lie in these.
LINE_LIMIT, LINE_CHARS_LIMIT = 30, 20
SYMBOLS = b"#*$%&|<>"

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(SYMBOLS)] = True
_ODD = np.uint64(T.BASE)
BASE_COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _seen(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys occur earlier, and which occur elsewhere at all."""
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    earlier = np.zeros(len(keys), dtype=bool)
    earlier[order[1:][same]] = True
    anywhere = earlier.copy()
    anywhere[order[:-1][same]] = True
    return earlier, anywhere


def _under(at: np.ndarray, n: int, count: int) -> np.ndarray:
    """Which of ``count`` words lie in windows of n words that start at ``at``."""
    step = np.zeros(count + 1, dtype=np.int32)
    step[at] += 1
    step[at + n] -= 1
    return np.cumsum(step[:-1]) > 0


def _per_row(rows: np.ndarray, count: int, weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(rows, weights=weights, minlength=count).astype(np.int64)


def measure(data: np.ndarray, offsets: np.ndarray, lengths: tuple[int, ...]) -> list[np.ndarray]:
    """Per row of UTF-8 ``data``: the base counts, lines with a word, characters in copies of lines and of windows of each length."""
    count = len(offsets) - 1
    starts, ends = T.runs(~T.WHITE[data], offsets)
    hashes, chars = T.spans(data, starts, ends)
    row = np.searchsorted(offsets, starts, side="right") - 1
    salt = T.mix(np.arange(1, count + 1, dtype=np.uint64))
    symbols = np.flatnonzero(_SYMBOL[data])

    edges = np.unique(np.concatenate([offsets, np.flatnonzero(data == 10) + 1]))
    left, right = edges[:-1], edges[1:]
    right = right - (data[right - 1] == 10) if len(right) else right
    words_before, words_after = np.searchsorted(starts, left), np.searchsorted(starts, right)
    spoken = words_before < words_after
    left, right, words_before, words_after = left[spoken], right[spoken], words_before[spoken], words_after[spoken]
    line_hashes, _ = T.spans(data, left, right)
    line_row = row[words_before]
    again, _ = _seen(line_hashes ^ salt[line_row])
    sums = np.concatenate([[0], np.cumsum(chars)])
    line_chars = sums[words_after[again]] - sums[words_before[again]]

    repeated, covered = np.zeros(0, dtype=bool), {}
    rolling, at = hashes.copy(), np.arange(len(hashes))
    for n in range(2, max(3, *lengths) + 1):
        at = at[at + n <= len(hashes)]
        at = at[row[at] == row[at + n - 1]]
        rolling[at] = rolling[at] * _ODD + hashes[at + n - 1]
        if n == 3 or n in lengths:
            earlier, anywhere = _seen(T.mix(rolling[at]) ^ salt[row[at]])
            if n in lengths:
                inside = _under(at[earlier], n, len(hashes))
                covered[n] = _per_row(row[inside], count, chars[inside])
            at = at[anywhere]
            if n == 3:
                repeated = _under(at, 3, len(hashes))
    return [
        _per_row(row, count), _per_row(row, count, chars), _per_row(np.searchsorted(offsets, symbols, side="right") - 1, count),
        _per_row(line_row[again], count), _per_row(row[repeated], count), _per_row(line_row, count), _per_row(line_row[again], count, line_chars),
        *(covered[n] for n in lengths),
    ]


def _columns(lengths: tuple[int, ...]) -> list[str]:
    return [*BASE_COLUMNS, "n_lines", "dup_line_chars", *(f"dup_{n}_chars" for n in lengths)]


def coverage(docs: DataFrame, lengths: tuple[int, ...] = tuple(NGRAM_LIMITS)) -> DataFrame:
    """doc_id and the measures of each row's whole text, as long columns; rows stay as they are, repeated or not.

    A null, empty or wordless text measures 0 throughout. Other columns are ignored, whatever their names.
    """
    if not lengths or min(lengths) < 3:
        raise ValueError("windows of three words or more")
    names = _columns(lengths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = T.buffers(batch.column(1))
            parts = [measure(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], lengths) for i, j in T.steps(offsets)]
            measured = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, dtype=np.int64)] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, measured)], ["doc_id", *names])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{c} long" for c in names))


def base_failed() -> Column:
    return F.expr(f"n_words < {LEAST_WORDS} or 100 * n_repeat_words > {MOST_REPEATED} * n_words")


def repetitive(limits: dict[int, int] | None = None) -> Column:
    """Whether copies of windows or lines cover more than their limits."""
    windows = [f"100 * dup_{n}_chars > {limit} * word_chars" for n, limit in (limits or NGRAM_LIMITS).items()]
    return F.expr(" or ".join([*windows, f"100 * n_dup_lines > {LINE_LIMIT} * n_lines", f"100 * dup_line_chars > {LINE_CHARS_LIMIT} * word_chars"]))


def judge(docs: DataFrame, limits: dict[int, int] | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, the measures, base_failed and kept.

    ``kept`` is false where the base rules fail or a text is ``repetitive``. A value just at a limit passes. Null, empty
    and wordless texts fail by their number of words; repeated rows are judged alike; an empty table gives an empty one.
    """
    limits = limits or NGRAM_LIMITS
    measured = coverage(docs, tuple(limits))
    return measured.select("doc_id", *BASE_COLUMNS, base_failed().alias("base_failed"), (~base_failed() & ~repetitive(limits)).alias("kept"), *_columns(tuple(limits))[5:])
