"""Benchmark decontamination: word edit distance of items to any run of a document's words.

An item of n words is found in a document if some run of its words, n - k to n + k long, is within edit distance
k = floor((1 - similarity) * n) of the item, counted in words (white space and punctuation aside, case folded).

1. Windows: a run that close to an item keeps at least n - 1 - 2k of its word pairs, each moved by at most k words. Pairs
   that documents share with an item vote for (item, start); starts with enough votes within k words are the windows to
   compare, each of n + k words. This loses nothing.
2. Candidates: a CGK walk copies the current word at each step and moves on by a coin that depends on step and word, so
   that edit distance becomes Hamming distance. Bit sampling hashes a few steps of the walk to a key; a document and an item
   go on if a window shares a key with the item. Walks are repeated, and pairs that have met leave, until ``WALKS`` are
   done. Walks run on into the text after a window, so runs longer or shorter than the item are walked alike.
3. Exact word edit distance from every start of a met pair to every end, the least of which is returned.

Only step 2 can lose a copy. Its recall against ``nearest``, which skips it and is exact, is tested: at least 0.97 of pairs
with as many edits as are allowed, all of the copies without an edit. Items of one word are looked up.

Characters of scripts that are written without spaces (Chinese, Japanese, Thai and the like) count as words of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lurewatch.llm import text as T

SIMILARITY = 0.8
#: Items with fewer words are not searched unless a caller asks for them (the queries do: ``least_words`` = 1).
LEAST_WORDS = 5
#: Walks at most, keys per walk, steps that a key is made of, and the share of an item's words that keys look at (a walk
#: takes about two steps a word).
WALKS, SAMPLES, SAMPLED_STEPS, LOOKED_AT = 24, 16, 3, 0.75
#: Items that are sought in one pass over the documents; more take more passes.
ITEMS_PER_PASS = 20_000
_FILTER_BITS = 20
_END = np.uint64(1)  # stands for words past the end of a text; no word hashes to it but by chance

_INSIDE = np.zeros(256, dtype=bool)
_INSIDE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


#: Code points, first and last, of scripts without spaces, and of punctuation beyond ASCII.
_UNSPACED = np.array([(0x0E00, 0x109F), (0x1780, 0x17FF), (0x3005, 0x3007), (0x3040, 0x30FA), (0x30FC, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF),
                      (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x20000, 0x3FFFF)])
_MARKS = np.array([(0x2000, 0x200A), (0x2010, 0x206F), (0x3000, 0x3004), (0x3008, 0x303F), (0x30FB, 0x30FB), (0xFF01, 0xFF0F), (0xFF1A, 0xFF20), (0xFF3B, 0xFF40), (0xFF5B, 0xFF65)])


def _among(points: np.ndarray, ranges: np.ndarray) -> np.ndarray:
    place = np.searchsorted(ranges[:, 0], points, side="right") - 1
    return (place >= 0) & (points <= ranges[place, 1])


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of folded words and their number per row; characters of ``_UNSPACED`` are words."""
    data, inside, cuts = T.LOWER[data], _INSIDE[data], [offsets]
    for lead, last, size in ((0xE0, 0xEF, 3), (0xF0, 0xF7, 4)):
        at = np.flatnonzero((data >= lead) & (data <= last))
        at = at[at + size <= len(data)]
        points = data[at].astype(np.int64) & (0xFF >> (size + 1))
        for i in range(1, size):
            points = points << 6 | data[at + i] & 63
        alone, mark = at[_among(points, _UNSPACED)], at[_among(points, _MARKS)]
        cuts += [alone, alone + size]
        inside[(mark[:, None] + np.arange(size)).ravel()] = False
    starts, ends = T.runs(inside, np.concatenate(cuts))
    hashes = T.mix(T.slices(T.prefix(T.BYTE_UNITS[data]), starts, ends) + (ends - starts).astype(np.uint64))
    return hashes, np.diff(np.searchsorted(starts, offsets))


def _pairs(w: np.ndarray) -> np.ndarray:
    return T.mix(w[:-1] * np.uint64(T.BASE) + w[1:])


def walked_steps(n: int) -> int:
    """Steps of the walk from an item of n words that keys are sampled from."""
    return max(1, int(2 * LOOKED_AT * n))


def walk(rows: np.ndarray, seed: int, steps: int) -> np.ndarray:
    """CGK embedding of rows of words: the words copied at ``steps`` steps, ``_END`` once a walk has left its row."""
    count, n = rows.shape
    at, out = np.zeros(count, dtype=np.int64), np.zeros((count, steps), dtype=np.uint64)
    padded = np.hstack([rows, np.full((count, 1), _END)])
    line = np.arange(count)
    for step in range(steps):
        word = padded[line, at]
        out[:, step] = word
        coin = T.mix(word + np.uint64((seed * 4096 + step) * T.BASE & (1 << 64) - 1)) >> np.uint64(63)
        at = np.minimum(at + coin.astype(np.int64), n)
    return out


def keys(rows: np.ndarray, n: int, number: int, samples: int = SAMPLES, sampled: int = SAMPLED_STEPS) -> np.ndarray:
    """Keys (rows x samples) of walk ``number`` for items of n words and for windows that are compared with them."""
    embedded, random = walk(rows, number, walked_steps(n)), np.random.default_rng([number, n])
    key = np.zeros((len(rows), samples), dtype=np.uint64)
    for chosen in random.integers(0, walked_steps(n), (sampled, samples)):
        key = T.mix(key + embedded[:, chosen])
    return key


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Edit distances of rows of a to all beginnings of rows of b, pair by pair."""
    count, n = a.shape
    row = np.tile(np.arange(b.shape[1] + 1), (count, 1))
    for i in range(n):
        change = row[:, :-1] + (a[:, i : i + 1] != b)
        new = np.empty_like(row)
        new[:, 0] = i + 1
        new[:, 1:] = np.minimum(change, row[:, 1:] + 1)
        steps = np.arange(new.shape[1])
        row = np.minimum.accumulate(new - steps, axis=1) + steps  # insertions, from left to right
    return row


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Edit distances of rows of a and b, pair by pair."""
    return _distances(a, b)[:, -1]


def free_end_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Edit distances of rows of a to the nearest beginning of the row of b."""
    return _distances(a, b).min(axis=1)


@dataclass(frozen=True)
class Group:
    """Items of one number of words: their words, numbers and keys, one array of keys per walk."""

    rows: np.ndarray
    items: np.ndarray
    keys: list[np.ndarray]


@dataclass(frozen=True)
class Index:
    ids: np.ndarray  # of each item: its id, words, allowed distance, least votes
    sizes: np.ndarray
    allowed: np.ndarray
    least: np.ndarray
    groups: dict[int, Group]
    pairs: np.ndarray  # distinct word pairs, and where in which items they stand
    begin: np.ndarray
    post_item: np.ndarray
    post_at: np.ndarray
    may: np.ndarray


def build_index(items: list[tuple[int, str | None]], similarity: float = SIMILARITY, walks: int = WALKS, least_words: int = LEAST_WORDS) -> Index:
    known = []
    for item, text in items:
        body = np.frombuffer((text or "").encode(), dtype=np.uint8)
        w = words(body, np.array([0, len(body)]))[0]
        if len(w) >= max(1, least_words):
            known.append((item, w))
    sizes = np.array([len(w) for _, w in known], dtype=np.int64)
    allowed = ((1 - similarity) * sizes + 1e-9).astype(np.int64)
    groups = {}
    for n in np.unique(sizes):
        mine = np.flatnonzero(sizes == n)
        rows = np.array([known[i][1] for i in mine])
        groups[int(n)] = Group(rows, mine, [keys(rows, int(n), number) for number in range(walks if n > 1 else 0)])
    pairs = np.concatenate([_pairs(w) for _, w in known] or [np.zeros(0, dtype=np.uint64)])
    item = np.repeat(np.arange(len(known)), np.maximum(sizes - 1, 0))
    at = np.concatenate([np.arange(len(w) - 1) for _, w in known] or [np.zeros(0, dtype=np.int64)])
    turn = np.argsort(pairs, kind="stable")
    distinct, begin = np.unique(pairs[turn], return_index=True)
    may = np.zeros(1 << _FILTER_BITS, dtype=bool)
    may[(distinct >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
    return Index(np.array([i for i, _ in known], dtype=np.int64), sizes, allowed, np.maximum(1, sizes - 1 - 2 * allowed), groups,
                 distinct, np.append(begin, len(pairs)), item[turn], at[turn], may)


def _spread(low: np.ndarray, many: np.ndarray) -> np.ndarray:
    """low[i], low[i] + 1, ... of many[i] numbers, one after the other."""
    return np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)


def _starts(index: Index, w: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, item, first word) of windows with enough votes."""
    none = (np.zeros(0, dtype=np.int64),) * 3
    if len(w) < 2:
        return none
    begin = np.concatenate([[0], np.cumsum(counts)])
    pairs = _pairs(w)
    some = np.flatnonzero(index.may[(pairs >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
    place = np.minimum(np.searchsorted(index.pairs, pairs[some]), len(index.pairs) - 1)
    same = index.pairs[place] == pairs[some]
    some, place = some[same], place[same]
    row = np.searchsorted(begin, some, side="right") - 1
    inside = some + 1 < begin[row + 1]
    some, place, row = some[inside], place[inside], row[inside]
    many = index.begin[place + 1] - index.begin[place]
    post = _spread(index.begin[place], many)
    row, item = np.repeat(row, many), index.post_item[post]
    longest = int(index.sizes.max())
    span = np.int64(int(counts.max()) + 4 * longest)
    votes = np.sort((row * len(index.ids) + item) * span + (np.repeat(some, many) - begin[row] - index.post_at[post] + 2 * longest))
    if not len(votes):
        return none
    item = votes // span % len(index.ids)
    wide = np.searchsorted(votes, votes + 2 * index.allowed[item], side="right") - np.arange(len(votes)) >= index.least[item]
    low, k = np.unique(votes[wide], return_index=True)
    k = index.allowed[item[wide][k]]
    start = np.unique(_spread(low - k, 2 * k + 1))
    item, row, first = start // span % len(index.ids), start // span // len(index.ids), start % span - 2 * longest
    k = index.allowed[item]
    enough = np.searchsorted(votes, start + k, side="right") - np.searchsorted(votes, start - k, side="left") >= index.least[item]
    keep = enough & (first >= 0) & (first + index.sizes[item] <= counts[row] + k)
    return row[keep], item[keep], first[keep]


def _single(index: Index, w: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, item, first word) of the first place of each item of one word in each row."""
    if 1 not in index.groups or not len(w):
        return (np.zeros(0, dtype=np.int64),) * 3
    group = index.groups[1]
    turn = np.argsort(group.rows[:, 0], kind="stable")
    ordered = group.rows[turn, 0]
    low = np.searchsorted(ordered, w, side="left")
    at = np.flatnonzero(ordered[np.minimum(low, len(ordered) - 1)] == w)
    row = np.searchsorted(begin, at, side="right") - 1
    once = np.unique(row * len(ordered) + low[at], return_index=True)[1]
    at, row = at[once], row[once]
    many = np.searchsorted(ordered, w[at], side="right") - low[at]
    return np.repeat(row, many), group.items[turn[_spread(low[at], many)]], np.repeat(at - begin[row], many)


def _met(group: Group, pair: np.ndarray, place: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Which windows belong to a pair (document, item) of which some window shares a key with the item.

    ``pair`` numbers the windows' pairs from 0 on, ``place`` is the item in its group, ``text`` the windows' words.
    """
    met = np.zeros(int(pair.max()) + 1 if len(pair) else 0, dtype=bool)
    n = group.rows.shape[1]
    for number, of_items in enumerate(group.keys):
        left = np.flatnonzero(~met[pair])
        if not len(left):
            break
        same = (keys(text[left], n, number) == of_items[place[left]]).any(axis=1)
        met[pair[left[same]]] = True
    return met[pair]


def search(index: Index, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(row, item_id, distance, first word, words) of the nearest run of words of each item found in a row, by CGK keys."""
    return _search(index, data, offsets, True)


def nearest(index: Index, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """What ``search`` returns, from all windows whether they share a key or not; misses none."""
    return _search(index, data, offsets, False)


def _search(index: Index, data: np.ndarray, offsets: np.ndarray, by_keys: bool) -> list[tuple[int, int, int, int, int]]:
    found: dict[tuple[int, int], tuple[int, int, int]] = {}
    waiting: dict[int, list[tuple[np.ndarray, ...]]] = {}

    def settle(n: int) -> None:
        row, item, first, text = (np.concatenate(x) for x in zip(*waiting.pop(n), strict=True))
        group = index.groups[n]
        if by_keys:
            _, pair = np.unique(row * len(index.ids) + item, return_inverse=True)
            keep = _met(group, pair, np.searchsorted(group.items, item), text)
            row, item, first, text = row[keep], item[keep], first[keep], text[keep]
        for i in range(0, len(row), 20_000):
            r, q, f = row[i : i + 20_000], item[i : i + 20_000], first[i : i + 20_000]
            d = free_end_distances(group.rows[np.searchsorted(group.items, q)], text[i : i + 20_000])
            turn = np.lexsort((f, d, q, r))
            turn = turn[d[turn] <= index.allowed[q[turn]]]
            turn = turn[np.unique(r[turn] * len(index.ids) + q[turn], return_index=True)[1]]
            for r1, q1, d1, f1 in zip(r[turn].tolist(), q[turn].tolist(), d[turn].tolist(), f[turn].tolist(), strict=True):
                key, best = (r1, int(index.ids[q1])), (d1, f1, n)
                if key not in found or best < found[key]:
                    found[key] = best

    for i, j in T.steps(offsets) if len(index.ids) else ():
        w, counts = words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        begin = np.concatenate([[0], np.cumsum(counts)])
        for r, q, f in zip(*(x.tolist() for x in _single(index, w, begin)), strict=True):
            found[r + i, int(index.ids[q])] = (0, f, 1)
        row, item, first = _starts(index, w, counts)
        for n in np.unique(index.sizes[item]).tolist():
            mine = np.flatnonzero(index.sizes[item] == n)
            for some in np.split(mine, range(20_000, len(mine), 20_000)):
                r = row[some]
                at = first[some][:, None] + np.arange(n + index.allowed[item[some[0]]])
                text = np.where(at < counts[r][:, None], w[np.minimum(begin[r][:, None] + at, len(w) - 1)], _END)
                waiting.setdefault(n, []).append((r + i, item[some], first[some], text))
                if sum(len(x[0]) for x in waiting[n]) >= 20_000:
                    settle(n)
    for n in list(waiting):
        settle(n)
    return [(r, item, *best) for (r, item), best in sorted(found.items())]


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, items_per_pass: int = ITEMS_PER_PASS,
                 least_words: int = LEAST_WORDS) -> DataFrame:
    """One row per document and item found in it: doc_id, item_id, distance (words), first_word, n_words (of the item).

    Of several runs of words the nearest counts, the first of equals. Null and empty texts hold nothing; items that are
    null or have under ``least_words`` words are not searched, those of one to four words are found as exact copies; equal items are each reported; a document that occurs
    twice is reported twice. The items are the query set: they are sent to the tasks in passes of ``items_per_pass``.
    """
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, distance int, first_word long, n_words int"
    items = benchmark.where("item_id is not null and text is not null").select("item_id", "text")
    passes = max(1, -(-items.count() // items_per_pass))
    out = spark.createDataFrame([], schema)
    for number in range(passes):
        some = items.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == number).collect() if passes > 1 else items.collect()
        index = spark.sparkContext.broadcast(build_index([(r["item_id"], r["text"]) for r in sorted(some)], similarity, least_words=least_words))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                data, offsets = T.buffers(batch.column(1))
                ids = batch.column(0).to_pylist()
                rows = search(index.value, data, offsets)
                if rows:
                    r, item, d, first, n = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([ids[k] for k in r], pa.int64()), pa.array(item, pa.int64()), pa.array(d, pa.int32()), pa.array(first, pa.int64()), pa.array(n, pa.int32())],
                        ["doc_id", "item_id", "distance", "first_word", "n_words"])

        out = out.unionByName(docs.select("doc_id", "text").mapInArrow(run, schema)) if number else docs.select("doc_id", "text").mapInArrow(run, schema)
    return out
