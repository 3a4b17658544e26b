"""Ranked lexical search of many items at once, with term sets that items share evaluated once per document.

1. Items are dealt into blocks of a bounded number of terms; a block is one pass over the documents. Within a block, pairs
   of symbols (terms, or sets found before) that occur together in two or more items become sets of their own, most
   frequent first, until no pair is shared: a DAG in which every node is the union of two others and every item is a
   union of a few nodes.
2. Documents become vectors of the block's terms, written once: doc_id, number of terms, term numbers, occurrences.
   Document frequencies, the number of documents and their lengths are counted from this table.
3. Each task reads vectors some rows at a time. The contributions of single terms are the DAG's leaves; level by level,
   each shared set's accumulator is added up once from its two parts for all these rows; an item's scores are the sum of
   its few nodes. A task keeps the k best documents of each item so far, and sends on no more than these.
4. The k best of each item are taken per part of the documents first, then of all parts.

Scores are sums of non-negative 64-bit integers, so no order of addition changes them. Equality of terms is equality of
64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lurewatch.llm import text as T
from lurewatch.llm.store import stored

#: Terms of a block's items, each item's own counted (expected number; a block holds whole items).
BLOCK_TERMS = 1 << 18
#: Symbols of an item whose pairs are mined together; longer lists are mined slice by slice.
_SLICE = 64
#: Cells of the accumulators of one step: nodes times rows.
_CELLS = 1 << 20
#: Parts of the documents whose best are taken before those of all.
_PARTS = 64

_INSIDE = np.zeros(256, dtype=bool)
_INSIDE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every term: runs of ASCII letters and digits and of anything beyond ASCII, A-Z lower-cased."""
    starts, ends = T.runs(_INSIDE[data], offsets)
    hashes, _ = T.spans(T.LOWER[data], starts, ends)
    return hashes, np.searchsorted(offsets, starts, side="right") - 1


def _item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term): every term of an item once; rows of the same item_id are one item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = T.buffers(batch.column(1))
            hashes, row = terms(data[offsets[0] : offsets[-1]], offsets - offsets[0])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(T.as_long(hashes))], ["item_id", "term"])

    kind = dict(items.dtypes)["item_id"]
    return items.select("item_id", "text").mapInArrow(run, f"item_id {kind}, term long").distinct()


@dataclass(frozen=True)
class Plan:
    """Nodes 0 .. len(terms) - 1 are terms; the rest come level by level, each the sum of a left and a right node."""

    terms: np.ndarray  # sorted hashes
    left: np.ndarray
    right: np.ndarray
    levels: np.ndarray  # number of nodes of each level above the terms
    nodes: np.ndarray  # the items' nodes, item after item
    starts: np.ndarray  # where each item's nodes begin

    def additions(self) -> int:
        return len(self.left) + len(self.nodes) - len(self.starts)


def _frequent_pairs(sets: list[set[int]]) -> list[tuple[int, int]]:
    """Pairs of symbols that two or more sets hold, each symbol in one pair at most; the most frequent first."""
    found = [np.zeros(0, dtype=np.int64)]
    symbols, counts = np.unique(np.fromiter((s for x in sets for s in x), dtype=np.int64), return_counts=True)
    often = dict(zip(symbols[counts > 1].tolist(), counts[counts > 1].tolist(), strict=True))
    for x in sets:
        shared = sorted((s for s in x if s in often), key=lambda s: (-often[s], s))
        for i in range(0, len(shared), _SLICE):
            part = np.sort(np.array(shared[i : i + _SLICE], dtype=np.int64))
            a, b = np.triu_indices(len(part), 1)
            found.append(part[a] << 32 | part[b])
    pairs, counts = np.unique(np.concatenate(found), return_counts=True)
    pairs, counts = pairs[counts > 1], counts[counts > 1]
    taken, out = set(), []
    for p in pairs[np.argsort(-counts, kind="stable")].tolist():
        a, b = p >> 32, p & 0xFFFFFFFF
        if a not in taken and b not in taken:
            taken |= {a, b}
            out.append((a, b))
    return out


def share(item_terms: list[np.ndarray]) -> Plan:
    """The DAG of one block of items, each given by its distinct terms (one at least)."""
    vocabulary = np.unique(np.concatenate(item_terms))
    sets = [set(np.searchsorted(vocabulary, x).tolist()) for x in item_terms]
    parts: list[tuple[int, int]] = []
    while pairs := _frequent_pairs(sets):
        partner = {}
        for a, b in pairs:
            partner[a] = (b, len(vocabulary) + len(parts))
            parts.append((a, b))
        for x in sets:
            for a in [s for s in x if s in partner]:
                b, made = partner[a]
                if b in x:
                    x -= {a, b}
                    x.add(made)
    level = np.zeros(len(vocabulary) + len(parts), dtype=np.int64)
    for i, (a, b) in enumerate(parts):
        level[len(vocabulary) + i] = 1 + max(level[a], level[b])
    order = np.argsort(level, kind="stable")
    place = np.argsort(order)
    both = np.array([parts[i - len(vocabulary)] for i in order[len(vocabulary) :]], dtype=np.int64).reshape(-1, 2)
    nodes = [np.sort(place[np.fromiter(x, dtype=np.int64)]) for x in sets]
    return Plan(vocabulary, place[both[:, 0]], place[both[:, 1]], np.bincount(level)[1:], np.concatenate(nodes), np.cumsum([0, *map(len, nodes[:-1])]))


def _plans(items: DataFrame) -> DataFrame:
    """items (block, item, terms) -> one row per block with the arrays of its plan as bytes."""

    def mine(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("item")
        plan = share([np.asarray(x, dtype=np.int64).view(np.uint64) for x in rows["terms"]])
        arrays = {f: np.ascontiguousarray(getattr(plan, f)).astype(np.uint64 if f == "terms" else np.int64).tobytes() for f in Plan.__dataclass_fields__}
        return pd.DataFrame([{"block": rows["block"].iloc[0], **arrays}])

    return items.select("block", "item", "terms").groupBy("block").applyInPandas(mine, "block long, " + ", ".join(f"{f} binary" for f in Plan.__dataclass_fields__))


def _vectors(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """Documents with a term: doc_id, n (terms with repeats) and the terms of ``vocabulary`` among them with their occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(vocabulary)
        for batch in batches:
            data, offsets = T.buffers(batch.column(1))
            for i, j in T.steps(offsets):
                hashes, row = terms(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                n = np.bincount(row, minlength=j - i)
                place = np.minimum(np.searchsorted(vocabulary, hashes), size - 1)
                hit = vocabulary[place] == hashes
                cells, tf = np.unique(row[hit] * size + place[hit], return_counts=True)
                bounds = pa.array(np.searchsorted(cells, np.arange(j - i + 1) * size).astype(np.int32))
                lists = [pa.ListArray.from_arrays(bounds, pa.array(v.astype(np.int32))) for v in (cells % size, tf)]
                made = pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(n), *lists], ["doc_id", "n", "terms", "tf"])
                yield made.filter(pa.array(n > 0))

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n long, terms array<int>, tf array<int>")


def _lengths(n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """10 + (90 n N div L); in whole numbers of any size where 64 bits don't hold them."""
    if int(n.max(initial=0)) * 90 * documents >= 1 << 63:
        return np.array([10 + 90 * x * documents // total for x in n.tolist()], dtype=np.int64)
    return 10 + 90 * n * documents // total


class _Best:
    """The k best (score, smallest doc_id) of each item so far."""

    def __init__(self, items: int, k: int) -> None:
        self.k, self.floor, self.limit = k, np.ones(items, dtype=np.int64), 4 * items * k + (1 << 16)
        self.parts, self.size = [], 0

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        """scores of items (rows) by documents (columns)."""
        item, doc = np.nonzero(scores >= self.floor[:, None])
        self.parts.append((item, scores[item, doc], ids[doc]))
        self.size += len(item)
        if self.size > self.limit:
            self.cut()

    def cut(self) -> tuple[np.ndarray, ...]:
        item, score, doc = (np.concatenate(x) for x in zip(*self.parts, strict=True)) if self.parts else (np.zeros(0, dtype=np.int64),) * 3
        order = np.lexsort((doc, -score, item))
        item, score, doc = item[order], score[order], doc[order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        last = rank == self.k - 1
        self.floor[item[last]] = score[last]
        keep = rank < self.k
        self.parts = [(item[keep], score[keep], doc[keep])]
        self.size = int(keep.sum())
        return self.parts[0]


def _scored(vectors: DataFrame, plan: Plan, weights: np.ndarray, documents: int, total: int, k: int) -> DataFrame:
    """(item, doc_id, score): at least the k best documents of each item, k per task at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaves, nodes = len(plan.terms), len(plan.terms) + len(plan.left)
        levels = np.cumsum([leaves, *plan.levels])
        step, best = max(1, _CELLS // nodes), _Best(len(plan.starts), k)
        for batch in batches:
            bounds = np.asarray(batch.column(2).offsets).astype(np.int64)
            term, tf = (np.asarray(batch.column(c).flatten()).astype(np.int64) for c in (2, 3))
            bounds -= bounds[0]
            ids, m = np.asarray(batch.column(0)), _lengths(np.asarray(batch.column(1)), documents, total)
            for i in range(0, batch.num_rows, step):
                j = min(i + step, batch.num_rows)
                here, row = slice(bounds[i], bounds[j]), np.repeat(np.arange(j - i), np.diff(bounds[i : j + 1]))
                sums = np.zeros((nodes, j - i), dtype=np.int64)
                sums[term[here], row] = weights[term[here]] * (1_000_000_000 * tf[here] // (1000 * tf[here] + 8 * m[i:j][row]))
                for a, b in zip(levels[:-1], levels[1:], strict=True):
                    np.add(sums[plan.left[a - leaves : b - leaves]], sums[plan.right[a - leaves : b - leaves]], out=sums[a:b])
                best.add(np.add.reduceat(sums[plan.nodes], plan.starts, axis=0), ids[i:j])
        item, score, doc = best.cut()
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(doc), pa.array(score)], ["item", "doc_id", "score"])

    return vectors.where("doc_id is not null").mapInArrow(run, "item long, doc_id long, score long")


def _top(found: DataFrame, k: int) -> DataFrame:
    best = Window.orderBy(F.desc("score"), "doc_id")
    per_part = found.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(_PARTS)))
    per_part = per_part.withColumn("rank", F.row_number().over(best.partitionBy("item", "part"))).where(F.col("rank") <= k)
    return per_part.withColumn("rank", F.row_number().over(best.partitionBy("item"))).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 10, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the k documents of highest score above 0 of each item, equal scores by doc_id.

    Rows of ``items`` with the same item_id (null included) are one item; items without a term, and null texts, find nothing.
    Documents with null, empty or termless text find no item and count nowhere; documents without doc_id count in the
    statistics but can't be named, so are not ranked; rows that repeat a doc_id are ranked each on its own. Other columns
    are ignored. Without documents or items the result is empty.
    """
    spark = docs.sparkSession
    pairs = stored(_item_terms(items), "item-terms")
    blocks = -(-pairs.count() // block_terms)
    kind = dict(items.dtypes)["item_id"]
    out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    if not blocks:
        return out
    by_item = pairs.groupBy("item_id").agg(F.sort_array(F.collect_list("term")).alias("terms"))
    numbered = by_item.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks))).withColumn(
        "item", F.row_number().over(Window.partitionBy("block").orderBy("item_id")).cast("long") - 1)
    numbered = stored(numbered, "items")
    plans = stored(_plans(numbered), "plans")
    for block in range(blocks):
        row = plans.where(F.col("block") == block).first()
        if row is None:
            continue
        plan = Plan(**{f: np.frombuffer(row[f], dtype=np.uint64 if f == "terms" else np.int64) for f in Plan.__dataclass_fields__})
        vectors = stored(_vectors(docs, plan.terms), "vectors")
        totals = vectors.agg(F.count("*").alias("documents"), F.sum("n").alias("total")).first()
        if not totals["documents"]:
            break
        df = np.zeros(len(plan.terms), dtype=np.int64)
        counts = vectors.select(F.explode("terms").alias("term")).groupBy("term").count().toArrow()
        df[np.asarray(counts["term"])] = np.asarray(counts["count"])
        weights = np.array([math.floor(1000 * math.log((2 * totals["documents"] + 2) / (2 * d + 1))) for d in df.tolist()], dtype=np.int64)
        best = _top(_scored(vectors, plan, weights, totals["documents"], totals["total"], k), k)
        ids = numbered.where(F.col("block") == block).select("item", "item_id")
        out = out.unionByName(stored(best.join(ids, "item").select("item_id", "rank", "doc_id", "score"), "ranked"))
    return out
