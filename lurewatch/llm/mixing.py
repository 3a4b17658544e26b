"""Mixing sources to target weights by Pfair scheduling.

Documents of a source are shuffled by hash and cut into blocks of equal size. With weight w, block j of a source
has the release time floor(j / w) and the deadline ceil((j + 1) / w), in slots of one block each; earliest
deadline first then keeps every source within one block of its share at every slot. A source that runs out
starts over (``epoch``); the schedule is as long as the source takes that needs most slots to be used once,
so every document is placed at least once.

Weights count as they are given, as whole parts of their common denominator, over the whole schedule. No one walks the
whole of it: tasks take ranges of slots and settle by themselves how many blocks of each source are placed at both ends
(``placed``), so that neighbours agree and neither the driver nor a task does more for a longer schedule.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Mapping, Sequence
from fractions import Fraction
from itertools import islice
from math import gcd, lcm

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rounded weights are parts of at least this many, and of sixteen for each source.
LEAST_PARTS = 1 << 14
#: Slots of a range at least, and ranges at most.
TASK_SLOTS, MAX_TASKS = 1 << 14, 1 << 10
BLOCK_DOCS = 64
#: Documents that one task orders at once, on average.
GROUP_DOCS = 768
#: Sources at most: their weights and sizes are known to the driver and to every task.
MAX_SOURCES = 10_000
#: Default weights are the sources' sizes to this power, which lifts small sources.
POWER = 0.7


def whole_parts(weights: Mapping[str, float]) -> dict[str, int]:
    """Weights rounded to parts of a power of two, for a schedule that is one short period; every source gets at least one part."""
    if any(not w > 0 for w in weights.values()):
        raise ValueError("weights must be positive")
    parts = 1 << max(LEAST_PARTS.bit_length() - 1, (16 * len(weights) - 1).bit_length())
    total = sum(weights.values())
    exact = {n: w / total * parts for n, w in weights.items()}
    out = {n: max(1, int(x)) for n, x in exact.items()}
    while rest := parts - sum(out.values()):  # at most a round over the sources
        for n in sorted(out, key=lambda n: ((out[n] - exact[n]) * (1 if rest > 0 else -1), n))[: abs(rest)]:
            out[n] += 1 if rest > 0 else -(out[n] > 1)
    return out


def exact_parts(weights: Mapping[str, float]) -> dict[str, int]:
    """Weights as whole parts of their sum, without any rounding."""
    if any(not 0 < w < float("inf") for w in weights.values()):
        raise ValueError("weights must be positive")
    shares = {n: Fraction(w) for n, w in weights.items()}
    unit = lcm(*(x.denominator for x in shares.values()))
    parts = {n: int(x * unit) for n, x in shares.items()}
    common = gcd(*parts.values())
    return {n: p // common for n, p in parts.items()}


def placed(parts: Sequence[int], t: int) -> list[int]:
    """Blocks of each source that are placed before slot ``t``, such that all deadlines on both sides of t can be met.

    A source has floor(t w) blocks before t for certain; of the blocks whose window holds t, as many are placed as
    there are slots left. Blocks due within L slots beyond those that fit into them must be placed (for each L); from the
    ones that this leaves to choose, those with the earliest release are taken, as they crowd the slots before t least.
    Some choice exists, since Pfair schedules do, and this one is as good as any. The work is that of the slots up to
    the last deadline looked at, whatever t is.
    """
    total = sum(parts)
    done = [t * p // total for p in parts]
    left = t - sum(done)
    cut = {k for k, p in enumerate(parts) if t * p % total}
    due = [(-(-(done[k] + 1) * total // p), k, done[k]) for k, p in enumerate(parts)]
    heapq.heapify(due)
    waiting: list[tuple[int, int]] = []
    passed, unseen = 0, len(cut)
    while left:
        if unseen:
            until = due[0][0]
            while due[0][0] == until:
                _, k, j = due[0]
                heapq.heapreplace(due, (-(-(j + 2) * total // parts[k]), k, j + 1))
                passed += 1
                if k in cut:
                    cut.discard(k)
                    unseen -= 1
                    heapq.heappush(waiting, (done[k] * total // parts[k], k))
        else:
            until = t - left  # all are known: what is left is free to choose
        while passed > until - t and left and waiting:
            done[heapq.heappop(waiting)[1]] += 1
            left, passed = left - 1, passed - 1
    return done


def walk(parts: Sequence[int], slots: int, first: int = 0) -> Iterator[tuple[int, int]]:
    """(source number, block number) of ``slots`` slots from ``first`` on, earliest deadline first; ties go to the first source.

    Blocks that ``placed`` has before ``first`` or after the last slot are left to the ranges there.
    """
    total, last = sum(parts), first + slots
    done, end = placed(parts, first), placed(parts, last)
    ready: list[tuple[int, int]] = []
    released: dict[int, list[int]] = {}

    def wait(k: int, earliest: int) -> None:
        if done[k] < end[k]:
            released.setdefault(max(earliest, done[k] * total // parts[k]), []).append(k)

    for k in range(len(parts)):
        wait(k, first)
    for t in range(first, last):
        for k in released.pop(t, ()):
            heapq.heappush(ready, (min(last, -(-(done[k] + 1) * total // parts[k])), k))
        _, k = heapq.heappop(ready)
        yield k, done[k]
        done[k] += 1
        wait(k, t + 1)


def period(parts: list[int]) -> list[tuple[int, int]]:
    """The walk over as many slots as there are parts."""
    return list(walk(parts, sum(parts)))


def range_slots(parts: Sequence[int], slots: int) -> int:
    """Slots of one range: long enough that finding its ends costs no more than walking it twice."""
    return max(TASK_SLOTS, -(-slots // MAX_TASKS), min(slots, -(-sum(parts) // min(parts))))


def blocks(docs: DataFrame, sizes: Mapping[str, int], block_docs: int, group_docs: int) -> DataFrame:
    """(doc_id, source, block, place): rows of a source in hash order, cut into blocks.

    The hash range of a source is cut into groups of about ``group_docs`` rows; a row's rank is the
    rows of earlier groups plus its rank in its own, so that no task orders a whole source.
    """
    groups = F.create_map(*(F.lit(x) for n, size in sizes.items() for x in (n, max(1, -(-size // group_docs)))))
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("source")).withColumn("h", F.xxhash64("doc_id", F.lit(2)))
    share = F.pmod(F.col("h"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    rows = rows.withColumn("g", F.floor(share * groups[F.col("source")])).withColumn("share", share)
    before = Window.partitionBy("source").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("source", "g").count().select("source", "g", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    ranked = rows.withColumn("r", F.row_number().over(Window.partitionBy("source", "g").orderBy("share", "h", "doc_id")) - 1)
    rank = F.col("before") + F.col("r")
    return ranked.join(offsets, ["source", "g"]).select(
        "doc_id", "source", F.floor(rank / block_docs).alias("block"), (rank % block_docs).cast("int").alias("place"))


def mix(docs: DataFrame, weights: Mapping[str, float] | None = None, block_docs: int = BLOCK_DOCS,
        group_docs: int = GROUP_DOCS, max_sources: int = MAX_SOURCES) -> DataFrame:
    """One row per placed document: slot, place (in the block), source, block, epoch, doc_id.

    Ordered by (slot, place), any prefix of whole slots holds each source's share to less than one block
    of its weight, however long the schedule is. ``weights`` name every source of ``docs`` (null counts as ""); others are ignored. Without weights a source counts
    by its size to the power ``POWER``. A last block may be shorter; repeated rows are placed each; rows
    with a null doc_id too. Other columns are ignored; no documents, no rows.
    """
    spark = docs.sparkSession
    counted = docs.groupBy(F.coalesce("source", F.lit("")).alias("source")).count().limit(max_sources + 1).collect()
    if len(counted) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    sizes = {r["source"]: r["count"] for r in sorted(counted)}
    schema = "slot long, source string, block long, epoch long"
    if not sizes:
        scheduled = spark.createDataFrame([], schema)
        return scheduled.join(blocks(docs, {"": 0}, block_docs, group_docs), ["source", "block"]).select("slot", "place", "source", "block", "epoch", "doc_id")
    if weights is not None and (missing := set(sizes) - set(weights)):
        raise ValueError(f"no weight for {sorted(missing)[:5]}")
    parts_of = exact_parts({n: weights[n] if weights is not None else sizes[n] ** POWER for n in sizes})
    names, parts = list(sizes), [parts_of[n] for n in sizes]
    counts = [-(-sizes[n] // block_docs) for n in names]
    total = sum(parts)
    slots = max(-(-c * total // p) for c, p in zip(counts, parts, strict=True))
    size = range_slots(parts, slots)
    ranges = spark.range(0, slots, size, -(-slots // size))
    count, name = np.array(counts), np.array(names, dtype=object)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for first in (int(x) for pdf in batches for x in pdf["id"]):
            turns = walk(parts, min(size, slots - first), first)
            for at in range(first, min(first + size, slots), TASK_SLOTS):
                source, block = np.array(list(islice(turns, TASK_SLOTS)), dtype=np.int64).T
                yield pd.DataFrame({"slot": np.arange(len(source)) + at, "source": name[source], "block": block % count[source], "epoch": block // count[source]})

    scheduled = ranges.mapInPandas(run, schema)
    return blocks(docs, sizes, block_docs, group_docs).join(scheduled, ["source", "block"]).select("slot", "place", "source", "block", "epoch", "doc_id")
