"""SimHash near-dedup: fingerprints, pigeonhole blocks, exact Hamming check, components.

A document's fingerprint has a bit set where over half of its shingles' XXH64 values have it.
Equal fingerprints collapse first. Two 64-bit fingerprints that differ in at most three bits agree in
at least three of six blocks, so each fingerprint joins 20 tables keyed by three blocks each. A key with
more than ``split_over`` fingerprints is split again in the same way over its remaining bits; what then
meets shares three and a half to six blocks, which bounds a group by the values of the bits left open.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lurewatch.llm.components import components
from lurewatch.session import cut_lineage

SEED = 42
#: Bits [start, stop) of the six blocks.
BLOCKS = [(0, 11), (11, 22), (22, 33), (33, 44), (44, 54), (54, 64)]
#: Fingerprints per key that one task compares at most before the key is split again.
SPLIT_OVER = 4096


def fingerprint(text: str | None, shingle_words: int = 3) -> int:
    """The fingerprint of one text; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n, step = max(1, len(words) - shingle_words + 1), 1 << 16
    ones, digest = np.zeros(64, dtype=np.int64), xxhash.xxh64_intdigest
    for i in range(0, n, step):
        part = words[i : min(i + step, n) + shingle_words - 1]
        grams = zip(*(part[k:] for k in range(shingle_words)), strict=False) if n > 1 or len(words) >= shingle_words else [part]
        hashes = np.array([digest(b" ".join(g), SEED) for g in grams], dtype=np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle_words: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed 64-bit number, one row per row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.fromiter((fingerprint(t.as_py(), shingle_words) for t in batch.column(1)), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def _mask(blocks: tuple[int, ...]) -> int:
    bits = sum(((1 << (b - a)) - 1) << a for a, b in (BLOCKS[i] for i in blocks))
    return bits - (1 << 64) if bits >> 63 else bits


def _spread(bits: list[int]) -> list[int]:
    """Masks of three of six blocks of the given bit positions."""
    parts = [bits[i * len(bits) // 6 : (i + 1) * len(bits) // 6] for i in range(6)]
    out = []
    for some in combinations(range(6), 3):
        m = sum(1 << b for i in some for b in parts[i])
        out.append(m - (1 << 64) if m >> 63 else m)
    return out


def _tables(fps: DataFrame) -> DataFrame:
    """Each fingerprint once per choice of three blocks: (t, key, fp)."""
    masks = [_mask(c) for c in combinations(range(6), 3)]
    keys = F.array(*(F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(masks)))
    return fps.select("fp", F.explode(keys).alias("k")).select("k.t", "k.key", "fp")


def _split(rows: DataFrame) -> DataFrame:
    """Rows of hot keys, once per choice of three blocks of the bits that the key leaves open."""
    out = []
    for t, c in enumerate(combinations(range(6), 3)):
        fixed = {b for i in c for b in range(*BLOCKS[i])}
        open_masks = _spread([b for b in range(64) if b not in fixed])
        out.append(F.when(F.col("t") == t, F.array(*(F.struct(
            F.lit(20 + 20 * t + s).alias("t"), F.col("key").bitwiseOR(F.col("fp").bitwiseAND(F.lit(m))).alias("key"))
            for s, m in enumerate(open_masks)))))
    return rows.select("fp", F.explode(F.coalesce(*out)).alias("k")).select("k.t", "k.key", "fp")


def _forest(fps: np.ndarray, distance: int, rows: int = 512) -> list[tuple[int, int]]:
    """A spanning forest of the links within one bucket."""
    n = len(fps)
    parent = np.arange(n)
    root = parent.tolist()

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    links = []
    for i in range(0, n, rows):
        near = np.bitwise_count(fps[i : i + rows, None] ^ fps[None, i:]) <= distance
        for a, b in zip(*np.nonzero(np.triu(near, 1)), strict=True):
            x, y = find(i + int(a)), find(i + int(b))
            if x != y:
                root[max(x, y)] = min(x, y)
                links.append((int(fps[i + a]), int(fps[i + b])))
    return links


def links(fps: DataFrame, distance: int = 3, split_over: int = SPLIT_OVER) -> DataFrame:
    """Distinct fingerprints -> links (u, v) that connect all that differ in at most ``distance`` (<= 3) bits."""
    if not 0 <= distance <= 3:
        raise ValueError("six blocks find distances up to 3")
    rows = _tables(fps)
    sizes = rows.groupBy("t", "key").agg(F.count("*").alias("size")).where("size > 1")
    sizes = cut_lineage(sizes)
    small = rows.join(sizes.where(F.col("size") <= split_over), ["t", "key"])
    hot = _split(rows.join(sizes.where(F.col("size") > split_over), ["t", "key"]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [e for fp in pdf["fps"] for e in _forest(np.sort(np.asarray(fp, dtype=np.int64)).view(np.uint64), distance)]
            yield pd.DataFrame(np.array(found, dtype=np.uint64).reshape(-1, 2).view(np.int64), columns=["u", "v"])

    buckets = small.select("t", "key", "fp").unionByName(hot).groupBy("t", "key").agg(F.collect_list("fp").alias("fps"))
    return buckets.where(F.size("fps") > 1).select("fps").mapInPandas(run, "u long, v long").distinct()


def near_duplicates(docs: DataFrame, distance: int = 3, shingle_words: int = 3, split_over: int = SPLIT_OVER) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest linked doc_id), n_copies.

    Null and empty texts have fingerprint zero and link like any other; rows with the same doc_id count
    as one document each; other columns are ignored; no documents, no rows.
    """
    prints = cut_lineage(fingerprints(docs, shingle_words))
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n_copies"))
    joined = components(links(classes.select("fp"), distance, split_over))
    rooted = classes.join(joined, classes.fp == joined.node, "left").select("fp", "first", "n_copies", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    by_class = rooted.join(smallest, "root").select("fp", "n_copies", "component_id")
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return prints.join(by_class, "fp").select("doc_id", digits.alias("fingerprint"), "component_id", "n_copies")
