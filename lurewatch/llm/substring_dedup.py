"""Substring dedup on words: Rabin-Karp hashes of every fixed-length window, counted in Spark.

A window is removed if its words also start in a document with a smaller doc_id. Windows are hashed in
blocks first (``blocks``): a block hash that a smaller document has settles all its windows at once, and a
gram that no other document has settles that they stay. Only the windows of blocks that share their gram
with another document but not their content are hashed one by one, and the smallest document per window
hash is a grouped minimum. Removed windows merge into maximal intervals per document.
Keys are pairs of 64-bit hashes (gram and block, gram and window), 128 bits in all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lurewatch.llm import blocks as B
from lurewatch.llm import text as T
from lurewatch.llm.store import stored

WINDOW_WORDS = 50
GRAM_WORDS = 10


def _window_hashes(texts: DataFrame, length: int) -> DataFrame:
    """(doc_id, packed, blocks) -> one row per window of the listed blocks: gram, hash, doc_id, at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bounds, (at, span, gram) = B.list_column(batch.column(2), "at", "span", "gram")
            for i, (doc, packed) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1), strict=True)):
                body = np.frombuffer(B.unpack(packed.as_py()), dtype=np.uint8)
                hashes = T.word_hashes(body, np.array([0, len(body)]))[0]
                mine = slice(bounds[i], bounds[i + 1])
                counts = span[mine].astype(np.int64) + 1
                within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
                first = np.repeat(at[mine], counts) + within
                first, once = np.unique(first, return_index=True)
                window = T.mix(T.slices(T.prefix(hashes), first, first + length))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(gram[mine], counts)[once]), pa.array(T.as_long(window)),
                     pa.array(np.full(len(first), doc, dtype=np.int64)), pa.array(first)], ["gram", "hash", "doc_id", "at"])

    return texts.select("doc_id", "packed", "blocks").mapInArrow(run, "gram long, hash long, doc_id long, at long")


def _keep(texts: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bounds, (lo, hi) = B.list_column(batch.column(2), "lo", "hi")
            rows = []
            for i, packed in enumerate(batch.column(1)):
                words = B.unpack(packed.as_py()).split()
                gone = 0
                if bounds[i] < bounds[i + 1]:
                    mask = B.covered(len(words), lo[bounds[i] : bounds[i + 1]], hi[bounds[i] : bounds[i + 1]])
                    gone = int(mask.sum())
                    spans = int(np.count_nonzero(np.diff(mask.astype(np.int8), prepend=0) == 1))
                    kept = [w for w, m in zip(words, mask.tolist(), strict=True) if not m]
                else:
                    spans, kept = 0, words
                body = b" ".join(kept)
                rows.append((len(words), gone, spans, hashlib.sha256(body).hexdigest(), body))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()),
                 pa.array(cols[3], pa.string()), pa.array(cols[4], pa.binary()).cast(pa.string())],
                ["doc_id", "n_words", "n_removed", "n_spans", "kept_sha256", "kept"])

    return texts.select("doc_id", "packed", "spans").mapInArrow(
        run, "doc_id long, n_words long, n_removed long, n_spans long, kept_sha256 string, kept string")


def remove_repeats(docs: DataFrame, window_words: int = WINDOW_WORDS, gram_words: int = GRAM_WORDS) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, n_spans (maximal intervals), kept_sha256, kept (words joined by a space).

    Words are runs of anything but ASCII white space, unchanged. Null and empty texts have no words and stay
    as they are; of equal texts the one with the smallest doc_id stays whole; repeats within one document stay.
    doc_id is the key: rows that repeat a doc_id must repeat its text and give equal rows. A row without doc_id
    is returned with nothing removed. Other columns are ignored; no documents, no rows.
    """
    found = B.anchors(docs.where("doc_id is not null"), B.word_units, window_words, gram_words)
    # grouped minima are stored before they are joined: a join of two plain exchanges can split a hot key
    shared = stored(found.groupBy("gram").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("gram"), "shared-grams")
    rows = stored(found.join(shared, "gram"), "word-blocks")
    contexts = stored(rows.groupBy("gram", "sig").agg(F.min("doc_id").alias("first")), "word-block-firsts")
    groups = stored(contexts.groupBy("gram").agg(F.min("first").alias("lo"), F.max("first").alias("hi")).where("lo < hi").select("gram", F.lit(True).alias("mixed")), "mixed-grams")
    known = stored(contexts.join(groups, "gram", "left"), "word-contexts")
    span = F.col("shape").bitwiseAND(0xFFFF)
    judged = rows.join(known, ["gram", "sig"])
    whole = judged.where("doc_id > first").select("doc_id", F.col("at").alias("lo"), (F.col("at") + span + window_words).alias("hi"))
    open_blocks = judged.where("doc_id = first and mixed").groupBy("doc_id").agg(
        F.collect_list(F.struct("at", span.alias("span"), "gram")).alias("blocks"))
    windows = stored(_window_hashes(B.texts_with(docs, open_blocks), window_words), "word-windows")
    least = stored(windows.groupBy("gram", "hash").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").drop("last"), "least")
    single = windows.join(least, ["gram", "hash"]).where("doc_id > first").select(
        "doc_id", F.col("at").alias("lo"), (F.col("at") + window_words).alias("hi"))
    return _keep(B.texts_with(docs, B.pack_spans(whole.unionByName(single)), "left"))
