"""Suffix-array dedup on bytes: every byte of a string of ``length`` bytes that starts twice is removed.

The suffix array is sparse. Suffixes start at content-chosen grams (``blocks``), one at least in every
window, and carry what stands left and right of the gram in the windows that belong to it. Grams that
occur once and blocks whose whole content recurs are settled by counting. The rest, one representative per
content, is range-partitioned by its leading bytes with sampled splitters, cut to the bytes that tell two
samples apart, so that a very common gram spreads over many buckets. A bucket sorts its suffixes by multikey quicksort on eight-byte
characters and takes the common prefix of neighbours: windows with r bytes right of the gram are equal if
they lie in one run of common prefixes of at least r and have equal bytes left of it. Runs that touch a bucket's edge and
share r bytes with the splitter there may go on in the next bucket; their windows are compared across buckets by hashes.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lurewatch.llm import blocks as B
from lurewatch.llm import text as T
from lurewatch.llm.store import stored

LENGTH = 200
GRAM = 48
#: Suffixes that one bucket is meant to hold.
BUCKET_ROWS = 8_000
#: Sampled suffixes for each bucket.
SAMPLES = 24
_SUFFIX = "suffix binary, left binary, gram long, span int, n long, doc_id long, at long"


def _suffixes(texts: DataFrame, length: int) -> DataFrame:
    """(doc_id, packed, blocks) -> the suffix at each block's gram and what stands left of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bounds, (at, shape, gram, n) = B.list_column(batch.column(2), "at", "shape", "gram", "n")
            bodies = [B.unpack(p.as_py()) for p in batch.column(1)]
            doc = np.repeat(np.arange(len(bodies)), np.diff(bounds))
            ids = batch.column(0).to_numpy(zero_copy_only=False)[doc]
            off, span = shape >> 16, shape & 0xFFFF
            for i in range(0, len(at), 10_000):
                part = slice(i, i + 10_000)
                cuts = list(zip(doc[part].tolist(), at[part].tolist(), off[part].tolist(), span[part].tolist(), strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([bodies[d][a + o : a + s + length] for d, a, o, s in cuts], pa.binary()),
                     pa.array([bodies[d][a : a + o] for d, a, o, s in cuts], pa.binary()),
                     pa.array(gram[part]), pa.array(span[part].astype(np.int32)), pa.array(n[part]), pa.array(ids[part]), pa.array(at[part])],
                    ["suffix", "left", "gram", "span", "n", "doc_id", "at"])

    return texts.select("doc_id", "packed", "blocks").mapInArrow(run, _SUFFIX)


def _matrix(values: pa.Array, width: int, right: bool = False) -> np.ndarray:
    """Byte strings as rows padded with 0; bytes are raised by one (UTF-8 has no 0xFF), so the end sorts first."""
    data, offsets = values.buffers()[2], np.frombuffer(values.buffers()[1], dtype=np.int32)[values.offset : values.offset + len(values) + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    sizes = np.diff(offsets)
    out = np.zeros((len(values), width), dtype=np.uint8)
    row = np.repeat(np.arange(len(values)), sizes)
    col = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[row, (width - 1 - (sizes[row] - 1 - col)) if right else col] = data[offsets[0] : offsets[-1]] + np.uint8(1)
    return out


def multikey_order(keys: np.ndarray) -> np.ndarray:
    """Row order of a matrix of big-endian eight-byte characters.

    Multikey quicksort: rows equal so far form a group; each step sorts the rows of open groups by their
    next character and splits the groups, so settled rows are never looked at again.
    """
    order = np.arange(len(keys))
    group = np.zeros(len(keys), dtype=np.int64)
    open_rows = np.arange(len(keys)) if len(keys) > 1 else np.zeros(0, dtype=np.int64)
    for depth in range(keys.shape[1]):
        if not len(open_rows):
            break
        char = keys[order[open_rows], depth]
        turn = np.lexsort((char, group[open_rows]))
        order[open_rows] = order[open_rows][turn]
        char = char[turn]
        new = np.ones(len(open_rows), dtype=bool)
        new[1:] = (char[1:] != char[:-1]) | (group[open_rows][1:] != group[open_rows][:-1])
        heads = np.flatnonzero(new)
        sizes = np.diff(np.append(heads, len(new)))
        group[open_rows] = np.repeat(open_rows[heads], sizes)
        open_rows = open_rows[np.repeat(sizes > 1, sizes)]
    return order


def splitters(suffixes: DataFrame, buckets: int, rows: int, samples: int = SAMPLES) -> list[bytes]:
    """Boundaries of ``buckets`` ranges of (suffix, left), from a sample of about ``samples`` suffixes for each.

    A boundary is the shortest prefix of a sampled key that is larger than the sample before it.
    """
    if buckets < 2:
        return []
    share = min(1.0, samples * buckets / rows)
    some = suffixes.where(F.pmod(F.xxhash64("doc_id", "at", "gram"), F.lit(1 << 30)) < int(share * (1 << 30)))
    keys = sorted(set(some.select(F.concat("suffix", F.lit(b"\0"), "left").alias("key")).toArrow().column("key").to_pylist()))
    out = []
    for i in sorted({len(keys) * b // buckets for b in range(1, buckets)} - {0}):
        common = next((k for k, (a, b) in enumerate(zip(keys[i - 1], keys[i], strict=False)) if a != b), len(keys[i - 1]))
        out.append(keys[i][: common + 1])
    return out


def _common(a: bytes, b: bytes) -> int:
    return next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def _dealt(suffixes: DataFrame, bounds: list[bytes]) -> DataFrame:
    """``suffixes`` with the number of their range, dealt out by it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = [bisect_right(bounds, s + b"\0" + l) for s, l in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield batch.append_column("bucket", pa.array(numbers, pa.int32()))

    return suffixes.mapInArrow(run, _SUFFIX + ", bucket int").repartition(len(bounds) + 1, "bucket")


def _bucket(table: pa.Table, length: int, below: bytes, above: bytes):
    """Repeated windows of a bucket's own rows (n = 1), and each window, once, whose run touches an edge.

    A window at an edge comes with its count in the bucket; if that is 1, the other buckets decide about it.
    """
    count = table.num_rows
    column = {c: table.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("gram", "span", "n", "doc_id", "at")}
    suffix, left = (table.column(c).combine_chunks() for c in ("suffix", "left"))
    sizes, lefts = (np.asarray(pa.compute.binary_length(x)).astype(np.int64) for x in (suffix, left))
    width = -(-int(sizes.max()) // 8) * 8
    body = _matrix(suffix, width)
    order = multikey_order(body.view(">u8"))
    body, sizes, lefts = body[order], sizes[order], lefts[order]
    gram, span, n, doc, at = (column[c][order] for c in ("gram", "span", "n", "doc_id", "at"))
    text = lambda i: (body[i, : sizes[i]] - np.uint8(1)).tobytes()
    first_edge, last_edge = _common(text(0), below), _common(text(count - 1), above)
    common = np.zeros(count, dtype=np.int64)
    for i in range(1, count, 8192):
        j = min(i + 8192, count)
        differ = body[i:j] != body[i - 1 : j - 1]
        common[i:j] = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    before = _matrix(left, max(1, int(lefts.max())), right=True)[order]
    sums = np.cumsum(T.BYTE_UNITS[body] * T.powers(width)[0], axis=1, dtype=np.uint64)
    hashes = np.zeros(count, dtype=np.uint64)
    hit = np.zeros((count, int(span.max()) + 1), dtype=bool)
    edges = []
    for l in range(int(lefts.max()) + 1):
        if l:
            hashes = hashes * np.uint64(T.BASE) + T.BYTE_UNITS[before[:, -l]]
        r = length - l
        rows = np.flatnonzero((lefts >= l) & (lefts - l <= span) & (sizes >= r))
        if not len(rows):
            continue
        run = np.cumsum(common < r)
        key = T.mix(hashes[rows] + T.mix(run[rows].astype(np.uint64)))
        turn = np.argsort(key, kind="stable")
        heads = np.flatnonzero(np.append(True, key[turn][1:] != key[turn][:-1]))
        total = np.add.reduceat(n[rows][turn], heads)
        again = np.repeat(total > 1, np.diff(np.append(heads, len(turn))))
        found = rows[turn][again]
        hit[found, (lefts[found] - l)] = True
        one = rows[turn][heads]  # one row of each window that the bucket knows
        at_edge = (run[one] == run[0]) & (r <= first_edge) | (run[one] == run[-1]) & (r <= last_edge)
        if at_edge.any():
            edge, total = one[at_edge], total[at_edge]
            window = T.mix(hashes[edge] + T.mix(sums[edge, r - 1] + np.uint64(l)))
            edges.append((gram[edge], window, total, doc[edge], at[edge] + lefts[edge] - l))
    hit[n > 1] = False
    first = hit & ~np.pad(hit, ((0, 0), (1, 0)))[:, :-1]
    last = hit & ~np.pad(hit, ((0, 0), (0, 1)))[:, 1:]
    row, lo = np.nonzero(first)
    hi = np.nonzero(last)[1]
    return (doc[row], at[row] + lo, at[row] + hi + length), edges


def _compare(suffixes: DataFrame, length: int, bounds: list[bytes]) -> DataFrame:
    """Rows (kind 0: doc_id, lo, hi removed) and (kind 1: a window at a bucket's edge)."""
    schema = "kind int, doc_id long, lo long, hi long, gram long, hash long, n long"

    def rows(kind, doc, lo, hi, gram, value, n):
        size = len(doc)
        fill = lambda x: pa.array(x) if x is not None else pa.nulls(size, pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(size, kind, dtype=np.int32)), fill(doc), fill(lo), fill(hi), fill(gram), fill(value), fill(n)],
            ["kind", "doc_id", "lo", "hi", "gram", "hash", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = list(batches)  # a few range buckets, bounded by their number
        table = pa.Table.from_batches(batches) if batches else None
        for number in np.unique(table.column("bucket").to_numpy()) if table is not None else ():
            part = table.filter(pa.compute.equal(table.column("bucket"), int(number)))
            below, above = (bounds[number - 1] if number else b""), (bounds[number] if number < len(bounds) else b"")
            (doc, lo, hi), edges = _bucket(part, length, below, above)
            yield rows(0, doc, lo, hi, None, None, None)
            for gram, window, n, d, a in edges:
                yield rows(1, d, a, None, gram, T.as_long(window), n)

    return suffixes.mapInArrow(run, schema)


def removed_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(doc_id, lo, hi): bytes [lo, hi) that strings occurring twice cover; spans may overlap."""
    found = B.anchors(docs.where("doc_id is not null"), B.byte_units, length, gram)
    # grouped counts are stored before they are joined: a join of two plain exchanges can split a hot key
    repeated = stored(found.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram"), "repeated-grams")
    rows = stored(found.join(repeated, "gram"), "byte-blocks")
    contexts = stored(rows.groupBy("gram", "sig").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "at", "shape")).alias("one")), "contexts")
    span = F.col("shape").bitwiseAND(0xFFFF)
    many = contexts.where("n > 1").select("gram", "sig")
    whole = rows.join(many, ["gram", "sig"]).select("doc_id", F.col("at").alias("lo"), (F.col("at") + span + length).alias("hi"))
    mixed = stored(contexts.groupBy("gram").agg(F.count("*").alias("kinds"), F.sum(F.expr("int(n = 1)")).alias("singles")).where("kinds > 1 and singles > 0").select("gram"), "mixed-grams")
    open_blocks = contexts.join(mixed, "gram").select("one.*", "gram", "n").groupBy("doc_id").agg(
        F.collect_list(F.struct("at", "shape", "gram", "n")).alias("blocks"))
    suffixes = stored(_suffixes(B.texts_with(docs, open_blocks).dropDuplicates(["doc_id"]), length), "suffixes")
    count = suffixes.count()
    bounds = splitters(suffixes, -(-count // bucket_rows), count)
    compared = stored(_compare(_dealt(suffixes, bounds), length, bounds), "compared")
    edges = compared.where("kind = 1")
    across = stored(edges.groupBy("gram", "hash").agg(F.sum("n").alias("total"), F.min("n").alias("least")).where("total > 1 and least = 1").select("gram", "hash"), "across")
    edge = edges.where("n = 1").join(across, ["gram", "hash"]).select("doc_id", "lo", (F.col("lo") + length).alias("hi"))
    return whole.unionByName(compared.where("kind = 0").select("doc_id", "lo", "hi")).unionByName(edge)


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, bucket_rows: int = BUCKET_ROWS, as_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept (remaining bytes).

    With ``as_text`` the remaining bytes come as a string, without the parts of characters that a cut has halved.

    Texts are UTF-8 bytes; null counts as empty and keeps nothing; every copy of a repeated string goes, also
    within one document. doc_id is the key: rows that repeat a doc_id count as repeated texts. A row
    without doc_id is returned whole. Other columns are ignored; no documents, no rows.
    """
    texts = B.texts_with(docs, B.pack_spans(removed_spans(docs, length, gram, bucket_rows)), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bounds, (lo, hi) = B.list_column(batch.column(2), "lo", "hi")
            rows = []
            for i, packed in enumerate(batch.column(1)):
                body = B.unpack(packed.as_py())
                if bounds[i] == bounds[i + 1]:
                    rows.append((len(body), 0, 0, body))
                    continue
                mask = B.covered(len(body), lo[bounds[i] : bounds[i + 1]], hi[bounds[i] : bounds[i + 1]])
                spans = int(np.count_nonzero(mask[1:] & ~mask[:-1])) + int(mask[0])
                rows.append((len(body), int(mask.sum()), spans, np.frombuffer(body, dtype=np.uint8)[~mask].tobytes()))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]),
                 pa.array([k.decode("utf-8", "ignore") for k in cols[3]], pa.string()) if as_text else pa.array(cols[3], pa.binary())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return texts.select("doc_id", "packed", "spans").mapInArrow(
        run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept " + ("string" if as_text else "binary"))
