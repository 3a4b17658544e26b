"""Merkle manifest of a table of documents: one tree per language, one tree over their roots, a proof for every row.

1. A row's leaf is hashed where the row is read; only (language, doc_id, digests) goes on, in a table of its own.
2. Leaves are range-partitioned by (language, doc_id) and sorted, so that a large language is many ranges; a leaf's position
   in its language is its place in the range plus the sizes of the ranges before.
3. Positions cut each tree into superblocks of 8**4 consecutive nodes. A superblock is folded to one node by itself; the
   nodes of all superblocks are the next layer, until every tree is one node. Layers shrink by 4096, so three of them hold
   10**11 leaves. The languages' roots form a last tree in the same way.
4. On the way down each superblock of a layer is cogrouped with the one row of the layer above that it needs: the sibling
   digests outside of it, up to the root. The group folds its nodes once more, joins the inner siblings with the outer
   ones, and hands a path to every node; at the leaves it folds the leaf (tampered or not) along the path to the root.

No task sees more than one superblock and one path.
"""

from __future__ import annotations

from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lurewatch.llm.store import stored

#: Nodes that are hashed together, and levels of a superblock.
ARITY, LEVELS = 8, 4
#: Leaves of one range of the sort.
RANGE_LEAVES = 1 << 17
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _hash(data: bytes) -> bytes:
    return sha256(data).hexdigest().encode()


def leaf(fields: dict[str, Column]) -> Column:
    """Digest (32 bytes) of the fields in order, each ``-`` if null, else its length in bytes, ``:`` and its value."""
    texts = (F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string"))) for c in fields.values())
    return F.unhex(F.sha2(F.concat(*texts), 256))


def _height(nodes: int) -> int:
    levels = 0
    while nodes > 1:
        nodes, levels = -(-nodes // ARITY), levels + 1
    return levels


def fold(digests: list[bytes], levels: int) -> list[list[bytes]]:
    """The nodes of each level, those given first."""
    out = [digests]
    for _ in range(levels):
        out.append([_hash(b"".join(out[-1][i : i + ARITY])) for i in range(0, len(out[-1]), ARITY)])
    return out


def paths(levels: list[list[bytes]], outer: list[tuple[bytes, bytes]]) -> list[list[tuple[bytes, bytes]]]:
    """For each given node, the siblings before and after it on every level up to the root."""
    above = [outer] * len(levels[-1])
    for nodes in reversed(levels[:-1]):
        below = []
        for i in range(0, len(nodes), ARITY):
            run = b"".join(nodes[i : i + ARITY])
            below += [[(run[: 64 * k], run[64 * (k + 1) :]), *above[i // ARITY]] for k in range(len(run) // 64)]
        above = below
    return above


def _packed(path: list[tuple[bytes, bytes]]) -> str:
    return b"/".join(b"%b,%b" % x for x in path).decode()


def _unpacked(path: str) -> list[tuple[bytes, bytes]]:
    return [tuple(x.split(b",")) for x in path.encode().split(b"/")] if path else []


def _positions(rows: DataFrame, order: list[str], label: str) -> DataFrame:
    """``rows`` with pos (from 0) and total within ``tree``, by ``order``."""
    dealt = stored(rows.withColumn("dealt", F.pmod(F.monotonically_increasing_id(), F.lit(1 << 20))), label)  # parts rows that are equal in all else
    by = ["tree", *order, "dealt"]
    ranges = max(1, -(-dealt.count() // RANGE_LEAVES))
    sorted_rows = dealt.repartitionByRange(ranges, *by).sortWithinPartitions(*by).drop("dealt").withColumn("place", F.monotonically_increasing_id())
    sorted_rows = stored(sorted_rows, f"{label}-sorted").withColumn("range", F.shiftright("place", 33))
    sizes = sorted_rows.groupBy("tree", "range").agg(F.min("place").alias("first"), F.count("*").alias("rows"))
    whole = Window.partitionBy("tree")
    sizes = sizes.select("tree", "range", (F.sum("rows").over(whole.orderBy("range")) - F.col("rows") - F.col("first")).alias("shift"), F.sum("rows").over(whole).alias("total"))
    return sorted_rows.join(sizes, ["tree", "range"]).withColumn("pos", F.col("place") + F.col("shift")).drop("range", "place", "shift")


def _superblock(levels: int) -> Column:
    return F.expr(f"pos div {ARITY ** levels}").alias("block")


def _above(nodes: DataFrame, levels: int) -> DataFrame:
    """The next layer: every superblock of ``nodes`` (tree, pos, digest, total) folded to one node."""

    def reduce(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        total = int(rows["total"].iloc[0])
        digests = [bytes(x).hex().encode() for x in rows.sort_values("pos")["digest"]]
        (top,) = fold(digests, min(levels, _height(total)))[-1]
        return pd.DataFrame([{"tree": key[0], "pos": key[1], "digest": bytes.fromhex(top.decode()), "total": -(-total // ARITY ** levels)}])

    return nodes.select("tree", "pos", "digest", "total").groupBy("tree", _superblock(levels)).applyInPandas(reduce, "tree string, pos long, digest binary, total long")


def _layers(nodes: DataFrame, levels: int) -> list[DataFrame]:
    """Layers of all trees; in the last one every tree is a single node."""
    out = [nodes]
    while (out[-1].agg(F.max("total")).first()[0] or 1) > 1:
        out.append(stored(_above(out[-1], levels), "layer"))
    return out


def _exchange(nodes: DataFrame, outer: DataFrame, levels: int, finish, schema: str) -> DataFrame:
    """Cogroups each superblock with the path of the node that it folds to."""

    def join(rows: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return finish(rows, [], None)
        rows = rows.sort_values("pos")
        inner = fold([bytes(x).hex().encode() for x in rows["digest"]], min(levels, _height(int(rows["total"].iloc[0]))))
        return finish(rows, paths(inner, _unpacked(above["path"].iloc[0])), above.iloc[0])

    left = nodes.withColumn("block", _superblock(levels)).groupBy("tree", "block")
    return left.cogroup(outer.withColumnRenamed("pos", "block").groupBy("tree", "block")).applyInPandas(join, schema)


def _handed_down(layers: list[DataFrame], outer: DataFrame, levels: int) -> DataFrame:
    """Paths of the nodes of the lowest of ``layers``; ``outer`` are those of the highest."""

    def finish(rows: pd.DataFrame, found: list, above: pd.Series | None) -> pd.DataFrame:
        return pd.DataFrame({"tree": rows["tree"], "pos": rows["pos"], "path": [_packed(p) for p in found],
                             "subroot": above["subroot"] if len(rows) else None, "root": above["root"] if len(rows) else None})

    for nodes in reversed(layers[:-1]):
        outer = stored(_exchange(nodes, outer, levels, finish, "tree string, pos long, path string, subroot string, root string"), "paths")
    return outer


def _proven(leaves: DataFrame, outer: DataFrame, levels: int) -> DataFrame:
    def finish(rows: pd.DataFrame, found: list, above: pd.Series | None) -> pd.DataFrame:
        proofs, folded = [], []
        for original, tampered, path in zip(rows["digest"], rows["tampered"], found, strict=True):
            at = bytes(original if tampered is None else tampered).hex().encode()
            for before, after in path:
                at = _hash(before + at + after)
            folded.append(at.decode())
            proofs.append(_hash(b"".join(b + a for b, a in path)).decode())
        root = above["root"] if len(rows) else None
        return pd.DataFrame({
            "doc_id": rows["doc_id"], "named": rows["named"], "leaf": [bytes(x).hex() for x in rows["digest"]], "subroot": above["subroot"] if len(rows) else None,
            "root": root, "proof_sha256": proofs, "folded_root": folded, "verified": [x == root for x in folded]})

    named = leaves.withColumn("named", F.col("doc_id").isNotNull()).withColumn("doc_id", F.coalesce("doc_id", F.lit(0)))
    made = _exchange(named, outer, levels, finish, "doc_id long, named boolean, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    return made.withColumn("doc_id", F.when(F.col("named"), F.col("doc_id"))).drop("named")


def lower_cased_third(fields: dict[str, Column]) -> tuple[Column, dict[str, Column]]:
    """Rows whose doc_id has a crc32 divisible by three, with A-Z of their text in lower case."""
    return F.crc32(F.col("doc_id").cast("string")) % 3 == 0, fields | {"text": F.translate("text", _UPPER, _LOWER)}


def manifest(docs: DataFrame, tamper=lower_cased_third, levels: int = LEVELS) -> DataFrame:
    """One row per row of ``docs``: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    ``tamper`` maps the fields to (which rows, their fields after), to test what the proofs notice; ``None`` leaves all as is.
    Rows without lang form a tree of their own, the first. Rows without doc_id come first in their tree and are not tampered
    with; rows with equal doc_id follow by digest. Null and empty texts are leaves like any other and differ. Other columns
    are ignored. Without rows there is no root and the result is empty.
    """
    fields = {f: F.col(f) for f in FIELDS}
    chosen, after = tamper(fields) if tamper else (F.lit(False), fields)
    leaves = docs.select(
        F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("")).alias("tree"), F.col("doc_id").cast("long"),
        leaf(fields).alias("digest"), F.when(chosen, leaf(after)).alias("tampered"))
    leaves = stored(_positions(leaves, ["doc_id", "digest"], "leaves"), "placed")
    by_language = _layers(leaves, levels)
    subroots = by_language[-1].select(F.lit("").alias("tree"), F.col("tree").alias("language"), "digest")
    subroots = stored(_positions(subroots, ["language"], "subroots"), "subroots-placed")
    over_languages = _layers(subroots, levels)
    top = over_languages[-1].select("tree", "pos", F.lit("").alias("path"), F.lit(None).cast("string").alias("subroot"), F.lower(F.hex("digest")).alias("root"))
    handed = _handed_down(over_languages, top, levels)
    languages = subroots.join(handed.drop("subroot"), ["tree", "pos"]).select(
        F.col("language").alias("tree"), F.lit(0).cast("long").alias("pos"), "path", F.lower(F.hex("digest")).alias("subroot"), "root")
    if len(by_language) == 1:  # every tree is a lone leaf
        return _proven(leaves, languages, 0)
    return _proven(leaves, _handed_down(by_language[1:], languages, levels), levels)
