"""Embedding near-dedup: exact threshold pairs by dual traversal of a cover tree.

The points are unit vectors; those of one label form a tree. Equal vectors collapse first. A node with more than
``leaf`` points is cut by pivots among its own points: pivots come from a bounded sample and are kept if they are
farther than half the node's radius from those kept before; each point goes to its nearest pivot, and the true covering
radius of every child is measured. Levels are tables, and one pass of Spark cuts all large nodes of a level.

The dual traversal starts from the pair of each root with itself and walks down level by level, as a join of node pairs
with their children. A pair is pruned if the distance of its centres less both covering radii exceeds the
distance that the threshold allows. What is left are pairs of leaves. The task that gets one walks the leaves' own trees of
halving balls in the same way and compares what is left in blocks, in double precision. It returns
link counts per point and a spanning forest of the links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lurewatch.llm.components import components
from lurewatch.llm.store import stored

COSINE = 0.98
#: Points of a leaf at most.
LEAF = 4096
#: Pivots of a node at most; points of a node's sample; points that one task assigns to pivots.
PIVOTS, SAMPLE, CHUNK = 64, 512, 8192
MAX_LEVELS = 30
#: Widens the bounds, so that rounding never prunes what the comparison would link.
SLACK = 1e-9
#: Inside a task: balls of at most so many points are compared directly; a ball with more children than this too.
SMALL, FEW = 128, 32


@dataclass
class Ball:
    members: np.ndarray
    centre: np.ndarray
    radius: float
    children: list[Ball] = field(default_factory=list)


def ball_tree(x: np.ndarray, members: np.ndarray) -> Ball:
    """Nested balls of halving radii over rows of x; a ball that would fall into many stays whole."""
    centre = x[members[0]]
    away = np.sqrt(np.square(x[members] - centre).sum(axis=1))
    top = Ball(members, centre, float(away.max()))
    if len(members) <= SMALL or top.radius <= SLACK:
        return top
    rest, parts = members, []
    while len(rest):
        if len(parts) == FEW:
            return top
        near = np.sqrt(np.square(x[rest] - x[rest[0]]).sum(axis=1)) <= top.radius / 2
        parts.append(rest[near])
        rest = rest[~near]
    top.children = [ball_tree(x, p) for p in parts]
    return top


def linked_blocks(x: np.ndarray, y: np.ndarray, cosine: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows of x, rows of y) of linked pairs; with ``same``, each unordered pair of different rows once."""
    reach = np.sqrt(max(0.0, 2 - 2 * cosine)) + SLACK
    a = ball_tree(x, np.arange(len(x)))
    todo = [(a, a if same else ball_tree(y, np.arange(len(y))))]
    while todo:
        p, q = todo.pop()
        if p is not q and np.sqrt(np.square(p.centre - q.centre).sum()) - p.radius - q.radius > reach:
            continue
        if p is q and p.children:
            todo += [(c, d) for i, c in enumerate(p.children) for d in p.children[i:]]
        elif p.children and (p.radius >= q.radius or not q.children):
            todo += [(c, q) for c in p.children]
        elif q.children:
            todo += [(p, c) for c in q.children]
        else:
            for i in range(0, len(p.members), 512):
                part = p.members[i : i + 512]
                r, c = np.nonzero(x[part] @ y[q.members].T >= cosine)
                r, c = part[r], q.members[c]
                if p is q:
                    r, c = r[r < c], c[r < c]
                yield r, c


def _forest(n: int, pairs: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int]]:
    root, out = list(range(n)), []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for r, c in pairs:
        for a, b in zip(r.tolist(), c.tolist(), strict=True):
            i, j = find(a), find(b)
            if i != j:
                root[max(i, j)] = min(i, j)
                out.append((a, b))
    return out


def compare(a: pd.DataFrame, b: pd.DataFrame | None, cosine: float) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Points (cls, m, v) of one leaf or two -> (class, linked vectors) and forest edges between classes."""
    x = np.stack([np.frombuffer(v) for v in a["v"]])
    y = x if b is None else np.stack([np.frombuffer(v) for v in b["v"]])
    both = pd.concat([a, b]) if b is not None else a
    cls, m, shift = both["cls"].to_numpy(), both["m"].to_numpy(), 0 if b is None else len(a)
    links, pairs = np.zeros(len(both), dtype=np.int64), []
    for r, c in linked_blocks(x, y, cosine, b is None):
        np.add.at(links, r, m[c + shift])
        np.add.at(links, c + shift, m[r])
        pairs.append((r, c + shift))
    some = np.flatnonzero(links)
    return cls[some], links[some], [(int(cls[i]), int(cls[j])) for i, j in _forest(len(both), pairs)]


def _points(vectors: DataFrame) -> DataFrame:
    """Classes of equal usable vectors: (kind, cls, m, v); kind is the label and the number of components, v the unit vector's bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for v in batch.column(3):
                x = np.asarray(v.values.to_numpy(zero_copy_only=False), dtype=np.float64)
                x = x / np.abs(x).max()
                out.append((x / np.sqrt(np.square(x).sum())).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.binary())], ["kind", "cls", "m", "v"])

    kind = F.concat_ws("/", F.col("label").cast("string"), F.size("embedding").cast("string")).alias("kind")
    return vectors.select(kind, "cls", "m", "embedding").mapInArrow(run, "kind string, cls long, m long, v binary")


def _pivots(rows: DataFrame, leaf: int) -> DataFrame:
    """(node, radius, n, cls, v) of large nodes' points -> (node, pivot, pv) by greedy choice from a bounded sample."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["place", "cls"]).head(SAMPLE)
        x = np.stack([np.frombuffer(v) for v in pdf["v"]])
        most, half = int(np.clip(-(-2 * pdf["n"].iloc[0] // leaf), 2, PIVOTS)), pdf["radius"].iloc[0] / 2
        away, kept = np.full(len(x), np.inf), []
        for i in range(len(x)):
            if len(kept) < most and away[i] > half:
                kept.append(i)
                away = np.minimum(away, np.sqrt(np.square(x - x[i]).sum(axis=1)))
        if len(kept) < 2:  # the sample lies in one ball of half the radius
            kept = [0, int(np.sqrt(np.square(x - x[0]).sum(axis=1)).argmax())]
        return pd.DataFrame({"node": key[0], "pivot": pdf["cls"].iloc[kept].to_numpy(), "pv": pdf["v"].iloc[kept].to_numpy()}).drop_duplicates("pivot")

    place = F.pmod(F.xxhash64("cls", "node"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    some = rows.withColumn("place", place).where(F.col("place") * F.col("n") < 2 * SAMPLE)
    return some.groupBy("node").applyInPandas(run, "node string, pivot long, pv binary")


def _assign(rows: DataFrame, pivots: DataFrame) -> DataFrame:
    """Points of large nodes -> (parent, node, cls, m, v, away): each with its nearest pivot, in chunks of a node."""
    chunks = F.greatest(F.lit(1), F.ceil(F.col("n") / CHUNK)).cast("int")
    points = rows.withColumn("salt", F.pmod(F.xxhash64("cls"), chunks).cast("int")).select("node", "salt", "cls", "m", "v")
    heads = pivots.join(rows.groupBy("node").agg(F.max("n").alias("n")), "node").select("node", "pivot", "pv", F.explode(F.sequence(F.lit(0), chunks - 1)).alias("salt"))

    def run(key: tuple, p: pd.DataFrame, h: pd.DataFrame) -> pd.DataFrame:
        if not len(p):
            return pd.DataFrame({"parent": [], "node": [], "cls": [], "m": [], "v": [], "away": []})
        h = h.sort_values("pivot")
        x, c = np.stack([np.frombuffer(v) for v in p["v"]]), np.stack([np.frombuffer(v) for v in h["pv"]])
        d = np.sqrt(np.maximum(np.square(x).sum(axis=1)[:, None] + np.square(c).sum(axis=1) - 2 * x @ c.T, 0))
        best = d.argmin(axis=1)
        exact = np.sqrt(np.square(x - c[best]).sum(axis=1))
        names = (key[0] + ">" + h["pivot"].astype(str)).to_numpy()
        return pd.DataFrame({"parent": key[0], "node": names[best], "cls": p["cls"], "m": p["m"], "v": p["v"], "away": exact})

    return points.groupBy("node", "salt").cogroup(heads.groupBy("node", "salt")).applyInPandas(
        run, "parent string, node string, cls long, m long, v binary, away double")


def tree(points: DataFrame, leaf: int) -> tuple[DataFrame, list[DataFrame]]:
    """(leaf, cls, m, v), and for each level the table (parent, node, radius, centre) of all nodes that partition the points there."""
    first = points.groupBy("kind").agg(F.min(F.struct("cls", "v")).alias("c"))

    def away(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = [float(np.sqrt(np.square(np.frombuffer(v) - np.frombuffer(c)).sum())) for v, c in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(d, pa.float64())], ["parent", "node", "cls", "m", "v", "away"])

    rows = points.join(first, "kind").select(F.col("kind").alias("parent"), F.col("kind").alias("node"), "cls", "m", "v", F.col("c.v").alias("c"))
    rows = stored(rows.mapInArrow(away, "parent string, node string, cls long, m long, v binary, away double"), "cover-level")
    levels, leaves = [], []
    for _ in range(MAX_LEVELS):
        nodes = stored(rows.groupBy("parent", "node").agg(F.count("*").alias("n"), F.max("away").alias("radius"), F.min(F.struct("away", "cls", "v")).alias("c")).select(
            "parent", "node", "n", "radius", F.col("c.v").alias("centre")), "cover-nodes")
        levels.append(nodes)
        large = nodes.where((F.col("n") > leaf) & (F.col("radius") > SLACK)).select("node", "n", "radius")
        leaves.append(rows.join(large.select("node"), "node", "left_anti").select(F.col("node").alias("leaf"), "cls", "m", "v"))
        if large.isEmpty():
            break
        cut = rows.join(large, "node")
        rows = stored(_assign(cut, _pivots(cut, leaf)), "cover-level")
    else:
        leaves.append(rows.select(F.col("node").alias("leaf"), "cls", "m", "v"))
        levels.append(rows.groupBy("parent", "node").agg(F.count("*").alias("n"), F.max("away").alias("radius"), F.min(F.struct("away", "cls", "v")).alias("c")).select(
            "parent", "node", "n", "radius", F.col("c.v").alias("centre")))
    out = leaves[0]
    for more in leaves[1:]:
        out = out.unionByName(more)
    return out, levels


def _unpruned(levels: list[DataFrame], cosine: float) -> DataFrame:
    """(a, b) leaves, a <= b, that may hold linked points."""
    reach = float(np.sqrt(max(0.0, 2 - 2 * cosine)) + SLACK)
    pairs = levels[0].select(F.col("node").alias("a"), F.col("node").alias("b"))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ca, cb = ([np.frombuffer(v, dtype=np.float64) for v in batch.column(i).to_pylist()] for i in (2, 4))
            ra, rb = (batch.column(i).to_numpy() for i in (3, 5))
            d = np.array([np.sqrt(np.square(x - y).sum()) for x, y in zip(ca, cb, strict=True)])
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(d - ra - rb <= reach))

    above = levels[0]
    side = lambda d, s: d.select(F.col("parent").alias(s), F.col("node").alias(f"{s}2"), F.col("centre").alias(f"c{s}"), F.col("radius").alias(f"r{s}"))
    for level in levels[1:]:
        # a node that was not cut goes on as its own only child
        whole = above.join(level.select(F.col("parent").alias("node")).distinct(), "node", "left_anti").select(F.col("node").alias("parent"), "node", "centre", "radius")
        below = stored(level.select("parent", "node", "centre", "radius").unionByName(whole), "cover-nodes")
        wider = pairs.join(side(below, "a"), "a").join(side(below, "b"), "b").where("a < b or a2 <= b2")
        ordered = wider.select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b"), "ca", "ra", "cb", "rb")
        pairs, above = stored(ordered.mapInArrow(near, "a string, b string"), "cover-pairs"), below
    return pairs


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, leaf: int = LEAF) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links (other vectors linked directly), component_id, kept.

    Vectors link if their labels are equal and not null, they have equally many components and their cosine is at
    least ``cosine``. Vectors that are null, empty, zero or hold null or non-finite components link with nothing and are their own
    component. Equal vectors link with each other. vec_id is the key; a null vec_id is taken as no vector. Other columns are ignored.
    """
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists("embedding", lambda x: x != 0)
    rows = vectors.select("vec_id", "label", "embedding").withColumn("usable", F.coalesce(usable, F.lit(False)))
    good = rows.where("usable")
    classes = stored(good.groupBy("label", "embedding").agg(F.min("vec_id").alias("cls"), F.count("*").alias("m")), "classes")
    member = stored(good.join(classes, ["label", "embedding"]).select("vec_id", "cls", "m"), "members")
    leaves, levels = tree(_points(classes), leaf)
    leaves = stored(leaves, "leaves")
    pairs = stored(_unpruned(levels, cosine), "leaf-pairs")
    name = F.concat_ws("|", "a", "b").alias("pair")
    left = pairs.join(leaves, pairs.a == leaves.leaf).select(name, F.lit(0).alias("side"), "cls", "m", "v")
    right = pairs.where("a <> b").join(leaves, F.col("b") == leaves.leaf).select(name, F.lit(1).alias("side"), "cls", "m", "v")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cls")
        a, b = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        cls, links, edges = compare(a, b if len(b) else None, cosine)
        u, v = ([e[k] for e in edges] for k in (0, 1))
        empty = [None] * len(cls)
        return pd.DataFrame({"cls": [*cls.tolist(), *[None] * len(u)], "links": [*links.tolist(), *[None] * len(u)], "u": [*empty, *u], "v": [*empty, *v]}, dtype="Int64")

    found = stored(left.unionByName(right).groupBy("pair").applyInPandas(run, "cls long, links long, u long, v long"), "links")
    counts = found.where("cls is not null").groupBy("cls").agg(F.sum("links").alias("links"))
    roots = components(found.where("u is not null").select("u", "v")).withColumnRenamed("node", "cls")
    judged = member.join(counts, "cls", "left").join(roots, "cls", "left").select(
        "vec_id", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("root", "cls").alias("component_id"))
    rest = rows.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return judged.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
