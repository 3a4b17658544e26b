"""Merkle manifest against a tree built in one place."""

from hashlib import sha256
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from lurewatch.llm import merkle


def h(text):
    return sha256(text.encode()).hexdigest()


def leaf(row, text):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row["doc_id"], row["source"], row["lang"], row["n_chars"], text)))


def climb(digests):
    levels = [digests]
    while len(levels[-1]) > 1:
        levels.append([h("".join(levels[-1][i : i + 8])) for i in range(0, len(levels[-1]), 8)])
    return levels


def siblings(levels, at):
    out = []
    for nodes in levels[:-1]:
        run = range(at // 8 * 8, min(at // 8 * 8 + 8, len(nodes)))
        out.append(("".join(nodes[i] for i in run if i < at), "".join(nodes[i] for i in run if i > at)))
        at //= 8
    return out


def plain(rows):
    trees = {}
    for r in rows:
        trees.setdefault(r["lang"], []).append(r)
    order = sorted(trees, key=lambda k: (k is not None, (k or "").encode()))
    built = []
    for k in order:
        trees[k].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, bytes.fromhex(leaf(r, r["text"]))))
        built.append(climb([leaf(r, r["text"]) for r in trees[k]]))
    top = climb([b[-1][0] for b in built])
    out = []
    for i, k in enumerate(order):
        for j, r in enumerate(trees[k]):
            path, text = siblings(built[i], j) + siblings(top, i), r["text"]
            if r["doc_id"] is not None and text is not None and crc32(str(r["doc_id"]).encode()) % 3 == 0:
                text = "".join(c.lower() if c.isascii() else c for c in text)
            at = leaf(r, text)
            for a, b in path:
                at = h(a + at + b)
            out.append((r["doc_id"], built[i][0][j], built[i][-1][0], top[-1][0], h("".join(a + b for a, b in path)), at, at == top[-1][0]))
    return sorted(out, key=str)


def found(df):
    return sorted(map(tuple, df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=str)


@pytest.mark.parametrize("levels", [1, 2, 4])
def test_manifest_equals_one_tree(spark, monkeypatch, levels):
    monkeypatch.setattr(merkle, "RANGE_LEAVES", 150)
    langs = ["en"] * 6 + ["de", "fr", "é", None]
    docs = spark.range(700).select(
        (F.col("id") * 7 % 701).alias("doc_id"), F.element_at(F.array(*map(F.lit, langs)), (F.col("id") % 10 + 1).cast("int")).alias("lang"),
        F.when(F.col("id") % 11 > 0, F.concat(F.lit("Text Ä "), "id")).alias("text"), F.when(F.col("id") % 5 > 0, F.lit("s")).alias("source"), F.col("id").alias("n_chars"))
    docs = docs.union(spark.range(12).selectExpr("id + 5000", "concat('lang', id)", "'ONE Leaf'", "null", "id"))
    assert found(merkle.manifest(docs, levels=levels)) == plain(docs.collect())


@pytest.mark.parametrize("sizes", [{"en": 1}, {"en": 1, "de": 1}, {"en": 8}, {"en": 9, None: 1}, {"en": 64, "de": 65}, {c: 1 for c in "abcdefghi"}])
def test_small_trees(spark, sizes):
    rows = [(100 * i + j, None, k, 3, "Abc") for i, (k, n) in enumerate(sizes.items()) for j in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert found(merkle.manifest(docs, levels=1)) == plain(docs.collect())


def test_untampered_rows_verify(spark, odd_docs):
    rows = merkle.manifest(odd_docs, tamper=None).collect()
    assert len(rows) == 12 and all(r["verified"] for r in rows)


def test_odd_rows_of_manifest(odd_docs):
    assert found(merkle.manifest(odd_docs)) == plain(odd_docs.collect())
    assert merkle.manifest(odd_docs.limit(0)).count() == 0
