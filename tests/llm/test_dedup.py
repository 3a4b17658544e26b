"""Suffix-array, substring and SimHash dedup against brute force."""

import hashlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from lurewatch.llm import simhash, substring_dedup, suffix_dedup
from lurewatch.llm.components import components
from lurewatch.llm.queries import QUERIES


def kept_bytes(texts, length):
    """doc -> (bytes, removed, runs, hash) by counting every string."""
    count = Counter(t[i : i + length] for t in texts.values() for i in range(len(t) - length + 1))
    out = {}
    for d, t in texts.items():
        mask = np.zeros(len(t), dtype=bool)
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                mask[i : i + length] = True
        rest = np.frombuffer(t, dtype=np.uint8)[~mask].tobytes()
        out[d] = (len(t), int(mask.sum()), int((np.diff(mask.astype(int), prepend=0) == 1).sum()), hashlib.sha256(rest).hexdigest())
    return out


def suffix_rows(df):
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in df.collect()}


@pytest.mark.parametrize("bucket_rows", [20, 8000])
def test_suffix_array_equals_counting(spark, sf, bucket_rows):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    assert suffix_rows(suffix_dedup.remove_repeats(docs, bucket_rows=bucket_rows)) == kept_bytes(texts, 200)


def test_suffix_array_small_windows_and_zero_bytes(docs_of):
    texts = {1: "abcabcabcabc\0\0\0\0xyz", 2: "zzabcabcq\0\0\0", 3: "", 4: "aaaaaaaaaaaaaaaaaaa", 5: "bcabcabq\0\0\0x"}
    docs = docs_of([(i, t, None, None) for i, t in texts.items()])
    got = suffix_rows(suffix_dedup.remove_repeats(docs, length=6, gram=3, bucket_rows=3))
    assert got == kept_bytes({i: t.encode() for i, t in texts.items()}, 6)


def test_suffix_array_hot_gram_over_many_buckets(docs_of):
    rng = np.random.default_rng(3)
    word = lambda n: "".join(rng.choice(list("abcdefghij"), n))
    line = word(60)
    texts = {i: word(90) + line + word(90) for i in range(300)}
    texts |= {300 + i: texts[i][30:] + word(20) for i in range(0, 60, 3)}
    docs = docs_of([(i, t, None, None) for i, t in texts.items()])
    got = suffix_rows(suffix_dedup.remove_repeats(docs, bucket_rows=25))
    assert got == kept_bytes({i: t.encode() for i, t in texts.items()}, 200)
    assert sum(r[1] > 0 for r in got.values()) == 40


def test_multikey_order_sorts_rows():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 3, (500, 4)).astype(">u8")
    order = suffix_dedup.multikey_order(keys)
    assert [tuple(r) for r in keys[order]] == sorted(tuple(r) for r in keys)


def test_odd_rows_of_suffix_array(odd_docs):
    rows = suffix_dedup.remove_repeats(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"]) for r in rows}
    assert got[1] == (0, 0, 0) and got[2] == (0, 0, 0)
    assert got[4][1] == got[4][0] and got[5][1] == got[5][0]
    assert got[None] == (588, 0, 0)
    assert got[6] == (800, 800, 1) and got[7][1] == 300_000
    assert suffix_dedup.remove_repeats(odd_docs.limit(0)).count() == 0


def test_text_without_halves_of_characters(docs_of):
    docs = docs_of([(1, "xé" * 4 + "q", None, None), (2, "é" + "xé" * 3, None, None)])
    texts = [r["kept"] for r in suffix_dedup.remove_repeats(docs, length=5, gram=2, as_text=True).collect()]
    assert all("�" not in t for t in texts)


def kept_words(texts, length):
    first, words = {}, {d: t.encode().split() for d, t in texts.items()}
    for d in sorted(words):
        for i in range(len(words[d]) - length + 1):
            first.setdefault(tuple(words[d][i : i + length]), d)
    out = {}
    for d, w in words.items():
        mask = np.zeros(len(w), dtype=bool)
        for i in range(len(w) - length + 1):
            if first[tuple(w[i : i + length])] < d:
                mask[i : i + length] = True
        rest = b" ".join(x for x, m in zip(w, mask, strict=True) if not m)
        out[d] = (len(w), int(mask.sum()), hashlib.sha256(rest).hexdigest())
    return out


def word_rows(df):
    return {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in df.collect()}


def test_substring_dedup_equals_counting(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    assert word_rows(substring_dedup.remove_repeats(docs)) == kept_words(texts, 50)


def test_substring_dedup_small_windows(docs_of):
    texts = {1: "a b c d e a b c d e", 2: "x a b c d y", 3: "b c d e a z a b c d", 4: "", 5: "a a a a a a", 6: "a a a a", 7: "q a b c"}
    docs = docs_of([(i, t, None, None) for i, t in texts.items()])
    assert word_rows(substring_dedup.remove_repeats(docs, window_words=4, gram_words=2)) == kept_words(texts, 4)


def test_odd_rows_of_substring_dedup(odd_docs):
    rows = substring_dedup.remove_repeats(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    got = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in rows}
    assert got[1] == (0, 0) and got[4] == (120, 0) and got[5] == (120, 120) and got[None] == (120, 0) and got[8] == (60_000, 0)
    assert substring_dedup.remove_repeats(odd_docs.limit(0)).count() == 0


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def smallest_reachable(prints, distance=3):
    ids, parent = list(prints), {i: i for i in prints}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= distance:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash_equals_all_pairs(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    prints = {r["doc_id"]: plain_fingerprint(r["text"]) for r in docs.collect()}
    got = QUERIES["op8_simhash_dedup"][0](spark, sf).collect()
    assert {r["doc_id"]: int(r["fingerprint"], 16) for r in got} == prints
    assert {r["doc_id"]: r["component_id"] for r in got} == smallest_reachable(prints)


@pytest.mark.parametrize("split_over", [2, 4096])
def test_links_of_dense_fingerprints(spark, split_over):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 62, 3)
    prints = {int(b) ^ sum(1 << int(k) for k in rng.choice(62, rng.integers(0, 6), replace=False)) for b in base for _ in range(60)}
    table = {p: p for p in prints}
    found = simhash.links(spark.createDataFrame([(p,) for p in prints], "fp long"), split_over=split_over)
    roots = {r["node"]: r["root"] for r in components(found).collect()}
    assert {p: roots.get(p, p) for p in prints} == smallest_reachable(table)


def test_odd_rows_of_simhash(odd_docs):
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(odd_docs).collect()}
    assert got[1] == got[2] == got[3] == ("0" * 16, 1)
    assert got[4][1] == got[5][1] == got[None][1] == 4
    assert simhash.near_duplicates(odd_docs).count() == odd_docs.count()
    assert simhash.near_duplicates(odd_docs.limit(0)).count() == 0


def test_components_of_a_long_chain(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (101, 100)], "u long, v long")
    got = {r["node"]: r["root"] for r in components(chain).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {101: 100}
    assert components(chain.limit(0)).count() == 0
