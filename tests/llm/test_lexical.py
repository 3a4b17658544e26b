"""Ranked lexical search against scoring every document for every item."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from lurewatch.llm import lexical


def plain(docs, items, k):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    counted = [(d, Counter(split(t))) for d, t in docs]
    counted = [(d, c) for d, c in counted if c]
    count, total = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    wanted = defaultdict(set)
    for i, t in items:
        wanted[i] |= set(split(t))
    out = set()
    for i, ts in wanted.items():
        found = []
        for d, c in counted:
            m = 10 + 90 * sum(c.values()) * count // total
            score = sum(math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in ts if c[t])
            if score > 0 and d is not None:
                found.append((-score, d))
        out |= {(i, r + 1, d, -s) for r, (s, d) in enumerate(sorted(found)[:k])}
    return out


def ranked(spark, docs, items, **how):
    found = lexical.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), **how)
    rows = [tuple(r) for r in found.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("how", [{}, {"block_terms": 40, "k": 3}])
def test_search_equals_scoring_all(spark, monkeypatch, how):
    monkeypatch.setattr(lexical, "_CELLS", 400)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)] + ["Straße", "ÄRGER", "日本", "a_b", "x-y"]
    docs = [(i, " ".join(rng.choices(words, k=rng.randrange(30)))) for i in range(150)] + [(900, None), (901, "!!"), (None, "w1 w2 w3"), (902, "w1 " * 5000)]
    docs += [(200 + i, docs[7][1]) for i in range(12)]  # ties
    passage = " ".join(rng.sample(words, 8))
    items = [(i, f"{passage} {' '.join(rng.choices(words, k=6))}") for i in range(12)] + [(20, None), (21, "?"), (22, "nowhere"), (23, "W1"), (23, "w2"), (None, "w3 w4")]
    assert ranked(spark, docs, items, **how) == plain(docs, items, how.get("k", 10))


def test_shared_sets_are_added_up_once():
    rng = np.random.default_rng(1)
    common, own = rng.integers(1, 1 << 62, 24).astype(np.uint64), rng.integers(1, 1 << 62, (50, 3)).astype(np.uint64)
    items = [np.concatenate([common, x]) for x in own] + [common[:10], own[0]]
    plan = lexical.share(items)
    assert plan.additions() < sum(len(x) - 1 for x in items) / 3
    held = [{i} for i in range(len(plan.terms))]
    for a, b in zip(plan.left, plan.right, strict=True):
        assert not held[a] & held[b]
        held.append(held[a] | held[b])
    ends = [*plan.starts[1:], len(plan.nodes)]
    for x, a, b in zip(items, plan.starts, ends, strict=True):
        got = [t for n in plan.nodes[a:b] for t in held[n]]
        assert sorted(got) == sorted(np.searchsorted(plan.terms, x).tolist())
    levels = np.cumsum([len(plan.terms), *plan.levels])
    for a, b in zip(levels[:-1], levels[1:], strict=True):
        assert (plan.left[a - len(plan.terms) : b - len(plan.terms)] < a).all() and (plan.right[a - len(plan.terms) : b - len(plan.terms)] < a).all()


def test_lengths_beyond_64_bits():
    assert lexical._lengths(np.array([1 << 40]), 1 << 30, 1 << 50).tolist() == [10 + 90 * (1 << 20)]


def test_odd_rows_of_search(spark, odd_docs):
    items = spark.createDataFrame([(1, "word", 5), (2, None, 6), (3, "nine nine", 7)], "item_id int, text string, rank int")
    rows = {tuple(r) for r in lexical.search(odd_docs, items).select("item_id", "rank", "doc_id").collect()}
    assert {r for r in rows if r[0] == 1} == {(1, 1, 8)} and {r[2] for r in rows if r[0] == 3} == {4, 5}
    assert len([r for r in rows if r[0] == 3]) == 3  # doc_id 5 is two rows
    assert lexical.search(odd_docs.limit(0), items).count() == 0 and lexical.search(odd_docs, items.limit(0)).count() == 0
