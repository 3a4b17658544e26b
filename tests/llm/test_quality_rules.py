"""Repetition coverage against plain counting."""

import random
import re
from collections import Counter

import pytest

from lurewatch.llm import repetition
from lurewatch.llm import text as T

LENGTHS = (3, 5, 6, 10)


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    chars = sum(map(len, words))

    def under(n, first):
        windows = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
        count, seen, inside = Counter(windows), set(), set()
        for i, w in enumerate(windows):
            if count[w] > 1 and (first or w in seen):
                inside.update(range(i, i + n))
            seen.add(w)
        return inside

    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    again = [x for i, x in enumerate(lines) if x in lines[:i]]
    in_line = sum(len(w) for x in again for w in re.findall(r"[^\x20\x09-\x0D]+", x))
    return [len(words), chars, len(re.findall(r"[#*$%&|<>]", text or "")), len(again), len(under(3, True)), len(lines), in_line,
            *(sum(len(words[i]) for i in under(n, False)) for n in LENGTHS)]


def measured(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: list(r)[1:] for r in repetition.coverage(docs, LENGTHS).collect()}


@pytest.mark.parametrize("step", [40, T.STEP_BYTES])
def test_measures_equal_counting(spark, monkeypatch, step):
    monkeypatch.setattr(T, "STEP_BYTES", step)
    rng = random.Random(3)
    texts = [None, "", " \n\t\n", "\n\n", "a", "x y z x y z\n", "é ü é ü é ü ß", "a  b\na b\na  b", "###\n###\n#"]
    for _ in range(60):
        vocabulary = ["w%d" % i for i in range(rng.choice([2, 5, 50]))] + ["é<", "日本語", "x" * 45]
        texts.append("".join(rng.choice(vocabulary) + rng.choice([" ", "  ", "\n", "\t", " \n"]) for _ in range(rng.randrange(120))))
    assert measured(spark, texts) == {i: plain(t) for i, t in enumerate(texts)}


def test_rows_do_not_meet(spark):
    assert measured(spark, ["a b c d e", "a b c d e", "a b c d e"])[1] == plain("a b c d e")


def test_odd_rows_of_quality_rules(odd_docs):
    rows = sorted((r["doc_id"] or 0, r["n_words"], r["base_failed"], r["kept"]) for r in repetition.judge(odd_docs).collect())
    assert rows == [(0, 120, True, False), (1, 0, True, False), (2, 0, True, False), (3, 0, True, False), (4, 120, True, False), (5, 120, True, False), (5, 120, True, False),
                    (6, 1, True, False), (7, 1, True, False), (8, 60_000, True, False), (9, 4, True, False), (10, 1, True, False)]
    assert repetition.judge(odd_docs.limit(0)).count() == 0


def test_kept_and_limits(spark):
    fresh = " ".join(f"word{i}" for i in range(90))
    passage = " ".join(f"said{i}" for i in range(10))
    at_limit = repetition.judge(spark.createDataFrame([(1, fresh), (2, f"{fresh} {passage} {passage}"), (3, f"{fresh} {passage} {passage} {passage}")], "doc_id long, text string"))
    assert {r["doc_id"]: (r["base_failed"], r["kept"]) for r in at_limit.collect()} == {1: (False, True), 2: (False, True), 3: (False, False)}


def test_long_text_of_one_row(spark):
    unit = " ".join(f"n{i}" for i in range(1000))
    text = f"{unit} " * 300 + "y" * 600_000
    row = repetition.coverage(spark.createDataFrame([(1, text)], "doc_id long, text string"), (5,)).first()
    assert row["n_words"] == 300_001 and row["n_repeat_words"] == 300_000
    assert row["dup_5_chars"] == 299 * sum(len(f"n{i}") for i in range(1000))
