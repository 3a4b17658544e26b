"""Whole-word keyword matching over the lexicon.

A keyword made only of word characters matches exactly when it is one of the
text's maximal word runs, so those are found by one hash intersection of the
text's words with the lexicon.  The entries holding a blank or punctuation are
looked up as substrings, only when their first word is there, and confirmed by
a bounded pattern.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from lurewatch import lexicon as L
from lurewatch.functions.behaviour import CUE_WORDS, with_special_cues
from lurewatch.functions.bind import let

_SINGLE = re.compile(r"^\w+$")
LEXICON = list(dict.fromkeys(
    [kw for _, words in L.RISK_CATEGORIES.values() for kw in words]
    + [kw for words in L.SUSPICIOUS_KEYWORDS.values() for kw in words]
))
_WORDS = [kw for kw in LEXICON if _SINGLE.match(kw)]
_PHRASES = [kw for kw in LEXICON if not _SINGLE.match(kw)]
_HEADS = [(re.findall(r"\w+", kw) or [""])[0] for kw in _PHRASES]
_WANTED = list(dict.fromkeys([*_WORDS, *[h for h in _HEADS if h], *CUE_WORDS]))


def contains_word(lower_text: Column, keyword: str) -> Column:
    """Does the already lower-cased text hold this word or phrase?"""
    return F.contains(lower_text, F.lit(keyword)) & lower_text.rlike(L.keyword_pattern(keyword))


def _phrase_hits(lower_text: Column, present: Column) -> Column:
    head, tail = rf"(?:^|[^{L.WORD}])\Q", rf"\E(?:\z|[^{L.WORD}])"
    entries = F.arrays_zip(F.lit(_HEADS).alias("head"), F.lit(_PHRASES).alias("phrase"))
    likely = F.filter(
        entries,
        lambda e: ((e["head"] == "") | F.array_contains(present, e["head"])) & F.contains(lower_text, e["phrase"]),
    )
    return F.filter(
        F.transform(likely, lambda e: e["phrase"]),
        lambda kw: F.rlike(lower_text, F.concat(F.lit(head), kw, F.lit(tail))),
    )


def scan(text: Column) -> Column:
    """struct(hits, cues, categories, risk_score, category_names) in one pass.

    ``hits`` are the lexicon entries present, ``cues`` the words that can
    start a behavioural signal.
    """
    def finish(hits: Column, cues: Column) -> Column:
        return let(category_scores(hits), lambda cats: F.struct(
            hits.alias("hits"), cues.alias("cues"), cats.alias("categories"), risk_score(cats).alias("risk_score"),
            F.transform(cats, lambda c: c["category"]).alias("category_names"),
        ))

    def look(low: Column, present: Column) -> Column:
        hits = F.concat(F.array_intersect(F.lit(_WORDS), present), _phrase_hits(low, present))
        return let(hits, lambda h: finish(h, with_special_cues(F.array_intersect(F.lit(CUE_WORDS), present), low)))

    return let(
        F.lower(text),
        lambda low: let(
            F.array_intersect(F.lit(_WANTED), F.split(low, f"[^{L.WORD}]+")), lambda present: look(low, present)
        ),
    )


def category_hits(hits: Column, category: str) -> Column:
    """Keywords of one risk category among the hits, in lexicon order."""
    return F.array_intersect(F.lit(L.RISK_CATEGORIES[category][1]), hits)


def category_scores(hits: Column) -> Column:
    """array<struct<category, matches, score>> of the categories that fired."""
    cells = []
    for category, (weight, _) in L.RISK_CATEGORIES.items():
        matches = category_hits(hits, category)
        cells.append(F.struct(
            F.lit(category).alias("category"), matches.alias("matches"), (F.size(matches) * weight).alias("score")
        ))
    return F.filter(F.array(*cells), lambda c: c["score"] > 0)


def risk_score(categories: Column) -> Column:
    return F.least(F.lit(100), F.aggregate(categories, F.lit(0), lambda acc, c: acc + c["score"]))


def suspicious(hits: Column) -> Column:
    listed = list(dict.fromkeys(kw for words in L.SUSPICIOUS_KEYWORDS.values() for kw in words))
    return F.array_sort(F.array_intersect(F.lit(listed), hits))
