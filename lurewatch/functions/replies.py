"""Checks and clean-up of agent replies, and traits of incoming messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lurewatch import lexicon as L
from lurewatch.functions.bind import let
from lurewatch.functions.text import strip_space, word_count


def meta_hits(text: Column) -> Column:
    """Positions (1-based) of the meta-language patterns the reply contains."""
    return F.array_compact(F.array(*[
        F.when(text.rlike("(?iu)" + L.whole(p)), F.lit(i)) for i, p in enumerate(L.META_PHRASES, 1)
    ]))


def is_meta_language(text: Column) -> Column:
    return F.coalesce(text.rlike("(?iu)" + L.whole("|".join(L.META_PHRASES))), F.lit(False))


def is_prompt_leak(text: Column) -> Column:
    return F.coalesce(text.rlike("(?iu)" + L.whole("|".join(L.LEAK_PHRASES))), F.lit(False))


def strip_meta(text: Column) -> Column:
    for prefix in L.REPLY_PREFIXES:
        text = F.regexp_replace(text, rf"(?iu)\A(?:{prefix}[.,!?]?[{L.SPACE}]*)+", "")
    for aside in L.REPLY_ASIDES:
        text = F.regexp_replace(text, rf"(?iu)[{L.SPACE}]*\([^\n]*?{aside}[^\n]*?\)", "")
    return strip_space(text)


def cap_sentences(text: Column, most: int) -> Column:
    parts = F.filter(F.transform(F.split(text, r"[.!?]+"), strip_space), lambda s: s != "")
    return F.when(
        F.size(parts) > most, F.concat(F.array_join(F.slice(parts, 1, most), ". "), F.lit("."))
    ).otherwise(text)


def sanitize(text: Column, fallback: Column, max_sentences: int = 2, max_chars: int = 200, check_meta: bool = True) -> Column:
    """Reply fit to send, or ``fallback``; zero sentences means no sentence limit."""
    blank = F.coalesce(strip_space(text) == "", F.lit(True))
    cleaned = text
    failed = F.lit(False)
    if check_meta:
        meta, stripped = is_meta_language(text), strip_meta(text)
        failed = meta & (F.length(stripped) < 3)
        cleaned = F.when(meta, stripped).otherwise(text)
    final = cap_sentences(cleaned, max_sentences) if max_sentences else cleaned
    final = F.when(F.length(final) > max_chars, F.concat(F.left(final, F.lit(max_chars - 3)), F.lit("..."))).otherwise(final)
    return F.when(blank | is_prompt_leak(text) | failed | (F.length(final) < 2), fallback).otherwise(final)


def _count_any(text: Column, words: list[str]) -> Column:
    return sum((F.contains(text, F.lit(w)).cast("int") for w in words), F.lit(0))


def behaviour_profile(text: Column) -> Column:
    """struct(aggression, patience, sophistication); plain substring tests."""
    def high_low(cond: Column) -> Column:
        return F.when(cond, "HIGH").otherwise("LOW")

    def judge(p: Column) -> Column:
        shouting = (F.upper(text) == text) & (p["low"] != text)
        return F.struct(
            high_low((p["aggression"] >= 1) | shouting).alias("aggression"),
            high_low(_count_any(p["low"], L.FRUSTRATION_WORDS) == 0).alias("patience"),
            high_low((p["aggression"] == 0) & (word_count(text) > 20)).alias("sophistication"),
        )

    return let(F.lower(text), lambda low: let(
        F.struct(low.alias("low"), _count_any(low, L.AGGRESSION_WORDS).alias("aggression")), judge
    ))


def new_information(text: Column) -> Column:
    """Six flags telling what a message newly reveals."""
    return F.struct(
        text.rlike(r"\p{Nd}{10,12}").alias("has_phone"),
        text.rlike(rf"[{L.WORD}]@[{L.WORD}]").alias("has_upi"),
        text.rlike(r"\p{Nd}{10,18}").alias("has_bank"),
        text.rlike("https?://").alias("has_link"),
        text.rlike(rf"(?iu)rs\.?[{L.SPACE}]*\p{{Nd}}").alias("mentioned_amount"),
        (_count_any(F.lower(text), L.NEW_INFO_URGENCY) > 0).alias("shows_urgency"),
    )


def is_disengaged(sender: Column, text: Column) -> Column:
    """A non-agent message of one or two words holding a quitting cue."""
    return (
        (sender != "agent") & (F.length(text) > 0) & (word_count(text) < 3)
        & (_count_any(F.lower(text), L.DISENGAGE_WORDS) > 0)
    )
