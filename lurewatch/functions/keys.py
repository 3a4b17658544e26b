"""Indicator keys, flexible timestamps and JSON replies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lurewatch import lexicon as L
from lurewatch.functions.text import strip_space


def is_correlatable(kind: Column) -> Column:
    return kind.isin(L.CORRELATABLE_KINDS)


def comparable_value(normalized: Column, value: Column) -> Column:
    return F.coalesce(F.nullif(normalized, F.lit("")), value)


def normalize_indicator(kind: Column, value: Column) -> Column:
    """Letters and digits only for numbers and handles; trimmed lower case otherwise."""
    return F.when(
        kind.isin("phone", "bank_account", "upi_id"), F.regexp_replace(F.lower(value), "[^a-z0-9]+", "")
    ).otherwise(F.lower(strip_space(value)))


def indicator_hash(kind: Column, normalized: Column) -> Column:
    return F.sha2(F.concat_ws(":", kind, normalized), 256)


def flexible_timestamp(value: Column, fallback: Column | None = None) -> Column:
    """Epoch seconds or milliseconds (number or numeric text) or ISO text, as UTC.

    Anything unreadable becomes ``fallback`` (default: now).
    """
    fallback = F.current_timestamp() if fallback is None else fallback
    text = strip_space(value.cast("string"))
    number = F.when(text.rlike(r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"), text.try_cast("double"))
    seconds = F.when(F.abs(number) > 1e12, number / 1000).otherwise(number)
    in_range = seconds.between(F.lit(-62135596800.0), F.lit(253402300799.0))
    iso = F.when(
        text.rlike(r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:[.,]\d{1,6})?)?(?:Z|[+-]\d{2}:?\d{2})?)?$"),
        F.try_to_timestamp(F.replace(text, F.lit(","), F.lit("."))),
    )
    return F.coalesce(
        F.when(number.isNotNull() & in_range, F.timestamp_micros(F.round(seconds * 1e6).cast("bigint"))),
        F.when(number.isNull(), iso),
        fallback,
    )


def json_block(reply: Column) -> Column:
    """Text inside the first fenced block, or the whole reply."""
    fenced = F.regexp_extract(reply, r"(?s)```(?:json)?\s*(.*?)```", 1)
    return strip_space(F.when(reply.rlike(r"(?s)```(?:json)?\s*.*?```"), fenced).otherwise(reply))


OPINION_SCHEMA = "isScam BOOLEAN, confidence DOUBLE, scamType STRING, indicators ARRAY<STRING>, reasoning STRING"


def parse_opinion(reply: Column) -> Column:
    """Struct of opinion fields with defaults; null when the reply holds no object."""
    block = json_block(reply)
    parsed = F.from_json(block, OPINION_SCHEMA)
    usable = block.startswith("{") & F.try_parse_json(block).isNotNull()
    return F.when(usable, F.struct(
        F.coalesce(parsed["isScam"], F.lit(False)).alias("is_scam"),
        F.coalesce(parsed["confidence"], F.lit(0.5)).alias("confidence"),
        F.coalesce(parsed["scamType"], F.lit("other")).alias("scam_type"),
        F.coalesce(parsed["indicators"], F.array().cast("array<string>")).alias("indicators"),
        F.coalesce(parsed["reasoning"], F.lit("AI analysis")).alias("reasoning"),
    ))
