"""From keyword, entity and behaviour columns to a verdict."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lurewatch import lexicon as L

NON_SPECIFIC = ["other", "UNKNOWN_SCAM", "OTHER_SUSPICIOUS"]


def bank_context(text: Column) -> Column:
    return text.rlike("(?iu)" + L.whole(L.BANK_CONTEXT))


def investment_context(text: Column) -> Column:
    return text.rlike("(?iu)" + L.whole(L.INVESTMENT_CONTEXT))


def scam_type(names: Column, intel: Column, text: Column) -> Column:
    """The most specific type the fired categories and entities support."""
    def fired(category: str) -> Column:
        return F.array_contains(names, category)

    return (
        F.when(fired("job_scam"), "job_scam")
        .when(fired("romance"), "romance_scam")
        .when(fired("crypto"), "crypto_scam")
        .when(fired("delivery"), "delivery_scam")
        .when(F.size(intel["phishingLinks"]) > 0, "phishing")
        .when(F.size(intel["upiIds"]) > 0, "upi_fraud")
        .when(fired("rewards"), "lottery")
        .when(fired("verification") & fired("authority") & bank_context(text), "bank_fraud")
        .when(fired("financial") & fired("urgency") & investment_context(text), "investment_scam")
        .when(F.size(names) >= 3, "UNKNOWN_SCAM")
        .otherwise("other")
    )


def pattern_confidence(risk: Column, base: Column) -> Column:
    return F.least((risk * 0.7 + base * 0.3) / 100.0, F.lit(1.0))


def pattern_is_scam(risk: Column, n_categories: Column, confidence: Column, intel: Column) -> Column:
    return (risk >= 18) | (n_categories >= 2) | (confidence > 0.30) | (F.size(intel["phishingLinks"]) > 0)


def indicators(keywords: Column, categories: Column) -> Column:
    """At most ten flags: suspicious keywords and two hits per category, sorted."""
    per_category = F.flatten(F.transform(categories, lambda c: F.slice(c["matches"], 1, 2)))
    return F.slice(F.array_sort(F.array_union(keywords, per_category)), 1, 10)


def override_level(signals: Column) -> Column:
    """Which behavioural request, if any, takes over the verdict."""
    def any_of(types: list[str]) -> Column:
        return F.arrays_overlap(F.map_keys(signals), F.lit(types))

    return (
        F.when(any_of(L.MFA_TYPES), "mfa")
        .when(any_of(L.CREDENTIAL_TYPES), "credential")
        .when(any_of(["BANK_DETAIL_REQUEST"]), "bank_detail")
        .when(any_of(["PAYMENT_REQUEST"]), "payment")
    )


def primary_signal(signals: Column) -> Column:
    """struct(type, evidence) of the request that owns the verdict."""
    order = [*L.MFA_TYPES, *L.CREDENTIAL_TYPES, "BANK_DETAIL_REQUEST", "PAYMENT_REQUEST"]
    return F.coalesce(*[
        F.when(F.map_contains_key(signals, t), F.struct(F.lit(t).alias("type"), F.try_element_at(signals, F.lit(t)).alias("evidence")))
        for t in order
    ])


def secondary_signals(signals: Column) -> Column:
    return F.filter(F.lit(L.SECONDARY_TYPES), lambda t: F.map_contains_key(signals, t))


def _by_level(level: Column, position: int) -> Column:
    out = F.lit(None)
    for name, row in reversed(L.BEHAVIOUR_OVERRIDE.items()):
        out = F.when(level == name, F.lit(row[position])).otherwise(out)
    return out


def override_type(level: Column) -> Column:
    return _by_level(level, 0)


def override_risk(level: Column, risk: Column, n_secondary: Column) -> Column:
    return F.least(F.greatest(risk, _by_level(level, 1)) + 5 * F.least(n_secondary, F.lit(2)), F.lit(100))


def override_confidence(level: Column, n_secondary: Column) -> Column:
    return F.least(_by_level(level, 2) + 0.03 * n_secondary, F.lit(0.97))


def override_base(level: Column) -> Column:
    return _by_level(level, 2)


def confidence_bucket(score: Column) -> Column:
    return F.when(score >= 0.75, "High").when(score >= 0.45, "Medium").otherwise("Low")


def severity(risk: Column) -> Column:
    return (
        F.when(risk >= 80, "critical").when(risk >= 60, "high").when(risk >= 30, "medium").when(risk > 0, "low").otherwise("none")
    )


def type_has_evidence(claimed: Column, text: Column) -> Column:
    low = F.lower(text)
    return (
        F.when(claimed == "investment_scam", investment_context(text))
        .when(claimed == "bank_fraud", bank_context(text))
        .when(claimed == "phishing", F.contains(low, F.lit("http://")) | F.contains(low, F.lit("https://")))
        .otherwise(True)
    )


def lookup(column: Column, table: dict, default=None) -> Column:
    """Small fixed dictionary as a map literal."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    found = F.try_element_at(F.create_map(*pairs), column)
    return found if default is None else F.coalesce(found, F.lit(default))
