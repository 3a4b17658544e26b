"""The message scoring plan: one projection chain, no shuffle.

Each stage is a single struct expression (see ``functions.bind``), so however
many of its fields a query reads or filters on, a text is scanned once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lurewatch.functions import behaviour as B
from lurewatch.functions import detection as D
from lurewatch.functions import entities as E
from lurewatch.functions import keywords as K
from lurewatch.functions.bind import let


PATTERN_MODEL = "pattern_rules.v1"


def _attach(df: DataFrame, struct: Column) -> DataFrame:
    return df.withColumn("__s", struct).select("*", "__s.*").drop("__s")


def _intel(text: Column, kw: Column) -> Column:
    return E.extract(text, K.suspicious(kw["hits"]))


def rules_struct(text: Column) -> Column:
    """Keyword and entity verdict of one text, before any behavioural override."""
    def verdict(kw: Column, intel: Column, base: Column, conf: Column) -> Column:
        scam = D.pattern_is_scam(kw["risk_score"], F.size(kw["categories"]), conf, intel)
        kind = D.scam_type(kw["category_names"], intel, text)
        return let(F.struct(scam.alias("scam"), kind.alias("kind")), lambda v: F.struct(
            *[kw[f].alias(f) for f in ("hits", "cues", "categories", "category_names", "risk_score")],
            intel.alias("intel"), base.alias("base_score"), conf.alias("pattern_confidence"), v["scam"].alias("is_scam"),
            v["kind"].alias("raw_type"),
            F.when(v["scam"] & v["kind"].isin("other", "UNKNOWN_SCAM"), "OTHER_SUSPICIOUS").otherwise(v["kind"]).alias("scam_type"),
            D.indicators(intel["suspiciousKeywords"], kw["categories"]).alias("indicators"),
        ))

    return let(K.scan(text), lambda kw: let(_intel(text, kw), lambda i: let(
        F.struct(E.intel_score(i).alias("base"), D.pattern_confidence(kw["risk_score"], E.intel_score(i)).alias("conf")),
        lambda s: verdict(kw, i, s["base"], s["conf"]),
    )))


def pattern_struct(text: Column) -> Column:
    """``rules_struct`` with the behavioural override applied on top."""
    def merge(r: Column, b: Column) -> Column:
        signals = b["signals"]
        return let(F.struct(
            D.override_level(signals).alias("level"), D.primary_signal(signals).alias("primary"),
            D.secondary_signals(signals).alias("secondary"),
        ), lambda o: final(r, b, o))

    def final(r: Column, b: Column, o: Column) -> Column:
        level, n_sec, over = o["level"], F.size(o["secondary"]), o["level"].isNotNull()
        evidence = F.concat(F.array(o["primary"]["evidence"]), F.transform(o["secondary"], lambda t: F.try_element_at(b["signals"], t)))
        return F.struct(
            *[r[f].alias(f) for f in ("categories", "category_names", "intel", "base_score")],
            b["signals"].alias("signals"), b["negated_request"].alias("negated_request"),
            o["primary"].alias("primary"), o["secondary"].alias("secondary"), D.override_base(level).alias("override_base"),
            F.when(over, D.override_risk(level, r["risk_score"], n_sec)).otherwise(r["risk_score"]).alias("risk_score"),
            F.when(over, D.override_confidence(level, n_sec)).otherwise(r["pattern_confidence"]).alias("pattern_confidence"),
            F.when(over, D.override_type(level)).otherwise(r["scam_type"]).alias("scam_type"),
            (over | r["is_scam"]).alias("is_scam"),
            F.when(over, F.slice(F.array_distinct(F.concat(evidence, r["indicators"])), 1, 10)).otherwise(r["indicators"]).alias("indicators"),
        )

    return let(rules_struct(text), lambda r: let(B.detect(text, r["cues"]), lambda b: merge(r, b)))


def with_keywords(df: DataFrame) -> DataFrame:
    """Adds ``hits``, ``cues``, ``categories``, ``risk_score`` and ``category_names``."""
    return _attach(df, K.scan(F.col("text")))


def with_intel(df: DataFrame) -> DataFrame:
    """Adds ``intel``: the validated entities of the text."""
    text = F.col("text")
    return df.withColumn("intel", let(K.scan(text), lambda kw: _intel(text, kw)))


def with_behaviour(df: DataFrame) -> DataFrame:
    """Adds ``signals`` (type to first sentence) and ``negated_request``."""
    text = F.col("text")
    return _attach(df, let(K.scan(text), lambda kw: B.detect(text, kw["cues"])))


def rules_verdict(df: DataFrame) -> DataFrame:
    return _attach(df, rules_struct(F.col("text")))


def pattern_verdict(df: DataFrame) -> DataFrame:
    return _attach(df, pattern_struct(F.col("text")))


def evidence_items(categories, primary, override_base, secondary, opinion_type=None, opinion_confidence=None):
    """array<struct<source, type, weight>> explaining a verdict."""
    def item(source: str, kind, weight):
        return F.struct(F.lit(source).alias("source"), kind.alias("type"), weight.cast("double").alias("weight"))

    parts = [
        F.transform(categories, lambda c: item("rule_detector", F.upper(c["category"]), F.round(F.least(c["score"] / 100.0, F.lit(1.0)), 3))),
        F.when(primary.isNotNull(), F.concat(
            F.array(item("behavioral_detector", primary["type"], F.round(override_base, 2))),
            F.transform(secondary, lambda t: item("behavioral_detector", t, F.lit(0.2))),
        )),
    ]
    if opinion_type is not None:
        parts.append(F.when(opinion_confidence.isNotNull(), F.array(item(
            "llm", F.coalesce(opinion_type, F.lit("ai_opinion")), F.round(F.greatest(opinion_confidence, F.lit(0.0)), 3)
        ))))
    empty = F.array().cast("array<struct<source:string,type:string,weight:double>>")
    return F.concat(*[F.coalesce(p, empty) for p in parts])
