"""Weighted fusion of risk signals, the external-opinion policy and the final decision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lurewatch import lexicon as L
from lurewatch.functions import detection as D


def attach_weights(signals: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Stamp the configured weight of each signal's source; unknown sources get 0.

    The table has one row per source kind (six), so it is a literal in the plan.
    """
    return signals.withColumn("weight", D.lookup(F.col("source"), weights or L.FUSION_WEIGHTS, 0.0))


def fuse(signals: DataFrame, key: str = "investigation_id", digits: int | None = 3) -> DataFrame:
    """Weighted mean of the signals present, per investigation.

    Sums combine before the shuffle, so one investigation holding most of the
    rows costs one partial row per task.  ``contributing_sources`` is a set over
    six source kinds and therefore bounded.
    """
    used = F.col("weight") > 0
    total = F.sum(F.when(used, F.col("weight")))
    score = F.coalesce(F.sum(F.when(used, F.col("score") * F.col("weight"))) / total, F.lit(0.0))
    return signals.groupBy(key).agg(
        (score if digits is None else F.round(score, digits)).alias("risk_score"),
        F.array_sort(F.collect_set(F.when(used, F.col("source")))).alias("contributing_sources"),
        F.count_if(used).alias("n_contributing"),
        F.count(F.lit(1)).alias("n_signals"),
    )


def _rank(verdict: Column) -> Column:
    return D.lookup(verdict, L.VERDICT_RANK)


def resolve_opinion(df: DataFrame, protected: float = 0.60, min_opinion: float = 0.80) -> DataFrame:
    """Merge deterministic evidence with an outside opinion.

    Needs ``verdict, risk_score, confidence, deterministic`` and the opinion's
    ``o_verdict`` (null: none), ``o_risk_score, o_confidence, o_rationale``.
    Raising is always allowed, lowering only on weak evidence and a sure opinion.
    """
    mine, theirs = _rank(F.col("verdict")), _rank(F.col("o_verdict"))
    higher = (theirs > mine) | ((theirs == mine) & (F.col("o_risk_score") > F.col("risk_score")))
    lower = (theirs < mine) | ((theirs == mine) & (F.col("o_risk_score") < F.col("risk_score")))
    shielded = F.col("deterministic") & (F.col("confidence") >= protected)
    unsure = F.col("o_confidence") < min_opinion
    case = (
        F.when(F.col("o_verdict").isNull(), "none").when(higher, "raised").when(~lower, "agreed")
        .when(shielded, "shielded").when(unsure, "unsure").otherwise("lowered")
    )

    def two(c: Column) -> Column:
        return F.format_string("%.2f", c)

    note = F.when(F.length(F.coalesce("o_rationale", F.lit(""))) > 0, F.concat(F.lit(" — "), F.col("o_rationale"))).otherwise("")
    reason = (
        F.when(case == "none", "no llm opinion")
        .when(case == "raised", "llm raised risk (always permitted)")
        .when(case == "agreed", "llm agreed with evidence")
        .when(case == "shielded", F.concat(F.lit("blocked: deterministic evidence at "), two(F.col("confidence")), F.lit(" confidence cannot be lowered by the llm")))
        .when(case == "unsure", F.concat(F.lit("blocked: llm confidence "), two(F.col("o_confidence")), F.lit(f" below {min_opinion:.2f} required to lower risk")))
        .otherwise(F.concat(F.lit("permitted: low-confidence evidence ("), two(F.col("confidence")), F.lit(") lowered by llm at "), two(F.col("o_confidence")), note))
    )
    taken = case.isin("raised", "lowered")
    return df.select(
        *[c for c in df.columns if c not in ("verdict", "risk_score")],
        F.when(taken, F.col("o_verdict")).otherwise(F.col("verdict")).alias("verdict"),
        F.when(case == "raised", F.greatest("o_risk_score", "risk_score")).when(case == "lowered", F.col("o_risk_score"))
        .otherwise(F.col("risk_score")).alias("risk_score"),
        taken.alias("overridden"), reason.alias("reason"),
    )


def wants_opinion(consent: Column, ml_is_scam: Column, pattern_confidence: Column) -> Column:
    """The outside opinion counts only with consent and while cheaper layers are unsure."""
    return consent & ~F.coalesce(ml_is_scam, F.lit(False)) & (pattern_confidence < 0.7)


def decide(df: DataFrame, override_at: float = 0.7) -> DataFrame:
    """Final verdict and type from all layers.

    Needs ``text, pattern_is_scam, pattern_type, negated_request, fused`` and
    the nullable layers ``spam_score, spam_type``, ``supervised_label/_score``,
    ``semantic_label/_score/_margin``, ``opinion_is_scam/_type``.
    """
    t = L.MODEL_THRESHOLDS
    no = F.lit(False)
    spam = F.coalesce(F.col("spam_score") > t["spam"], no)
    sup = F.coalesce((F.col("supervised_label") != "benign") & (F.col("supervised_score") > t["supervised"]), no)
    sem = F.coalesce((F.col("semantic_label") != "benign") & (F.col("semantic_score") > t["semantic"]), no)
    opinion = F.coalesce(F.col("opinion_is_scam"), no)
    scam = ((spam | sup | sem) & ~F.col("negated_request")) | F.col("pattern_is_scam") | opinion

    grounded = opinion & D.type_has_evidence(F.col("opinion_type"), F.col("text"))
    kind = F.coalesce(
        F.when(spam, F.col("spam_type")),
        F.when(~F.col("pattern_type").isin(D.NON_SPECIFIC), F.col("pattern_type")),
        F.when(grounded, F.col("opinion_type")),
        F.when(sem & (F.col("semantic_margin") >= 0.15), D.lookup(F.col("semantic_label"), L.CLASSIFIER_TO_TYPE)),
        F.when(sup, D.lookup(F.col("supervised_label"), L.CLASSIFIER_TO_TYPE)),
        F.col("pattern_type"),
    )
    scam = scam | (F.col("fused") >= override_at)
    vague = kind.isNull() | kind.isin("none", "other", "UNKNOWN_SCAM")
    return df.withColumn("is_scam", scam).withColumn("scam_type", F.when(scam & vague, "OTHER_SUSPICIOUS").otherwise(kind))
