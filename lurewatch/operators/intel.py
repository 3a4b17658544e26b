"""Cross-investigation correlation, campaigns and domain reputation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lurewatch.functions import keys as Y
from lurewatch.operators.ordering import ranked, running

EMA_ALPHA = 0.3


def indicators(entities: DataFrame) -> DataFrame:
    """Correlatable entities with their normalised value and hash; blanks dropped.

    Needs ``investigation_id, kind, value, ts, seq`` and optionally
    ``normalized_value``; ``seq`` makes the order unique.
    """
    given = F.col("normalized_value") if "normalized_value" in entities.columns else F.lit(None).cast("string")
    out = entities.filter(Y.is_correlatable(F.col("kind")))
    out = out.withColumn("normalized", Y.normalize_indicator(F.col("kind"), Y.comparable_value(given, F.col("value"))))
    return out.filter("normalized <> ''").withColumn("value_hash", Y.indicator_hash(F.col("kind"), F.col("normalized")))


def first_occurrences(ind: DataFrame) -> DataFrame:
    """One row per (investigation, indicator): its earliest mention."""
    return ind.groupBy("investigation_id", "kind", "normalized", "value_hash").agg(
        F.min_by("value", F.struct("ts", "seq")).alias("value"), F.min(F.struct("ts", "seq")).alias("__at")
    ).select("*", "__at.ts", "__at.seq").drop("__at")


def rollup(ind: DataFrame) -> DataFrame:
    """First and last sight and number of calls per indicator (repeats count)."""
    return ind.groupBy("kind", "value_hash").agg(
        F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count(F.lit(1)).alias("occurrence_count")
    )


def campaign_id(kind: Column, value_hash: Column) -> Column:
    """Reproducible id: a campaign belongs to exactly one indicator."""
    return F.concat(F.lit("cmp_"), F.left(F.sha2(F.concat_ws("|", kind, value_hash), 256), F.lit(32)))


def correlate(ind: DataFrame) -> DataFrame:
    """Matches of every occurrence against earlier ones of other investigations.

    Pairs are never formed: an occurrence's matches are fully described by how
    many came before it, so a shared indicator costs its rows once, not squared.
    Rows without an earlier occurrence carry no match.
    """
    occ = running(
        first_occurrences(ind), ["kind", "value_hash"], ["ts", "seq"],
        position=("count", F.lit(1)), first_seen=("min", F.col("ts")),
    )
    prior = F.col("position") - 1
    return occ.filter("position > 1").select(
        "investigation_id", "kind", "value", "value_hash", "ts", "first_seen", prior.alias("n_prior"),
        F.least(F.lit(0.6) + 0.1 * prior, F.lit(0.95)).alias("confidence"),
        F.least(F.lit(0.6) + 0.1 * prior, F.lit(1.0)).alias("score"),
        campaign_id(F.col("kind"), F.col("value_hash")).alias("campaign_id"),
    )


def matches_of(ind: DataFrame, investigation_id: str) -> DataFrame:
    """The individual earlier occurrences behind one investigation's matches."""
    occ = first_occurrences(ind)
    mine = occ.filter(F.col("investigation_id") == investigation_id).select(
        "kind", "value_hash", F.col("ts").alias("__ts"), F.col("seq").alias("__seq")
    )
    other = occ.filter(F.col("investigation_id") != investigation_id)
    earlier = F.struct("ts", "seq") < F.struct(F.col("__ts").alias("ts"), F.col("__seq").alias("seq"))
    return other.join(mine, ["kind", "value_hash"]).filter(earlier).drop("__ts", "__seq")


def campaigns(ind: DataFrame) -> DataFrame:
    """One campaign per indicator shared by two investigations, named after the second."""
    second = ranked(first_occurrences(ind), ["kind", "value_hash"], ["ts", "seq"], "position").filter("position = 2")
    return second.select(
        campaign_id(F.col("kind"), F.col("value_hash")).alias("campaign_id"), "kind", "value_hash",
        F.concat(F.col("kind"), F.lit(":"), F.left("value", F.lit(64))).alias("name"),
        F.concat(F.lit("Correlated via shared "), F.col("kind"), F.lit(" indicator across investigations.")).alias("description"),
        F.col("ts").alias("created_at"),
    )


def campaign_stats(matches: DataFrame) -> DataFrame:
    """Investigations, indicators, domains and phones per campaign (matched rows)."""
    per_value = matches.groupBy("campaign_id", "kind", "value_hash").agg(F.count(F.lit(1)).alias("n"))
    per_inv = matches.select("campaign_id", "investigation_id").distinct().groupBy("campaign_id").agg(F.count(F.lit(1)).alias("investigations"))
    shape = per_value.groupBy("campaign_id").agg(
        F.count(F.lit(1)).alias("indicators"), F.count_if(F.col("kind") == "domain").alias("domains"),
        F.count_if(F.col("kind") == "phone").alias("phones"),
    )
    return shape.join(per_inv, "campaign_id")


def entity_stats(ind: DataFrame) -> DataFrame:
    """First and last sight and number of related investigations per entity."""
    per = ind.groupBy("kind", "normalized", "investigation_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    return per.groupBy("kind", "normalized").agg(
        F.min("a").alias("first_seen"), F.max("b").alias("last_seen"), F.count(F.lit(1)).alias("related")
    )


def reputation(sightings: DataFrame, alpha: float = EMA_ALPHA) -> DataFrame:
    """Exponential moving average of a domain's scores; the first one initialises it.

    Needs ``domain, lexical_score, ts, seq``.  Written as a weighted sum over
    the distance from the latest sighting, so it combines before the shuffle.
    """
    keep = 1 - alpha
    latest_first = ranked(sightings, ["domain"], ["ts", "seq"], "distance", descending=True)
    agg = latest_first.groupBy("domain").agg(
        F.sum(alpha * F.pow(F.lit(keep), F.col("distance") - 1) * F.col("lexical_score")).alias("__s"),
        F.min_by("lexical_score", F.struct("ts", "seq")).alias("__first"), F.count(F.lit(1)).alias("sightings"),
        F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"),
    )
    score = F.col("__s") + keep * F.pow(F.lit(keep), F.col("sightings") - 1) * F.col("__first")
    return agg.select("domain", score.alias("reputation_score"), "sightings", (F.col("sightings") > 1).alias("is_repeat"), "first_seen", "last_seen")


def with_repeat_flag(sightings: DataFrame) -> DataFrame:
    """Position of every sighting within its domain and whether it is a repeat."""
    return ranked(sightings, ["domain"], ["ts", "seq"], "position").withColumn("is_repeat", F.col("position") > 1)


def reputation_signal(rep: DataFrame, external: DataFrame) -> DataFrame:
    """The larger of own and outside reputation; no row where neither says anything."""
    joined = rep.join(external.select("domain", F.col("score").alias("__ext")), "domain", "left")
    combined = F.greatest("reputation_score", "__ext")
    return joined.filter(combined > 0).select(
        "domain", F.lit("threat_intel").alias("source"), F.least(combined, F.lit(1.0)).alias("score"),
        F.concat(F.lit("domain_reputation:"), F.col("domain")).alias("label"),
        F.when(F.col("is_repeat"), 0.6).otherwise(0.4).alias("confidence"),
    )
