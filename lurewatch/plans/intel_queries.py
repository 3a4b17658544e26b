"""Fusion, correlation, campaign and reputation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lurewatch import lexicon as L
from lurewatch.functions import keys as Y
from lurewatch.operators import fusion as FU
from lurewatch.operators import intel as I
from lurewatch.plans.inputs import OCCURRENCES_SQL, SIGHTINGS_SQL, SIGNALS_SQL, occurrences, quote, sightings, signals, with_
from lurewatch.plans.registry import query, table

_W = "CASE source " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in L.FUSION_WEIGHTS.items()) + " ELSE 0.0 END::DOUBLE"
WEIGHTED_SQL = f"weighted AS (SELECT *, {_W} AS weight FROM signals)"


@query("j8_attach_weights", with_(SIGNALS_SQL, WEIGHTED_SQL) + "SELECT source, weight, count(*) AS n FROM weighted GROUP BY source, weight")
def attach_weights(spark, sf):
    return FU.attach_weights(signals(spark, sf)).groupBy("source", "weight").agg(F.count("*").alias("n"))


FUSED_SQL = """fused AS (SELECT investigation_id, coalesce(sum(CASE WHEN weight > 0 THEN score * weight END) / sum(CASE WHEN weight > 0 THEN weight END), 0) AS risk_score,
  array_to_string(list(DISTINCT source ORDER BY source) FILTER (weight > 0), ',') AS sources, count(*) FILTER (weight > 0) AS n_contributing, count(*) AS n_signals
  FROM weighted GROUP BY investigation_id)"""


@query("a1_risk_fusion", with_(SIGNALS_SQL, WEIGHTED_SQL, FUSED_SQL) + """
SELECT investigation_id, round(risk_score, 9) AS risk_score, coalesce(sources, '') AS sources, n_contributing, n_signals FROM fused""")
def risk_fusion(spark, sf):
    f = FU.fuse(FU.attach_weights(signals(spark, sf)), digits=9)
    return f.select("investigation_id", "risk_score", F.array_join("contributing_sources", ",").alias("sources"), "n_contributing", "n_signals")


_OPINIONS = """op AS (SELECT o_orderkey, ['unknown', 'likely_safe', 'suspicious', 'scam'][(o_orderkey % 4 + 1)::INT] AS verdict, (o_orderkey % 101)::INT AS risk_score,
  (o_orderkey % 100) / 100.0::DOUBLE AS confidence, o_orderkey % 5 <> 0 AS deterministic,
  CASE WHEN o_orderkey % 6 <> 0 THEN ['scam', 'suspicious', 'likely_safe', 'unknown'][(o_custkey % 4 + 1)::INT] END AS o_verdict, (o_custkey % 101)::INT AS o_risk_score,
  (o_custkey % 100) / 100.0::DOUBLE AS o_confidence, CASE WHEN o_orderkey % 2 = 0 THEN 'because' ELSE '' END AS o_rationale FROM orders),
rk AS (SELECT *, list_position(['unknown', 'likely_safe', 'suspicious', 'scam'], verdict) AS a, list_position(['unknown', 'likely_safe', 'suspicious', 'scam'], o_verdict) AS b FROM op),
cs AS (SELECT *, CASE WHEN o_verdict IS NULL THEN 'none' WHEN b > a OR (b = a AND o_risk_score > risk_score) THEN 'raised' WHEN b = a AND o_risk_score = risk_score THEN 'agreed'
  WHEN deterministic AND confidence >= 0.6 THEN 'shielded' WHEN o_confidence < 0.8 THEN 'unsure' ELSE 'lowered' END AS c FROM rk)"""


@query("j7_fp1_override_policy", f"WITH {_OPINIONS}" + """
SELECT o_orderkey, CASE WHEN c IN ('raised', 'lowered') THEN o_verdict ELSE verdict END AS verdict,
  CASE c WHEN 'raised' THEN greatest(risk_score, o_risk_score) WHEN 'lowered' THEN o_risk_score ELSE risk_score END AS risk_score, c IN ('raised', 'lowered') AS overridden,
  CASE c WHEN 'none' THEN 'no llm opinion' WHEN 'raised' THEN 'llm raised risk (always permitted)' WHEN 'agreed' THEN 'llm agreed with evidence'
    WHEN 'shielded' THEN 'blocked: deterministic evidence at ' || printf('%.2f', confidence) || ' confidence cannot be lowered by the llm'
    WHEN 'unsure' THEN 'blocked: llm confidence ' || printf('%.2f', o_confidence) || ' below 0.80 required to lower risk'
    ELSE 'permitted: low-confidence evidence (' || printf('%.2f', confidence) || ') lowered by llm at ' || printf('%.2f', o_confidence) || CASE WHEN o_rationale <> '' THEN ' — ' || o_rationale ELSE '' END END AS reason
FROM cs""")
def override_policy(spark, sf):
    o = table(spark, sf, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    names = ["unknown", "likely_safe", "suspicious", "scam"]

    def pick(values, i):
        return F.try_element_at(F.lit(values), (i % 4 + 1).cast("int"))

    evidence = o.select("o_orderkey", pick(names, k).alias("verdict"), (k % 101).cast("int").alias("risk_score"),
                        ((k % 100) / 100).alias("confidence"), (k % 5 != 0).alias("deterministic"))
    opinions = o.filter("o_orderkey % 6 <> 0").select(
        "o_orderkey", pick(names[::-1], c).alias("o_verdict"), (c % 101).cast("int").alias("o_risk_score"),
        ((c % 100) / 100).alias("o_confidence"), F.when(k % 2 == 0, "because").otherwise("").alias("o_rationale"),
    )
    out = FU.resolve_opinion(evidence.join(opinions, "o_orderkey", "left"))
    return out.select("o_orderkey", "verdict", "risk_score", "overridden", "reason")


# -- correlation -------------------------------------------------------------

_KINDS = ", ".join(quote(k) for k in L.CORRELATABLE_KINDS)
INDICATORS_SQL = f"""norm AS (SELECT *, CASE WHEN kind IN ('phone', 'bank_account', 'upi_id') THEN regexp_replace(lower(value), '[^a-z0-9]+', '', 'g') ELSE lower(trim(value)) END AS normalized
   FROM occurrences WHERE kind IN ({_KINDS})),
ind AS (SELECT *, sha256(kind || ':' || normalized) AS value_hash FROM norm WHERE normalized <> '')"""
FIRST_SQL = """firsts AS (SELECT investigation_id, kind, normalized, value_hash, arg_min(value, seq) AS value, min(ts) AS ts, min(seq) AS seq FROM ind GROUP BY ALL)"""
POSITION_SQL = """pos AS (SELECT *, row_number() OVER w AS position, min(ts) OVER w AS first_seen FROM firsts
  WINDOW w AS (PARTITION BY kind, value_hash ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
matched AS (SELECT *, position - 1 AS n_prior, 'cmp_' || left(sha256(kind || '|' || value_hash), 32) AS campaign_id FROM pos WHERE position > 1)"""
TO_IND = (OCCURRENCES_SQL, INDICATORS_SQL)
TO_MATCH = (*TO_IND, FIRST_SQL, POSITION_SQL)


def _ind(spark, sf):
    return I.indicators(occurrences(spark, sf))


def us(col):
    return F.unix_micros(col)


@query("fh1_correlatable_kinds", with_(OCCURRENCES_SQL) + f"SELECT kind, kind IN ({_KINDS}) AS correlatable, count(*) AS n FROM occurrences GROUP BY ALL")
def correlatable_kinds(spark, sf):
    return occurrences(spark, sf).groupBy("kind", Y.is_correlatable(F.col("kind")).alias("correlatable")).agg(F.count("*").alias("n"))


@query("fh2_fh3_indicator_keys", with_(*TO_IND) + "SELECT seq, kind, normalized, value_hash FROM ind")
def indicator_keys(spark, sf):
    return _ind(spark, sf).select("seq", "kind", "normalized", "value_hash")


@query("fh4_j5_distinct_indicators", with_(*TO_IND, FIRST_SQL) + "SELECT investigation_id, kind, normalized, value, seq FROM firsts")
def distinct_indicators(spark, sf):
    return I.first_occurrences(_ind(spark, sf)).select("investigation_id", "kind", "normalized", "value", "seq")


@query("a2_indicator_rollup", with_(*TO_IND) + """
SELECT kind, value_hash, epoch_us(min(ts)) AS first_seen_us, epoch_us(max(ts)) AS last_seen_us, count(*) AS occurrence_count FROM ind GROUP BY kind, value_hash""")
def indicator_rollup(spark, sf):
    r = I.rollup(_ind(spark, sf))
    return r.select("kind", "value_hash", us("first_seen").alias("first_seen_us"), us("last_seen").alias("last_seen_us"), "occurrence_count")


@query("j1_w1_w2_correlation", with_(*TO_MATCH) + """
SELECT investigation_id, kind, value, n_prior, epoch_us(first_seen) AS first_seen_us, round(least(0.6 + 0.1 * n_prior, 0.95)::DOUBLE, 6) AS confidence,
  round(least(0.6 + 0.1 * n_prior, 1.0)::DOUBLE, 6) AS score, campaign_id FROM matched""")
def correlation(spark, sf):
    return I.correlate(_ind(spark, sf)).select(
        "investigation_id", "kind", "value", "n_prior", us("first_seen").alias("first_seen_us"), F.round("confidence", 6).alias("confidence"),
        F.round("score", 6).alias("score"), "campaign_id",
    )


@query("j1_matches_of_one_case", with_(*TO_IND, FIRST_SQL) + """
SELECT o.investigation_id, o.kind, o.value, o.seq FROM firsts o JOIN firsts m ON m.investigation_id = 'inv_7' AND o.kind = m.kind AND o.value_hash = m.value_hash
  AND o.investigation_id <> 'inv_7' AND (o.ts, o.seq) < (m.ts, m.seq)""")
def matches_of_one(spark, sf):
    return I.matches_of(_ind(spark, sf), "inv_7").select("investigation_id", "kind", "value", "seq")


@query("a3_campaigns", with_(*TO_MATCH) + """
SELECT campaign_id, kind, kind || ':' || left(value, 64) AS name, epoch_us(ts) AS created_us FROM matched WHERE position = 2""")
def campaigns(spark, sf):
    return I.campaigns(_ind(spark, sf)).select("campaign_id", "kind", "name", us("created_at").alias("created_us"))


@query("a4_campaign_stats", with_(*TO_MATCH) + """
SELECT campaign_id, count(DISTINCT value_hash) AS indicators, count(DISTINCT investigation_id) AS investigations,
  count(DISTINCT CASE WHEN kind = 'domain' THEN value_hash END) AS domains, count(DISTINCT CASE WHEN kind = 'phone' THEN value_hash END) AS phones FROM matched GROUP BY campaign_id""")
def campaign_stats(spark, sf):
    return I.campaign_stats(I.correlate(_ind(spark, sf)))


@query("a4_entity_stats", with_(*TO_IND) + """
SELECT kind, normalized, epoch_us(min(ts)) AS first_seen_us, epoch_us(max(ts)) AS last_seen_us, count(DISTINCT investigation_id) AS related FROM ind GROUP BY kind, normalized""")
def entity_stats(spark, sf):
    e = I.entity_stats(_ind(spark, sf))
    return e.select("kind", "normalized", us("first_seen").alias("first_seen_us"), us("last_seen").alias("last_seen_us"), "related")


@query("a21_intel_drilldown", with_(*TO_MATCH) + """
SELECT investigation_id, count(*) AS n_matches, count(DISTINCT campaign_id) AS n_campaigns,
  count(*)::VARCHAR || ' indicator(s) correlate with prior investigations across ' || count(DISTINCT campaign_id)::VARCHAR || ' known campaign(s).' AS summary FROM matched GROUP BY investigation_id""")
def drilldown(spark, sf):
    from lurewatch.operators.reports import intel_drilldown

    return intel_drilldown(I.correlate(_ind(spark, sf)))


@query("j11_campaign_lookup", with_(*TO_MATCH) + """
, first_match AS (SELECT investigation_id, arg_min(campaign_id, (ts, kind, value_hash)) AS campaign_id FROM matched GROUP BY investigation_id)
SELECT investigation_id, f.campaign_id, c.name FROM first_match f JOIN (SELECT campaign_id, kind || ':' || left(value, 64) AS name FROM matched WHERE position = 2) c USING (campaign_id)""")
def campaign_lookup(spark, sf):
    ind = _ind(spark, sf)
    first = I.correlate(ind).groupBy("investigation_id").agg(F.min_by("campaign_id", F.struct("ts", "kind", "value_hash")).alias("campaign_id"))
    return first.join(I.campaigns(ind).select("campaign_id", "name"), "campaign_id").select("investigation_id", "campaign_id", "name")


# -- reputation --------------------------------------------------------------

EMA_SQL = """dist AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY ts DESC, seq DESC) AS d, count(*) OVER (PARTITION BY domain) AS n FROM sightings),
ema AS (SELECT domain, sum(CASE WHEN d = n THEN 1.0 ELSE 0.3 END * power(0.7, d - 1) * lexical_score) AS reputation_score, count(*) AS sightings FROM dist GROUP BY domain)"""


@query("a5_domain_reputation", with_(SIGHTINGS_SQL, EMA_SQL) + "SELECT domain, round(reputation_score + 1e-9, 6) AS reputation_score, sightings, sightings > 1 AS is_repeat FROM ema")
def domain_reputation(spark, sf):
    return I.reputation(sightings(spark, sf)).select("domain", F.round(F.col("reputation_score") + 1e-9, 6).alias("reputation_score"), "sightings", "is_repeat")


@query("w3_sighting_positions", with_(SIGHTINGS_SQL) + """
SELECT domain, seq, row_number() OVER (PARTITION BY domain ORDER BY ts, seq) AS position, row_number() OVER (PARTITION BY domain ORDER BY ts, seq) > 1 AS is_repeat FROM sightings""")
def sighting_positions(spark, sf):
    return I.with_repeat_flag(sightings(spark, sf)).select("domain", "seq", "position", "is_repeat")


@query("x5_combined_reputation", with_(SIGHTINGS_SQL, EMA_SQL, "ext AS (SELECT DISTINCT 'site' || (p_partkey % 60)::VARCHAR || '.example' AS domain, (p_partkey % 60) / 60.0::DOUBLE AS score FROM part)") + """
SELECT domain, round(least(greatest(reputation_score, score), 1.0) + 1e-9, 6) AS score, CASE WHEN sightings > 1 THEN 0.6 ELSE 0.4 END::DOUBLE AS confidence,
  'domain_reputation:' || domain AS label FROM ema LEFT JOIN ext USING (domain) WHERE greatest(reputation_score, score) > 0""")
def combined_reputation(spark, sf):
    p = table(spark, sf, "part")
    ext = p.select(F.concat(F.lit("site"), (F.col("p_partkey") % 60).cast("string"), F.lit(".example")).alias("domain"), ((F.col("p_partkey") % 60) / 60.0).alias("score")).distinct()
    out = I.reputation_signal(I.reputation(sightings(spark, sf)), ext)
    return out.select("domain", F.round(F.col("score") + 1e-9, 6).alias("score"), "confidence", "label")
