"""Whole investigations: requests with attachments, links, model layers and earlier cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from lurewatch import lexicon as L
from lurewatch.operators import investigation as V
from lurewatch.plans.detection_queries import _NEGATED, TO_PATTERN, _rx
from lurewatch.plans.inputs import MESSAGES_SQL, PAGE_URLS_SQL, TURNS_SQL, messages, page_urls, quote, sql_list, turns, with_
from lurewatch.plans.intel_queries import FIRST_SQL, INDICATORS_SQL, POSITION_SQL
from lurewatch.plans.registry import query
from lurewatch.plans.report_queries import _LABELS, SEVERITY, _case
from lurewatch.plans.url_queries import EXTRACT_SQL, LEXICAL_SQL, observe_sql

_OPINION_TYPES = ["bank_fraud", "phishing", "lottery", "investment_scam"]


def _pick(values, i):
    return F.try_element_at(F.lit(values), (i % len(values) + 1).cast("int"))


def requests(spark, sf):
    """Requests: some with links only, some with links given by the caller, some asking for an engagement."""
    k = F.col("investigation_id")
    p = page_urls(spark, sf)
    given = p.groupBy(k).agg(F.array_sort(F.collect_list("raw")).alias("own"))  # one page an id
    second = F.when(k % 3 == 0, F.array(F.concat(F.lit("http://login-paytm.help"), k.cast("string"), F.lit(".top/a")))).otherwise(F.array().cast("array<string>"))
    m = messages(spark, sf).withColumnRenamed("message_id", "investigation_id").join(given, "investigation_id", "left")
    return m.select(
        k, k.alias("seq"), F.when(k % 9 != 0, F.col("text")).alias("text"), F.when(F.col("own").isNotNull(), F.concat("own", second, "own")).alias("urls"), "ts",
        (k % 4 != 0).alias("consent"), (k % 5 == 0).alias("engagement_requested"),
        F.when(k % 10 == 0, F.array(F.lit("research:honeypot"))).alias("scopes"), (k % 7 == 0).alias("prior_confirmed_scam"))


def attachments(spark, sf):
    """What was read out of attachments (conversation turns stand in); every fourth could not be read."""
    broken = F.col("turn") % 4 == 3
    return turns(spark, sf).select(
        F.col("session_id").alias("investigation_id"), F.col("turn").cast("long").alias("seq"), F.concat(F.lit("file:"), F.col("turn").cast("string")).alias("uri"),
        F.when(~broken, F.col("text")).alias("extracted_text"), F.when(broken, F.concat(F.lit("encrypted document "), F.col("turn").cast("string"))).alias("rejection"))


def layers(spark, sf):
    """Model layers that arrive as a table, with rows for four in five requests."""
    k = F.col("investigation_id")
    opinion = k % 6 == 0
    return messages(spark, sf).select(F.col("message_id").alias("investigation_id")).filter(k % 5 != 4).select(
        k, F.when(k % 11 == 0, 0.9).alias("spam_score"), F.when(k % 22 == 0, "lottery").alias("spam_type"),
        _pick(_LABELS, k).alias("supervised_label"), ((k * 37 % 100) / 100).alias("supervised_score"),
        _pick(_LABELS, F.floor(k / 3)).alias("semantic_label"), ((k * 53 % 100) / 100).alias("semantic_score"), ((k * 7 % 30) / 100).alias("semantic_margin"),
        F.when(opinion, k % 12 == 0).alias("opinion_is_scam"), F.when(opinion, _pick(_OPINION_TYPES, F.floor(k / 6))).alias("opinion_type"),
        F.when(opinion, (k % 130) / 100).alias("opinion_confidence"), F.when(opinion, F.array(F.lit("outside view"))).alias("opinion_indicators"))


_SUP = "coalesce(supervised_label <> 'benign' AND supervised_score > 0.65, false)"
_SEM = "coalesce(semantic_label <> 'benign' AND semantic_score > 0.5, false)"
_SPAM = "coalesce(spam_score > 0.8, false)"
_OP = "coalesce(opinion_is_scam, false)"
_INGEST_SQL = (
    MESSAGES_SQL.replace("messages AS (", "sent AS (", 1), PAGE_URLS_SQL, TURNS_SQL,
    """files AS (SELECT session_id AS message_id, list('file:' || turn::VARCHAR ORDER BY turn) AS uris, list(text ORDER BY turn) FILTER (turn % 4 <> 3 AND text <> '') AS read,
  list('encrypted document ' || turn::VARCHAR ORDER BY turn) FILTER (turn % 4 = 3) AS rejections FROM turns GROUP BY session_id)""",
    """asked AS MATERIALIZED (SELECT s.message_id, CASE WHEN s.message_id % 9 <> 0 THEN text END AS text, coalesce(read, []) AS read, coalesce(rejections, []) AS rejections,
  CASE WHEN raw IS NULL THEN [] WHEN s.message_id % 3 = 0 THEN [raw, 'http://login-paytm.help' || s.message_id::VARCHAR || '.top/a', raw] ELSE [raw, raw] END AS urls, uris, s.ts
  FROM sent s LEFT JOIN files f ON f.message_id = s.message_id LEFT JOIN page_urls p ON p.investigation_id = s.message_id),
haystack AS MATERIALIZED (SELECT *, array_to_string(list_concat([coalesce(text, '')], read), chr(10)) AS text
  FROM (SELECT * EXCLUDE (text), text AS message, text FROM asked) WHERE trim(coalesce(text, '')) <> '' OR len(urls) > 0 OR len(coalesce(uris, [])) > 0)""".replace(
        "SELECT *, array_to_string", "SELECT * EXCLUDE (text), array_to_string"),
    EXTRACT_SQL.replace("FROM messages", "FROM haystack"),
    """offered AS (SELECT message_id, u, min(pos) AS pos FROM (SELECT message_id, unnest(urls) AS u, generate_subscripts(urls, 1) AS pos FROM haystack
    UNION ALL SELECT message_id, u, 1000 + rn FROM ranked WHERE rn <= 25) GROUP BY message_id, u),
links AS MATERIALIZED (SELECT message_id, u, rn FROM (SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY pos) AS rn FROM offered) WHERE rn <= 25),
linked AS (SELECT message_id, list(u ORDER BY rn) AS us FROM links GROUP BY message_id),
messages AS MATERIALIZED (SELECT h.message_id, ts, rejections, array_to_string(list_filter(list_concat([message], read, coalesce(us, [])), lambda p: trim(p) <> ''), chr(10) || chr(10)) AS text
  FROM haystack h LEFT JOIN linked l ON l.message_id = h.message_id)""",
)
_JUDGE_SQL = (
    "msg_urls AS (SELECT message_id AS investigation_id, u AS raw FROM links)", observe_sql("msg_urls"), LEXICAL_SQL,
    "link_risk AS MATERIALIZED (SELECT investigation_id AS message_id, round(max(score) * 100)::INT AS link_risk, count(*)::INT AS n_urls FROM scored GROUP BY 1)",
    _NEGATED,
    f"""given AS (SELECT message_id, CASE WHEN message_id % 11 = 0 THEN 0.9::DOUBLE END AS spam_score, CASE WHEN message_id % 22 = 0 THEN 'lottery' END AS spam_type,
  {sql_list(_LABELS)}[(message_id % {len(_LABELS)} + 1)::INT] AS supervised_label, (message_id * 37 % 100) / 100.0::DOUBLE AS supervised_score,
  {sql_list(_LABELS)}[(message_id // 3 % {len(_LABELS)} + 1)::INT] AS semantic_label, (message_id * 53 % 100) / 100.0::DOUBLE AS semantic_score, (message_id * 7 % 30) / 100.0::DOUBLE AS semantic_margin,
  CASE WHEN message_id % 6 = 0 THEN message_id % 12 = 0 END AS opinion_is_scam, CASE WHEN message_id % 6 = 0 THEN {sql_list(_OPINION_TYPES)}[(message_id // 6 % 4 + 1)::INT] END AS opinion_type,
  CASE WHEN message_id % 6 = 0 THEN (message_id % 130) / 100.0::DOUBLE END AS opinion_confidence FROM sent WHERE message_id % 5 <> 4),
heard AS MATERIALIZED (SELECT p.message_id, p.text, p.conf, p.scam_type AS pattern_type, p.is_scam AS pattern_is_scam, p.risk_score AS pattern_risk, upi, phone, acct, link, kw, n.message_id IS NOT NULL AS negated,
  g.* EXCLUDE (message_id, opinion_is_scam, opinion_type, opinion_confidence), asked_for, CASE WHEN asked_for THEN opinion_is_scam END AS opinion_is_scam,
  CASE WHEN asked_for THEN opinion_type END AS opinion_type, CASE WHEN asked_for THEN opinion_confidence END AS opinion_confidence
  FROM (SELECT *, FALSE AS nothing FROM pattern) p LEFT JOIN given g ON g.message_id = p.message_id LEFT JOIN negated n ON n.message_id = p.message_id,
  LATERAL (SELECT p.message_id % 4 <> 0 AND NOT {_SPAM} AND p.conf < 0.7 AS asked_for) AS a),
sig AS (SELECT message_id, unnest([conf, spam_score, CASE WHEN supervised_label = 'benign' THEN 0 ELSE supervised_score END, CASE WHEN semantic_label = 'benign' THEN 0 ELSE semantic_score END,
  CASE WHEN opinion_is_scam THEN greatest(least(opinion_confidence, 1.0), 0.0) WHEN opinion_is_scam IS NOT NULL THEN 0 END]) AS s, unnest([0.5, 0.3, 0.3, 0.3, 0.2]::DOUBLE[]) AS w FROM heard),
fz AS (SELECT message_id, round(sum(s * w) / sum(w), 6) AS fused FROM sig WHERE s IS NOT NULL GROUP BY message_id),
decided AS MATERIALIZED (SELECT h.*, fused, ((({_SPAM} OR {_SUP} OR {_SEM}) AND NOT negated) OR pattern_is_scam OR {_OP} OR fused >= 0.7) AS is_scam,
  coalesce(CASE WHEN {_SPAM} THEN spam_type END, CASE WHEN pattern_type NOT IN ('other', 'UNKNOWN_SCAM', 'OTHER_SUSPICIOUS') THEN pattern_type END,
    CASE WHEN {_OP} AND CASE opinion_type WHEN 'investment_scam' THEN regexp_matches(text, {_rx(L.whole(L.INVESTMENT_CONTEXT))}) WHEN 'bank_fraud' THEN regexp_matches(text, {_rx(L.whole(L.BANK_CONTEXT))})
       WHEN 'phishing' THEN contains(lower(text), 'http://') OR contains(lower(text), 'https://') ELSE true END THEN opinion_type END,
    CASE WHEN {_SEM} AND semantic_margin >= 0.15 THEN {_case('semantic_label', L.CLASSIFIER_TO_TYPE)} END, CASE WHEN {_SUP} THEN {_case('supervised_label', L.CLASSIFIER_TO_TYPE)} END, pattern_type) AS kind
  FROM heard h JOIN fz USING (message_id)),
entities AS (SELECT message_id, unnest(list_concat(list_transform(upi, lambda v: {{'k': 'upi_id', 'v': v}}), list_transform(phone, lambda v: {{'k': 'phone', 'v': v}}), list_transform(acct, lambda v: {{'k': 'bank_account', 'v': v}}),
  list_transform(link, lambda v: {{'k': 'url', 'v': v}}), list_transform(kw, lambda v: {{'k': 'keyword', 'v': v}}))) AS e FROM decided),
occurrences AS (SELECT e.message_id AS investigation_id, e.e.k AS kind, e.e.v AS value, ts, e.message_id AS seq FROM entities e JOIN messages m ON m.message_id = e.message_id)""",
    INDICATORS_SQL, FIRST_SQL.replace("firsts AS", "sighted AS"), POSITION_SQL.replace("FROM firsts", "FROM sighted"),
    "shared AS (SELECT investigation_id AS message_id, list(kind || '=' || campaign_id || '@' || round(least(0.6 + 0.1 * n_prior, 0.95)::DOUBLE, 3)::VARCHAR ORDER BY kind, campaign_id) AS matches FROM matched GROUP BY 1)",
    """judged AS (SELECT d.*, m.rejections, coalesce(link_risk, 0) AS link_risk, coalesce(n_urls, 0) AS n_urls, coalesce(matches, []) AS matches, greatest(pattern_risk, coalesce(link_risk, 0)) AS risk_score,
  is_scam OR coalesce(link_risk, 0) >= 50 AS scam, CASE WHEN is_scam AND kind IN ('none', 'other', 'UNKNOWN_SCAM') THEN 'OTHER_SUSPICIOUS' ELSE kind END AS scam_type
  FROM decided d JOIN messages m ON m.message_id = d.message_id LEFT JOIN link_risk l ON l.message_id = d.message_id LEFT JOIN shared s ON s.message_id = d.message_id)""",
)
_STAGES_SQL = f"""array_to_string(list_filter(['ingestion:ok:', CASE WHEN len(rejections) > 0 THEN 'ingestion.rejections:degraded:' || rejections[1] END, 'entities:ok:', 'threat_intel:ok:', 'detection:ok:',
  'risk_fusion:skipped:' || {quote(L.STAGE_ERRORS['risk_fusion'])},
  CASE WHEN message_id % 5 <> 0 THEN 'agent:skipped:' WHEN message_id % 10 = 0 AND (message_id % 7 = 0 OR is_scam) THEN 'agent:ok:' ELSE 'agent:skipped:' || {quote(L.STAGE_ERRORS['agent'])} END, 'protection:ok:'],
  lambda x: x IS NOT NULL), ';')"""


@query("p5_full_investigation", with_(*_INGEST_SQL, *TO_PATTERN[1:], *_JUDGE_SQL) + f"""
SELECT message_id AS investigation_id, CASE WHEN scam THEN 'scam' ELSE 'likely_safe' END AS verdict, least(risk_score, 100) AS risk_score, {SEVERITY} AS severity, round(fused, 3) AS confidence, scam_type,
  (len(upi) + len(phone) + len(acct) + len(link) + len(kw))::INT AS n_entities, n_urls, len(rejections)::INT AS n_rejections, array_to_string(matches, ';') AS matches,
  {_STAGES_SQL} AS stages, 'detection={L.DETECTION_MODEL}' AS models FROM judged""")
def full_investigation(spark, sf):
    """Requests, attachments and layers stored in the same buckets, met without a shuffle, then compared with earlier cases."""
    width = 4 * spark.sparkContext.defaultParallelism  # a bucket is a task
    t = V.lay_out({"requests": requests(spark, sf), "attachments": attachments(spark, sf), "layers": layers(spark, sf)}, width)
    core = V.lay_out({"reports": V.reports_of(t["requests"], t["attachments"], t["layers"], feature_enabled=True)}, width)["reports"]
    r = V.protect(V.with_threat_intel(core))
    match = F.transform("threat_intel", lambda m: F.concat(m["kind"], F.lit("="), m["campaign_id"], F.lit("@"), F.round(m["confidence"], 3).cast("string")))
    stage = F.transform("stage_status", lambda s: F.concat(s["stage"], F.lit(":"), s["state"], F.lit(":"), F.coalesce(s["error"], F.lit(""))))
    return r.select(
        "investigation_id", "verdict", "risk_score", "severity", "confidence", "scam_type", F.size("extracted_entities").alias("n_entities"), F.size("url_findings").alias("n_urls"),
        F.size("rejections").alias("n_rejections"), F.array_join(F.array_sort(match), ";").alias("matches"), F.array_join(stage, ";").alias("stages"),
        F.array_join(F.transform("model_metadata", lambda m: F.concat(m["stage"], F.lit("="), m["model_id"])), ";").alias("models"))
