"""Report assembly, list, guidance and rendering queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lurewatch import lexicon as L
from lurewatch.functions import detection as D
from lurewatch.functions import keys as Y
from lurewatch.functions import text as T
from lurewatch.operators import fusion as FU
from lurewatch.operators import reports as R
from lurewatch.operators import detection as P
from lurewatch.plans.detection_queries import _NEGATED, JOIN, TO_PATTERN, _rx
from lurewatch.plans.inputs import (
    EVIDENCE_SQL, INVESTIGATIONS_SQL, MESSAGES_SQL, evidence_rows, investigations, messages, quote, sql_list, with_,
)
from lurewatch.plans.registry import query, table
from lurewatch.plans.text_queries import sql_strip
from lurewatch.plans.url_queries import EXTRACT_SQL, LEXICAL_SQL, observe_sql

_FLAGS = ["urgent", "pay_now", "otp", "kyc.form", "prize (big)", "bank-alert", "link!"]
_KINDS = ["upi_id", "phone", "phone", "url"]


def reports(spark, sf):
    """Stored reports (derived from orders) with their nested parts."""
    i = investigations(spark, sf).withColumn("k", F.substring_index("id", "_", -1).cast("bigint"))
    k = F.col("k")
    kinds = F.slice(F.lit(_KINDS), F.lit(1), (k % 5).cast("int"))
    states = F.when(k % 9 == 0, "failed").when(k % 8 == 0, "degraded").otherwise("ok")
    return i.select(
        F.col("id").alias("investigation_id"), "verdict", "risk_score", D.severity(F.col("risk_score")).alias("severity"), "confidence",
        F.when(k % 10 != 0, F.col("scam_type")).alias("scam_type"),
        F.slice(F.lit(_FLAGS), F.lit(1), (k % 8).cast("int")).alias("red_flags"),
        F.transform(kinds, lambda x: F.struct(x.alias("kind"), F.concat(x, F.lit("-v")).alias("value"))).alias("extracted_entities"),
        F.array_repeat(F.lit("http://x.example/"), (k % 3).cast("int")).alias("url_findings"),
        F.array_repeat(F.lit("cmp"), F.when(k % 4 == 0, 1).otherwise(0)).alias("threat_intel"),
        F.array(F.struct(F.lit("ingestion").alias("stage"), F.lit("ok").alias("state")), F.struct(F.lit("detection").alias("stage"), states.alias("state"))).alias("stage_status"),
        F.col("created_at").alias("generated_at"), "k",
    )


SEVERITY = "CASE WHEN risk_score >= 80 THEN 'critical' WHEN risk_score >= 60 THEN 'high' WHEN risk_score >= 30 THEN 'medium' WHEN risk_score > 0 THEN 'low' ELSE 'none' END"
REPORTS_SQL = f"""reports AS (SELECT id AS investigation_id, verdict, risk_score, {SEVERITY} AS severity, confidence, CASE WHEN k % 10 <> 0 THEN scam_type END AS scam_type,
  {sql_list(_FLAGS)}[1:(k % 8)::INT] AS red_flags, {sql_list(_KINDS)}[1:(k % 5)::INT] AS kinds, (k % 3)::INT AS n_urls, CASE WHEN k % 4 = 0 THEN 1 ELSE 0 END AS n_matches,
  CASE WHEN k % 9 = 0 THEN 'failed' WHEN k % 8 = 0 THEN 'degraded' ELSE 'ok' END AS state, created_at AS generated_at, k, user_id, platform, content_type
  FROM (SELECT *, substr(id, 5)::BIGINT AS k FROM investigations))"""
TO_REPORTS = (INVESTIGATIONS_SQL, REPORTS_SQL)


def _case(column: str, mapping: dict, default: str = "NULL") -> str:
    return f"CASE {column} " + " ".join(f"WHEN {quote(k)} THEN {quote(v)}" for k, v in mapping.items()) + f" ELSE {default} END"


@query("p1_request_validity", with_(MESSAGES_SQL, "r AS (SELECT message_id, platform, CASE WHEN message_id % 3 = 0 THEN '  ' WHEN message_id % 3 = 1 THEN text END AS text, CASE WHEN message_id % 5 = 0 THEN 1 ELSE 0 END AS n_media, CASE WHEN message_id % 7 = 0 THEN 1 ELSE 0 END AS n_urls FROM messages)") + f"""
SELECT platform, (coalesce({sql_strip('text')} <> '', false) OR n_media > 0 OR n_urls > 0) AS valid, count(*) AS n FROM r GROUP BY ALL""")
def request_validity(spark, sf):
    k = F.col("message_id")
    text = F.when(k % 3 == 0, "  ").when(k % 3 == 1, F.col("text"))
    media = F.array_repeat(F.lit("m"), F.when(k % 5 == 0, 1).otherwise(0))
    urls = F.array_repeat(F.lit("u"), F.when(k % 7 == 0, 1).otherwise(0))
    return messages(spark, sf).groupBy("platform", R.has_content(text, media, urls).alias("valid")).agg(F.count("*").alias("n"))


@query("p2_analyzable_text", with_(MESSAGES_SQL, "j AS (SELECT message_id, text, html, url FROM messages LEFT JOIN pages ON page_id = message_id)") + """
SELECT message_id, md5(array_to_string(list_filter([text, html, ' ', url], lambda p: trim(p) <> ''), chr(10) || chr(10))) AS text_md5 FROM j""")
def analyzable_text(spark, sf):
    j = messages(spark, sf).join(table(spark, sf, "pages"), F.col("page_id") == F.col("message_id"), "left")
    return j.select("message_id", F.md5(R.analyzable_text(F.col("text"), F.array("html", F.lit(" ")), F.array("url"))).alias("text_md5"))


@query("p4_severity", with_(INVESTIGATIONS_SQL) + f"SELECT {SEVERITY} AS severity, count(*) AS n, min(risk_score) AS lo, max(risk_score) AS hi FROM investigations GROUP BY 1")
def severity(spark, sf):
    i = investigations(spark, sf)
    return i.groupBy(D.severity(F.col("risk_score")).alias("severity")).agg(F.count("*").alias("n"), F.min("risk_score").alias("lo"), F.max("risk_score").alias("hi"))


MSG_URLS_SQL = "msg_urls AS (SELECT message_id AS investigation_id, u AS raw, rn FROM ranked WHERE rn <= 25)"
REPORT_SQL = f"""url_risk AS MATERIALIZED (SELECT investigation_id AS message_id, round(max(score) * 100)::INT AS url_risk, count(*) AS n_urls FROM scored GROUP BY 1),
report AS MATERIALIZED (SELECT p.message_id, is_scam OR coalesce(url_risk, 0) >= 50 AS scam, greatest(risk_score, coalesce(url_risk, 0)) AS risk_score, conf, scam_type,
  upi, phone, acct, link, kw, coalesce(n_urls, 0) AS n_urls FROM pattern p LEFT JOIN url_risk u ON u.message_id = p.message_id)"""
TO_REPORT = (*TO_PATTERN, EXTRACT_SQL, MSG_URLS_SQL, observe_sql("msg_urls"), LEXICAL_SQL, REPORT_SQL)


def investigate(df, normalize: bool = True):
    """Messages to reports: clean, extract, detect, score links, assemble.  No shuffle."""
    if normalize:
        df = df.withColumn("text", T.normalize(F.col("text")))
    text = F.col("text")
    scored = df.select(F.col("message_id").alias("investigation_id"), "text", "ts", P.pattern_struct(text).alias("verdict"), R.findings_of(text).alias("urls"))
    return R.assemble(scored)


@query("p5_report_assembly", with_(*TO_REPORT) + f"""
SELECT message_id AS investigation_id, CASE WHEN scam THEN 'scam' ELSE 'likely_safe' END AS verdict, risk_score, {SEVERITY} AS severity, round(conf, 3) AS confidence,
  scam_type, (len(upi) + len(phone) + len(acct) + len(link) + len(kw))::INT AS n_entities, n_urls::INT AS n_urls FROM report""")
def report_assembly(spark, sf):
    r = investigate(messages(spark, sf), normalize=False)
    return r.select("investigation_id", "verdict", "risk_score", "severity", "confidence", "scam_type",
                    F.size("extracted_entities").alias("n_entities"), F.size("url_findings").alias("n_urls"))


@query("investigate_end_to_end")
def end_to_end(spark, sf):
    r = investigate(messages(spark, sf))
    return r.groupBy("verdict", "severity", "scam_type").agg(F.count("*").alias("n"), F.max("risk_score").alias("max_risk"))


@query("p7_p9_typed_entities", with_(*TO_PATTERN) + """
SELECT message_id, kind, value FROM (SELECT message_id, 'upi_id' AS kind, unnest(upi) AS value FROM pattern UNION ALL SELECT message_id, 'phone', unnest(phone) FROM pattern
  UNION ALL SELECT message_id, 'bank_account', unnest(acct) FROM pattern UNION ALL SELECT message_id, 'url', unnest(link) FROM pattern UNION ALL SELECT message_id, 'keyword', unnest(kw) FROM pattern)""")
def typed_entities(spark, sf):
    i = P.with_intel(messages(spark, sf))
    out = i.select("message_id", F.inline_outer(R.entity_list(F.col("intel")))).filter("kind IS NOT NULL")
    return out.select("message_id", "kind", "value")


@query("p26_comparable_value", with_(INVESTIGATIONS_SQL) + "SELECT id, coalesce(nullif(CASE WHEN risk_score % 3 = 0 THEN '' WHEN risk_score % 3 = 1 THEN upper(id) END, ''), id) AS comparable FROM investigations")
def comparable(spark, sf):
    n = F.when(F.col("risk_score") % 3 == 0, "").when(F.col("risk_score") % 3 == 1, F.upper("id"))
    return investigations(spark, sf).select("id", Y.comparable_value(n, F.col("id")).alias("comparable"))


@query("p8_degraded_reports", with_(*TO_REPORTS) + "SELECT state <> 'ok' AS is_degraded, count(*) AS n FROM reports GROUP BY 1")
def degraded(spark, sf):
    return reports(spark, sf).groupBy(R.is_degraded(F.col("stage_status")).alias("is_degraded")).agg(F.count("*").alias("n"))


@query("p9_entities_of_kind", with_(*TO_REPORTS) + "SELECT investigation_id, len(list_filter(kinds, lambda x: x = 'phone'))::INT AS n_phones FROM reports")
def of_kind(spark, sf):
    return reports(spark, sf).select("investigation_id", F.size(R.entities_of(F.col("extracted_entities"), "phone")).alias("n_phones"))


AMBIGUOUS = "(verdict IN ('suspicious', 'unknown') OR (verdict = 'scam' AND confidence < 0.5))"


@query("p10_p11_follow_up", with_(*TO_REPORTS) + f"""
SELECT investigation_id, {AMBIGUOUS} AS ambiguous, CASE WHEN {AMBIGUOUS} THEN array_to_string(list_filter([{quote(L.FOLLOW_UP_WORDING)}, CASE WHEN len(kinds) = 0 THEN {quote(L.FOLLOW_UP_ENTITIES)} END,
  CASE WHEN n_urls = 0 THEN {quote(L.FOLLOW_UP_LINK)} END], lambda x: x IS NOT NULL), '|') ELSE '' END AS questions FROM reports""")
def follow_up(spark, sf):
    amb = R.is_ambiguous(F.col("verdict"), F.col("confidence"))
    q = R.follow_up_questions(amb, F.size("extracted_entities"), F.size("url_findings"))
    return reports(spark, sf).select("investigation_id", amb.alias("ambiguous"), F.array_join(q, "|").alias("questions"))


@query("p12_explanation", with_(*TO_REPORTS) + f"""
SELECT investigation_id, CASE WHEN verdict = 'likely_safe' THEN {quote(L.SAFE_EXPLANATION)} ELSE 'This message shows signs of ' || ({_case("coalesce(scam_type, 'other')", L.SCAM_TYPE_LABELS, "'a scam'")})
  || ' (' || severity || ' risk, ' || round(confidence * 100)::INT::VARCHAR || '% confidence).' || CASE WHEN len(red_flags) > 0 THEN ' Red flags: ' || array_to_string(red_flags[1:3], ', ') || '.' ELSE '' END END AS explanation FROM reports""")
def explanation(spark, sf):
    c = F.col
    return reports(spark, sf).select("investigation_id", R.explanation(c("verdict"), c("scam_type"), c("severity"), c("confidence"), c("red_flags")).alias("explanation"))


@query("p13_j6_recommended_actions", with_(*TO_REPORTS) + f"""
SELECT investigation_id, CASE WHEN verdict = 'likely_safe' THEN {quote(L.SAFE_ACTION)} ELSE array_to_string(list_filter([{quote(L.BASE_ACTIONS[0])}, {quote(L.BASE_ACTIONS[1])},
  CASE WHEN n_urls > 0 THEN {quote(L.LINK_ACTION)} END, {_case('scam_type', L.SCAM_TYPE_ACTIONS)}, CASE WHEN n_matches > 0 THEN {quote(L.CAMPAIGN_ACTION)} END, {quote(L.REPORT_ACTION)}], lambda x: x IS NOT NULL), '|') END AS actions FROM reports""")
def actions(spark, sf):
    a = R.recommended_actions(F.col("verdict"), F.col("scam_type"), F.size("url_findings"), F.size("threat_intel"))
    return reports(spark, sf).select("investigation_id", F.array_join(a, "|").alias("actions"))


_USER_ACTIONS = ["paid", "clicked_link", "shared_otp", "shared_bank_details", "installed_app"]


@query("p14_incident_guidance", with_(INVESTIGATIONS_SQL, f"a AS (SELECT id, list_filter([{', '.join(f'CASE WHEN (risk_score + {i}) % 3 = 0 THEN {quote(n)} END' for i, n in enumerate(_USER_ACTIONS))}], lambda x: x IS NOT NULL) AS acts FROM investigations)") + f"""
SELECT id, CASE WHEN len(acts) = 0 THEN {quote(L.DEFAULT_FREEZE)} ELSE array_to_string(list_transform(acts, lambda x: {_case('x', L.FREEZE_STEPS)}), '|') END AS freeze,
  array_to_string(list_filter([{quote(L.PRESERVE[0])}, {quote(L.PRESERVE[1])}, CASE WHEN list_contains(acts, 'paid') THEN {quote(L.PAYMENT_EVIDENCE)} END,
  CASE WHEN list_contains(acts, 'installed_app') THEN {quote(L.APP_EVIDENCE)} END], lambda x: x IS NOT NULL), '|') AS preserve, {len(L.REPORT_TO)} AS n_report_to FROM a""")
def guidance(spark, sf):
    acts = F.array_compact(F.array(*[F.when((F.col("risk_score") + i) % 3 == 0, n) for i, n in enumerate(_USER_ACTIONS)]))
    g = investigations(spark, sf).select("id", R.incident_guidance(acts).alias("g"))
    return g.select("id", F.array_join("g.freeze", "|").alias("freeze"), F.array_join("g.preserve_evidence", "|").alias("preserve"), F.size("g.report_to").alias("n_report_to"))


@query("p15_owner_scope", with_(*TO_REPORTS) + "SELECT investigation_id, platform, content_type FROM reports WHERE user_id = 7 ORDER BY generated_at DESC, investigation_id LIMIT 50")
def owner_scope(spark, sf):
    out = R.recent_reports(reports(spark, sf), investigations(spark, sf), user_id=7)
    return out.select("investigation_id", "platform", "content_type")


@query("p16_a15_origin_isolation", with_(INVESTIGATIONS_SQL) + "SELECT count(*) AS visible, count(*) FILTER (verdict = 'scam') AS total_scams FROM investigations WHERE data_origin = 'honeypot_research'")
def origin_isolation(spark, sf):
    from lurewatch.operators.maintenance import research_origin

    return research_origin(investigations(spark, sf)).agg(F.count("*").alias("visible"), F.count_if(F.col("verdict") == "scam").alias("total_scams"))


@query("p17_consent_gate", with_(INVESTIGATIONS_SQL) + "SELECT count(*) FILTER (risk_score % 4 <> 0 AND risk_score < 90 AND confidence < 0.7) AS asked, count(*) AS n FROM investigations")
def consent_gate(spark, sf):
    ask = FU.wants_opinion(F.col("risk_score") % 4 != 0, F.col("risk_score") >= 90, F.col("confidence"))
    return investigations(spark, sf).agg(F.count_if(ask).alias("asked"), F.count("*").alias("n"))


@query("p18_engagement_gate", with_(INVESTIGATIONS_SQL) + "SELECT id, user_id % 2 = 0 AND user_id % 3 = 0 AND verdict = 'scam' AS may_engage FROM investigations")
def engagement_gate(spark, sf):
    scopes = F.when(F.col("user_id") % 3 == 0, F.array(F.lit("read"), F.lit("research:honeypot")))
    return investigations(spark, sf).select("id", R.may_engage(F.col("user_id") % 2 == 0, scopes, F.col("verdict") == "scam").alias("may_engage"))


@query("p19_evidence_transitions", with_(INVESTIGATIONS_SQL) + f"""
SELECT evidence_state, target, (evidence_state, target) IN ({", ".join(f"({quote(a)}, {quote(b)})" for a, b in L.EVIDENCE_TRANSITIONS)}) AS legal, count(*) AS n
FROM (SELECT *, ['ingested', 'analyzed', 'retained', 'expired', 'purged'][(risk_score % 5 + 1)::INT] AS target FROM investigations) GROUP BY ALL""")
def transitions(spark, sf):
    target = F.try_element_at(F.lit(["ingested", "analyzed", "retained", "expired", "purged"]), (F.col("risk_score") % 5 + 1).cast("int"))
    i = investigations(spark, sf).withColumn("target", target)
    return i.groupBy("evidence_state", "target", R.legal_transition(F.col("evidence_state"), F.col("target")).alias("legal")).agg(F.count("*").alias("n"))


@query("p20_dashboard_rows", with_(*TO_REPORTS) + f"""
SELECT investigation_id AS id, upper(platform) AS source, {_case('content_type', L.CONTENT_TYPE_LABELS, "'Message'")} AS type, {_case('verdict', L.VERDICT_LABELS)} AS verdict, risk_score AS risk,
  {_case('severity', L.SEVERITY_LABELS)} AS severity, round(confidence * 100)::INT AS confidence, strftime(generated_at, '%Y-%m-%d') AS date, 'Closed' AS status,
  CASE WHEN risk_score >= 61 THEN 'accent' WHEN risk_score >= 41 THEN 'accent-2' ELSE 'neutral' END AS colour FROM reports""")
def dashboard_rows(spark, sf):
    owners = investigations(spark, sf).select(F.col("id").alias("investigation_id"), "platform", "content_type")
    return R.list_row(reports(spark, sf).join(owners, "investigation_id"))


@query("p21_source_filter", with_(*TO_REPORTS) + "SELECT investigation_id AS id, risk_score AS risk FROM reports WHERE platform = 'telegram'")
def source_filter(spark, sf):
    owners = investigations(spark, sf).select(F.col("id").alias("investigation_id"), "platform", "content_type")
    rows = R.list_row(reports(spark, sf).join(owners, "investigation_id"))
    return rows.filter(F.col("source") == "TELEGRAM").select("id", "risk")


def _esc(x: str) -> str:
    return f"regexp_replace({x}, '([_*\\[\\]()~`>#+\\-=|{{}}.!])', '\\\\\\1', 'g')"


_BANNER = _case("severity", L.SEVERITY_BANNERS)


@query("p22_channel_renderings", with_(*TO_REPORTS) + f"""
SELECT investigation_id, array_to_string(list_concat(['*' || {_esc(_BANNER)} || '*', {_esc("'Risk: ' || risk_score::VARCHAR || '/100'")}],
    CASE WHEN scam_type IS NOT NULL AND verdict = 'scam' THEN [{_esc("'Type: ' || replace(scam_type, '_', ' ')")}] ELSE [] END,
    CASE WHEN len(red_flags) > 0 THEN list_concat([''], list_transform(red_flags[1:5], lambda f: '• ' || {_esc('f')})) ELSE [] END,
    CASE WHEN n_urls > 0 THEN ['', {_esc("'Links checked: ' || n_urls::VARCHAR")}] ELSE [] END,
    CASE WHEN state <> 'ok' THEN ['', {_esc("'(partial analysis — some checks were unavailable)'")}] ELSE [] END), chr(10)) AS markdown,
  array_to_string(list_concat([{_BANNER}, 'Risk: ' || risk_score::VARCHAR || '/100'],
    CASE WHEN scam_type IS NOT NULL AND verdict = 'scam' THEN ['Type: ' || replace(scam_type, '_', ' ')] ELSE [] END,
    CASE WHEN len(red_flags) > 0 THEN list_concat([''], list_transform(red_flags[1:5], lambda f: '- ' || f)) ELSE [] END,
    CASE WHEN state <> 'ok' THEN ['', '(partial analysis - some checks were unavailable)'] ELSE [] END), chr(10)) AS plain FROM reports""")
def renderings(spark, sf):
    r = reports(spark, sf)
    return r.select("investigation_id", R.to_markdown(r).alias("markdown"), R.to_plain(r).alias("plain"))


@query("p23_threat_bars", with_(*TO_REPORTS) + """
SELECT investigation_id, CASE WHEN len(red_flags) = 0 THEN 'No strong red flags detected=' || p::VARCHAR || ';—=0'
  WHEN len(red_flags) = 1 THEN red_flags[1] || '=' || greatest(20, p)::VARCHAR || ';—=0'
  ELSE array_to_string(list_transform(red_flags[1:5], lambda f, i: f || '=' || greatest(20, p - (i - 1) * 5)::VARCHAR), ';') END AS bars
FROM (SELECT *, round(confidence * 100)::INT AS p FROM reports)""")
def bars(spark, sf):
    b = R.threat_bars(F.col("red_flags"), F.col("confidence"))
    text = F.array_join(F.transform(b, lambda x: F.concat(x["label"], F.lit("="), x["pct"].cast("string"))), ";")
    return reports(spark, sf).select("investigation_id", text.alias("bars"))


@query("o1_j2_recent_reports", with_(*TO_REPORTS) + "SELECT investigation_id, platform, content_type, risk_score FROM reports ORDER BY generated_at DESC, investigation_id LIMIT 50")
def recent(spark, sf):
    return R.recent_reports(reports(spark, sf), investigations(spark, sf)).select("investigation_id", "platform", "content_type", "risk_score")


@query("o8_dashboard_recent_five", with_(*TO_REPORTS) + "SELECT investigation_id, risk_score FROM reports ORDER BY generated_at DESC, investigation_id LIMIT 5")
def recent_five(spark, sf):
    return R.recent_reports(reports(spark, sf), investigations(spark, sf), limit=5).select("investigation_id", "risk_score")


@query("j2_reports_with_owner", with_(*TO_REPORTS) + "SELECT c_mktsegment, platform, count(*) AS n, sum(risk_score)::BIGINT AS risk FROM reports JOIN customer ON c_custkey = user_id GROUP BY ALL")
def with_owner(spark, sf):
    owners = investigations(spark, sf).select(F.col("id").alias("investigation_id"), "platform", "user_id")
    users = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), "c_mktsegment")
    j = reports(spark, sf).join(owners, "investigation_id").join(users, "user_id")
    return j.groupBy("c_mktsegment", "platform").agg(F.count("*").alias("n"), F.sum("risk_score").alias("risk"))


@query("j3_a6_master_intel", with_(INVESTIGATIONS_SQL, EVIDENCE_SQL) + """
SELECT DISTINCT kind, value FROM evidence WHERE investigation_id IN (SELECT id FROM investigations WHERE data_origin = 'honeypot_research')""")
def master_intel(spark, sf):
    from lurewatch.operators.maintenance import master_intel as collect

    return collect(evidence_rows(spark, sf), investigations(spark, sf))


@query("a16_dashboard_counts", with_(INVESTIGATIONS_SQL) + "SELECT count(*) AS total, count(*) FILTER (verdict NOT IN ('likely_safe', 'unknown')) AS threats, count(*) FILTER (risk_score >= 60) AS high_risk FROM investigations")
def dashboard_counts(spark, sf):
    return R.dashboard_counts(investigations(spark, sf))


@query("a20_under_evidenced_kinds", with_(INVESTIGATIONS_SQL, EVIDENCE_SQL) + f"""
SELECT investigation_id, kind FROM evidence JOIN investigations ON id = investigation_id WHERE {AMBIGUOUS} GROUP BY investigation_id, kind HAVING count(*) < 2""")
def under_evidenced(spark, sf):
    amb = investigations(spark, sf).filter(R.is_ambiguous(F.col("verdict"), F.col("confidence"))).select(F.col("id").alias("investigation_id"))
    return R.under_evidenced(evidence_rows(spark, sf), amb)


@query("fj2_report_json", with_(*TO_REPORTS) + "SELECT investigation_id, risk_score, array_to_string(red_flags, ',') AS flags, len(kinds)::INT AS n_entities FROM reports")
def report_json(spark, sf):
    """Report to its JSON payload and back."""
    r = reports(spark, sf).drop("k")
    payload = r.select(F.to_json(F.struct("*")).alias("payload"))
    back = payload.select(F.from_json("payload", r.schema).alias("r"))
    return back.select("r.investigation_id", "r.risk_score", F.array_join("r.red_flags", ",").alias("flags"), F.size("r.extracted_entities").alias("n_entities"))


# -- decision over several layers ---------------------------------------------

_LABELS = ["benign", *L.CLASSIFIER_TO_TYPE]
_LAYERS_SQL = f"""layers AS MATERIALIZED (SELECT p.message_id, p.text, conf, p.scam_type AS pattern_type, is_scam AS pattern_is_scam, n.message_id IS NOT NULL AS negated,
  CASE WHEN p.message_id % 10 = 0 THEN 0.9::DOUBLE END AS spam_score, CASE WHEN p.message_id % 20 = 0 THEN 'lottery' END AS spam_type,
  {sql_list(_LABELS)}[(p.message_id % {len(_LABELS)} + 1)::INT] AS supervised_label, (p.message_id * 37 % 100) / 100.0::DOUBLE AS supervised_score,
  {sql_list(_LABELS)}[(p.message_id // 3 % {len(_LABELS)} + 1)::INT] AS semantic_label, (p.message_id * 53 % 100) / 100.0::DOUBLE AS semantic_score, (p.message_id * 7 % 30) / 100.0::DOUBLE AS semantic_margin,
  CASE WHEN p.message_id % 6 = 0 THEN p.message_id % 12 = 0 END AS opinion_is_scam, CASE WHEN p.message_id % 6 = 0 THEN ['bank_fraud', 'phishing', 'lottery', 'investment_scam'][(p.message_id // 6 % 4 + 1)::INT] END AS opinion_type
  FROM pattern p LEFT JOIN negated n ON n.message_id = p.message_id),
sig AS (SELECT message_id, unnest([conf, spam_score, CASE WHEN supervised_label = 'benign' THEN 0 ELSE supervised_score END, CASE WHEN semantic_label = 'benign' THEN 0 ELSE semantic_score END]) AS s,
  unnest([0.5, 0.3, 0.3, 0.3]::DOUBLE[]) AS w FROM layers),
fz AS (SELECT message_id, round(sum(s * w) / sum(w), 6) AS fused FROM sig WHERE s IS NOT NULL GROUP BY message_id)"""


def layers(spark, sf):
    """Pattern verdict side by side with the layers that arrive as tables."""
    k = F.col("message_id")

    def pick(values, i):
        return F.try_element_at(F.lit(values), (i % len(values) + 1).cast("int"))

    p = P.pattern_verdict(messages(spark, sf)).select(
        "message_id", "text", "pattern_confidence", F.col("scam_type").alias("pattern_type"), F.col("is_scam").alias("pattern_is_scam"), "negated_request"
    )
    return p.select(
        "*", F.when(k % 10 == 0, 0.9).alias("spam_score"), F.when(k % 20 == 0, "lottery").alias("spam_type"),
        pick(_LABELS, k).alias("supervised_label"), ((k * 37 % 100) / 100).alias("supervised_score"),
        pick(_LABELS, F.floor(k / 3)).alias("semantic_label"), ((k * 53 % 100) / 100).alias("semantic_score"), ((k * 7 % 30) / 100).alias("semantic_margin"),
        F.when(k % 6 == 0, k % 12 == 0).alias("opinion_is_scam"),
        F.when(k % 6 == 0, pick(["bank_fraud", "phishing", "lottery", "investment_scam"], F.floor(k / 6))).alias("opinion_type"),
    )


def fused_layers(df, use=("spam", "supervised", "semantic")):
    """Fuse the layers present in one row: same arithmetic as the grouped form, no shuffle."""
    zero = {n: F.when(F.col(f"{n}_label") == "benign", 0.0).otherwise(F.col(f"{n}_score")) for n in ("supervised", "semantic")}
    parts = [(F.col("pattern_confidence"), L.FUSION_WEIGHTS["pattern"])]
    parts += [(zero.get(n, F.col(f"{n}_score")), L.FUSION_WEIGHTS["ml_text"]) for n in use]
    num = sum((F.coalesce(s * w, F.lit(0.0)) for s, w in parts), F.lit(0.0))
    den = sum((F.when(s.isNotNull(), w).otherwise(0.0) for s, w in parts), F.lit(0.0))
    return df.withColumn("fused", F.round(num / den, 6))


_SUP = "coalesce(supervised_label <> 'benign' AND supervised_score > 0.65, false)"
_SEM = "coalesce(semantic_label <> 'benign' AND semantic_score > 0.5, false)"
_SPAM = "coalesce(spam_score > 0.8, false)"
_OP = "coalesce(opinion_is_scam, false)"


@query("fc6_final_decision", with_(*TO_PATTERN, _NEGATED, _LAYERS_SQL, f"""k1 AS (SELECT l.*, fused, ((({_SPAM} OR {_SUP} OR {_SEM}) AND NOT negated) OR pattern_is_scam OR {_OP} OR fused >= 0.7) AS is_scam,
  coalesce(CASE WHEN {_SPAM} THEN spam_type END, CASE WHEN pattern_type NOT IN ('other', 'UNKNOWN_SCAM', 'OTHER_SUSPICIOUS') THEN pattern_type END,
    CASE WHEN {_OP} AND CASE opinion_type WHEN 'investment_scam' THEN regexp_matches(text, {_rx(L.whole(L.INVESTMENT_CONTEXT))}) WHEN 'bank_fraud' THEN regexp_matches(text, {_rx(L.whole(L.BANK_CONTEXT))})
       WHEN 'phishing' THEN contains(lower(text), 'http://') OR contains(lower(text), 'https://') ELSE true END THEN opinion_type END,
    CASE WHEN {_SEM} AND semantic_margin >= 0.15 THEN {_case('semantic_label', L.CLASSIFIER_TO_TYPE)} END, CASE WHEN {_SUP} THEN {_case('supervised_label', L.CLASSIFIER_TO_TYPE)} END, pattern_type) AS kind
  FROM layers l JOIN fz USING (message_id))""") + """
SELECT message_id, is_scam, CASE WHEN is_scam AND kind IN ('none', 'other', 'UNKNOWN_SCAM') THEN 'OTHER_SUSPICIOUS' ELSE kind END AS scam_type, fused FROM k1""")
def final_decision(spark, sf):
    return FU.decide(fused_layers(layers(spark, sf))).select("message_id", "is_scam", "scam_type", "fused")


@query("fc11_single_layer_decision", with_(*TO_PATTERN, _NEGATED, _LAYERS_SQL) + f"""
SELECT message_id, (({_SUP} AND NOT negated) OR pattern_is_scam OR round((conf * 0.5 + (CASE WHEN supervised_label = 'benign' THEN 0 ELSE supervised_score END) * 0.3) / 0.8, 6) >= 0.7) AS combined_words,
  (({_SEM} AND NOT negated) OR pattern_is_scam OR round((conf * 0.5 + (CASE WHEN semantic_label = 'benign' THEN 0 ELSE semantic_score END) * 0.3) / 0.8, 6) >= 0.7) AS combined_vectors FROM layers""")
def single_layer(spark, sf):
    """Architecture comparison: one text classifier at a time next to the rules."""
    df = layers(spark, sf)
    flags = {}
    for name, out in (("supervised", "combined_words"), ("semantic", "combined_vectors")):
        own = (F.col(f"{name}_label") != "benign") & (F.col(f"{name}_score") > L.MODEL_THRESHOLDS[name])
        df = fused_layers(df, use=(name,)).withColumnRenamed("fused", f"fused_{name}")
        flags[out] = (own & ~F.col("negated_request")) | F.col("pattern_is_scam") | (F.col(f"fused_{name}") >= 0.7)
    return df.select("message_id", *[c.alias(n) for n, c in flags.items()])


@query("fc8_confidence_bucket", with_(INVESTIGATIONS_SQL) + "SELECT CASE WHEN confidence >= 0.75 THEN 'High' WHEN confidence >= 0.45 THEN 'Medium' ELSE 'Low' END AS bucket, count(*) AS n FROM investigations GROUP BY 1")
def confidence_bucket(spark, sf):
    return investigations(spark, sf).groupBy(D.confidence_bucket(F.col("confidence")).alias("bucket")).agg(F.count("*").alias("n"))
