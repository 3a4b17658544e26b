"""Keyword, entity, behaviour and verdict queries over the message table."""

from __future__ import annotations

from pyspark.sql import functions as F

from lurewatch import lexicon as L
from lurewatch.functions import behaviour as B
from lurewatch.functions import detection as D
from lurewatch.functions import entities as E
from lurewatch.functions import keywords as K
from lurewatch.functions import text as T
from lurewatch.operators import detection as P
from lurewatch.plans.inputs import MESSAGES_SQL, messages, quote, with_
from lurewatch.plans.registry import query, table
from lurewatch.plans.text_queries import SENTENCES_SQL

SP, W = L.SPACE, L.WORD


def _values(rows: list[tuple]) -> str:
    def cell(v):
        return quote(v) if isinstance(v, str) else repr(v)

    return "(VALUES " + ", ".join("(" + ", ".join(cell(v) for v in r) + ")" for r in rows) + ")"


_RISK_ROWS = [
    (cat, ci, weight, wi, kw, L.keyword_pattern(kw))
    for ci, (cat, (weight, words)) in enumerate(L.RISK_CATEGORIES.items())
    for wi, kw in enumerate(words)
]
_SUSP_ROWS = [(g, kw, L.keyword_pattern(kw)) for g, words in L.SUSPICIOUS_KEYWORDS.items() for kw in words]

LOW_SQL = "low AS MATERIALIZED (SELECT message_id, lower(text) AS low FROM messages)"
RISK_SQL = f"""risk_lexicon(category, cpos, weight, pos, kw, rx) AS {_values(_RISK_ROWS)},
found AS MATERIALIZED (SELECT message_id, low, category, cpos, weight, pos, kw, rx FROM low JOIN risk_lexicon ON contains(low, kw)),
risk_hits AS MATERIALIZED (SELECT message_id, category, cpos, weight, pos, kw FROM found WHERE regexp_matches(low, rx)),
cats AS MATERIALIZED (SELECT message_id, category, cpos, count(*) * weight AS score, count(*) AS n_hits, list(kw ORDER BY pos) AS matches
         FROM risk_hits GROUP BY message_id, category, cpos, weight),
risk AS MATERIALIZED (SELECT message_id, least(100, coalesce(sum(score), 0))::INT AS risk_score, count(category) AS n_cats,
         coalesce(list(category ORDER BY cpos) FILTER (category IS NOT NULL), []) AS names
         FROM low LEFT JOIN cats USING (message_id) GROUP BY message_id)"""
SUSP_SQL = f"""susp_lexicon(grp, kw, rx) AS {_values(_SUSP_ROWS)},
susp AS MATERIALIZED (SELECT message_id, list(DISTINCT kw ORDER BY kw) AS keywords FROM low JOIN susp_lexicon ON contains(low, kw)
         WHERE regexp_matches(low, rx) GROUP BY message_id)"""

_URL_RX = (r"(?i)" + L.URL_IN_TEXT.replace("{s}", SP).replace("{{", "{").replace("}}", "}"))
_PFX = r"^(?:\+91|91|0)"


def _agg(name: str, source: str, keep: str = "true") -> str:
    return f"""{name} AS MATERIALIZED (SELECT message_id, list(DISTINCT v ORDER BY v) AS vals FROM ({source}) WHERE {keep} GROUP BY message_id)"""


RAW_ENTITIES_SQL = ",\n".join([
    _agg("upi", f"SELECT message_id, lower(unnest(regexp_extract_all(text, '[{L.UPI_BODY}]+@[a-zA-Z]{{2,}}'))) AS v FROM messages",
         "NOT regexp_matches(v, '@.*(" + "|".join(L.MAIL_DOMAINS) + ")')"),
    _agg("phone", f"SELECT message_id, regexp_replace(unnest(regexp_extract_all(text, '{L.PHONE}')), '{_PFX}', '') AS v FROM messages",
         "length(v) = 10 AND regexp_matches(v, '^[6-9]')"),
    _agg("acct", f"SELECT message_id, unnest(regexp_extract_all(text, '[{W}]+')) AS v FROM messages",
         r"regexp_matches(v, '^\p{Nd}{9,18}$') AND NOT (length(v) = 10 AND regexp_matches(v, '^[6-9]'))"),
    _agg("link", f"""SELECT message_id, v FROM (SELECT message_id, unnest(regexp_extract_all(text, {quote(_URL_RX)})) AS v FROM messages)
         WHERE regexp_matches(v, '{L.LINK_IP}') OR regexp_matches(v, '(?i){L.LINK_LURES}') OR regexp_matches(v, '(?i){L.LINK_TLDS}') OR contains(v, '@')
         UNION ALL SELECT message_id, unnest(regexp_extract_all(text, '(?i){L.SHORT_LINK}')) AS v FROM messages"""),
])
_DOTTED = "contains(trim(split_part(regexp_extract(CASE WHEN contains(v, '://') THEN v ELSE 'http://' || v END, '://([^/?#]*)', 1), ':', 1), '.'), '.')"
INTEL_SQL = f"""intel AS MATERIALIZED (SELECT m.message_id, coalesce(upi.vals, []) AS upi,
   list_filter(coalesce(phone.vals, []), lambda v: regexp_matches(regexp_replace(v, '{_PFX}', ''), '^[6-9]\\p{{Nd}}{{9}}$')
       AND len(list_distinct(string_split(v, ''))) > 1) AS phone,
   coalesce(acct.vals, []) AS acct, list_filter(coalesce(link.vals, []), lambda v: {_DOTTED}) AS link, coalesce(susp.keywords, []) AS kw
 FROM low m LEFT JOIN upi USING (message_id) LEFT JOIN phone USING (message_id) LEFT JOIN acct USING (message_id)
 LEFT JOIN link USING (message_id) LEFT JOIN susp USING (message_id)),
base AS MATERIALIZED (SELECT *, least(100, (CASE WHEN len(upi) > 0 THEN 30 ELSE 0 END) + (CASE WHEN len(phone) > 0 THEN 15 ELSE 0 END)
   + (CASE WHEN len(link) > 0 THEN 40 ELSE 0 END) + least(len(kw) * 5, 30))::INT AS base_score FROM intel)"""


def _rx(pattern: str) -> str:
    return quote("(?i)" + pattern)


RULES_SQL = f"""rules0 AS MATERIALIZED (SELECT m.message_id, text, risk_score, n_cats, names, base_score, upi, phone, acct, link, kw,
   least((risk_score * 0.7 + base_score * 0.3) / 100.0, 1.0)::DOUBLE AS conf,
   CASE WHEN list_contains(names, 'job_scam') THEN 'job_scam' WHEN list_contains(names, 'romance') THEN 'romance_scam'
     WHEN list_contains(names, 'crypto') THEN 'crypto_scam' WHEN list_contains(names, 'delivery') THEN 'delivery_scam'
     WHEN len(link) > 0 THEN 'phishing' WHEN len(upi) > 0 THEN 'upi_fraud' WHEN list_contains(names, 'rewards') THEN 'lottery'
     WHEN list_contains(names, 'verification') AND list_contains(names, 'authority') AND regexp_matches(text, {_rx(L.whole(L.BANK_CONTEXT))}) THEN 'bank_fraud'
     WHEN list_contains(names, 'financial') AND list_contains(names, 'urgency') AND regexp_matches(text, {_rx(L.whole(L.INVESTMENT_CONTEXT))}) THEN 'investment_scam'
     WHEN n_cats >= 3 THEN 'UNKNOWN_SCAM' ELSE 'other' END AS raw_type
 FROM messages m JOIN risk USING (message_id) JOIN base USING (message_id)),
rules1 AS MATERIALIZED (SELECT *, risk_score >= 18 OR n_cats >= 2 OR conf > 0.30 OR len(link) > 0 AS is_scam FROM rules0),
rules AS MATERIALIZED (SELECT *, CASE WHEN is_scam AND raw_type IN ('other', 'UNKNOWN_SCAM') THEN 'OTHER_SUSPICIOUS' ELSE raw_type END AS scam_type FROM rules1)"""

_CUES = [(n, p, True) for n, p in B.REQUEST_RX.items()] + [(n, p, False) for n, p in B.PRETEXT_RX.items()]
_CUES.append(("URGENCY_MANIPULATION", B.URGENCY_RX, False))
BEHAVIOUR_SQL = f"""cues AS MATERIALIZED (
  {" UNION ALL ".join(f"SELECT message_id, pos, sentence, '{n}' AS type FROM sentences WHERE regexp_matches(sentence, {_rx(p)})" + (f" AND NOT regexp_matches(sentence, {_rx(B.NEGATION_RX)})" if neg else "") for n, p, neg in _CUES)}),
firsts AS MATERIALIZED (SELECT message_id, type, arg_min(sentence, pos) AS evidence FROM cues GROUP BY message_id, type),
umbrella AS (SELECT message_id, 'CREDENTIAL_REQUEST' AS type, arg_min(evidence, list_position({L.UMBRELLA_MEMBERS}, type)) AS evidence
   FROM firsts WHERE type IN ({", ".join(quote(t) for t in L.UMBRELLA_MEMBERS)}) GROUP BY message_id),
behaviour AS MATERIALIZED (SELECT * FROM firsts UNION ALL SELECT * FROM umbrella)"""
_NEGATED = f"""negated AS MATERIALIZED (SELECT DISTINCT message_id FROM sentences WHERE regexp_matches(sentence, {_rx(B.NEGATION_RX)})
   AND ({" OR ".join(f"regexp_matches(sentence, {_rx(p)})" for p in B.REQUEST_RX.values())}))"""

_PRIORITY = [*L.MFA_TYPES, *L.CREDENTIAL_TYPES, "BANK_DETAIL_REQUEST", "PAYMENT_REQUEST"]
PATTERN_SQL = f"""owner AS MATERIALIZED (SELECT message_id, arg_min(type, list_position({_PRIORITY}, type)) AS primary_type,
     arg_min(evidence, list_position({_PRIORITY}, type)) AS primary_evidence
   FROM behaviour WHERE list_contains({_PRIORITY}, type) GROUP BY message_id),
second AS MATERIALIZED (SELECT message_id, count(*) AS n_sec, list(type ORDER BY list_position({L.SECONDARY_TYPES}, type)) AS sec FROM behaviour
   WHERE list_contains({L.SECONDARY_TYPES}, type) GROUP BY message_id),
levels(primary_type, o_type, o_risk, o_conf) AS {_values([
    (t, *L.BEHAVIOUR_OVERRIDE["mfa" if t in L.MFA_TYPES else "credential" if t in L.CREDENTIAL_TYPES else "bank_detail" if t == "BANK_DETAIL_REQUEST" else "payment"])
    for t in _PRIORITY])},
pattern AS MATERIALIZED (SELECT r.message_id, r.text, names, base_score, link, upi, phone, acct, kw, primary_type, coalesce(n_sec, 0) AS n_sec, coalesce(sec, []) AS sec, o_conf,
   CASE WHEN primary_type IS NULL THEN risk_score ELSE least(greatest(risk_score, o_risk) + 5 * least(coalesce(n_sec, 0), 2), 100) END::INT AS risk_score,
   CASE WHEN primary_type IS NULL THEN conf ELSE least(o_conf + 0.03 * coalesce(n_sec, 0), 0.97) END::DOUBLE AS conf,
   CASE WHEN primary_type IS NULL THEN scam_type ELSE o_type END AS scam_type, is_scam OR primary_type IS NOT NULL AS is_scam
 FROM rules r LEFT JOIN owner USING (message_id) LEFT JOIN levels USING (primary_type) LEFT JOIN second s ON s.message_id = r.message_id)"""

TO_RULES = (MESSAGES_SQL, LOW_SQL, RISK_SQL, SUSP_SQL, RAW_ENTITIES_SQL, INTEL_SQL, RULES_SQL)
TO_PATTERN = (*TO_RULES, SENTENCES_SQL, BEHAVIOUR_SQL, PATTERN_SQL)
JOIN = "array_to_string"


# -- keywords ----------------------------------------------------------------

@query("fk1_contains_word", with_(MESSAGES_SQL) + f"""
SELECT count(*) FILTER (regexp_matches(lower(text), {quote(L.keyword_pattern('rs'))})) AS n_rs,
       count(*) FILTER (regexp_matches(lower(text), {quote(L.keyword_pattern('₹'))})) AS n_rupee,
       count(*) FILTER (regexp_matches(lower(text), {quote(L.keyword_pattern('limited time'))})) AS n_limited,
       count(*) FILTER (contains(lower(text), 'rs')) AS n_substring FROM messages""")
def contains_word(spark, sf):
    low = messages(spark, sf).select(F.lower("text").alias("low"))
    return low.agg(
        F.count_if(K.contains_word(F.col("low"), "rs")).alias("n_rs"),
        F.count_if(K.contains_word(F.col("low"), "₹")).alias("n_rupee"),
        F.count_if(K.contains_word(F.col("low"), "limited time")).alias("n_limited"),
        F.count_if(F.contains("low", F.lit("rs"))).alias("n_substring"),
    )


@query("fk2_category_risk_score", with_(MESSAGES_SQL, LOW_SQL, RISK_SQL) + f"""
SELECT risk.message_id, risk_score, {JOIN}(names, ',') AS categories, coalesce({JOIN}(h.hits, ','), '') AS hits FROM risk LEFT JOIN
  (SELECT message_id, list(kw ORDER BY cpos, pos) AS hits FROM risk_hits GROUP BY message_id) h USING (message_id)""")
def category_risk_score(spark, sf):
    return P.with_keywords(messages(spark, sf)).select(
        "message_id", "risk_score", F.array_join("category_names", ",").alias("categories"),
        F.array_join(F.flatten(F.transform("categories", lambda c: c["matches"])), ",").alias("hits"),
    )


@query("fk2_category_totals", with_(MESSAGES_SQL, LOW_SQL, RISK_SQL) + """
SELECT category, count(*) AS n_messages, sum(n_hits)::BIGINT AS n_hits, sum(score)::BIGINT AS total_score FROM cats GROUP BY category""")
def category_totals(spark, sf):
    # The outer form keeps Spark from adding a size filter that scans the text twice.
    cats = P.with_keywords(messages(spark, sf)).select(F.inline_outer("categories")).filter("category IS NOT NULL")
    return cats.groupBy("category").agg(
        F.count("*").alias("n_messages"), F.sum(F.size("matches")).alias("n_hits"), F.sum("score").alias("total_score")
    )


@query("fk3_suspicious_keywords", with_(MESSAGES_SQL, LOW_SQL, SUSP_SQL) + f"""
SELECT message_id, coalesce({JOIN}(keywords, ','), '') AS keywords FROM low LEFT JOIN susp USING (message_id)""")
def suspicious_keywords(spark, sf):
    hits = P.with_keywords(messages(spark, sf))
    return hits.select("message_id", F.array_join(K.suspicious(F.col("hits")), ",").alias("keywords"))


# -- behaviour ---------------------------------------------------------------

def _request_sql(neg: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{n}' AS type, count(DISTINCT message_id) AS n_messages, count(*) AS n_sentences FROM sentences WHERE regexp_matches(sentence, {_rx(p)}){neg}"
        for n, p in B.REQUEST_RX.items()
    )


def _cue_sentences(spark, sf):
    """Sentences that can raise a signal, folded once, with their places."""
    return messages(spark, sf).select("message_id", F.inline_outer(B.cue_sentences(F.col("text")))).filter("sentence IS NOT NULL")


@query("fk4_secret_requests", with_(MESSAGES_SQL, SENTENCES_SQL) + f"SELECT * FROM ({_request_sql('')}) WHERE n_sentences > 0")
def secret_requests(spark, sf):
    s = _cue_sentences(spark, sf)
    types = F.array_compact(F.array(*[F.when(B.is_request(F.col("sentence"), n), F.lit(n)) for n in B.REQUEST_RX]))
    hit = s.select("message_id", F.explode_outer(types).alias("type")).filter("type IS NOT NULL")
    per = hit.groupBy("type", "message_id").agg(F.count("*").alias("n"))
    return per.groupBy("type").agg(F.count("*").alias("n_messages"), F.sum("n").alias("n_sentences"))


@query("fk5_negation_cues", with_(MESSAGES_SQL, SENTENCES_SQL) + f"""
SELECT message_id, count(*) FILTER (regexp_matches(sentence, {_rx(B.NEGATION_RX)})) AS n_negated, count(*) AS n_sentences FROM sentences GROUP BY message_id""")
def negation_cues(spark, sf):
    s = messages(spark, sf).select("message_id", T.sentences(F.col("text")).alias("s")).filter(F.size("s") > 0)
    return s.select(
        "message_id", F.size(F.filter("s", B.is_negated)).cast("bigint").alias("n_negated"), F.size("s").cast("bigint").alias("n_sentences")
    )


@query("fk6_fk7_pretext_and_urgency", with_(MESSAGES_SQL, SENTENCES_SQL, BEHAVIOUR_SQL) + f"""
SELECT message_id, type, md5(evidence) AS evidence_md5 FROM firsts WHERE type IN ({", ".join(quote(t) for t in L.SECONDARY_TYPES)})""")
def pretext_and_urgency(spark, sf):
    s = P.with_behaviour(messages(spark, sf)).select("message_id", F.explode_outer("signals").alias("type", "evidence")).filter("type IS NOT NULL")
    return s.filter(F.col("type").isin(L.SECONDARY_TYPES)).select("message_id", "type", F.md5("evidence").alias("evidence_md5"))


@query("fk8_umbrella_credential_request", with_(MESSAGES_SQL, SENTENCES_SQL, BEHAVIOUR_SQL) + """
SELECT message_id, evidence FROM behaviour WHERE type = 'CREDENTIAL_REQUEST'""")
def umbrella(spark, sf):
    s = P.with_behaviour(messages(spark, sf))
    return s.select("message_id", F.try_element_at("signals", F.lit("CREDENTIAL_REQUEST")).alias("evidence")).filter("evidence IS NOT NULL")


@query("fk9_behavioural_signals", with_(MESSAGES_SQL, SENTENCES_SQL, BEHAVIOUR_SQL) + f"""
SELECT message_id, type, CASE WHEN list_contains({[*B.REQUEST_RX, "CREDENTIAL_REQUEST"]}, type) THEN 'high' ELSE 'medium' END AS severity, evidence FROM behaviour""")
def behavioural_signals(spark, sf):
    s = P.with_behaviour(messages(spark, sf)).select("message_id", F.explode_outer("signals").alias("type", "evidence")).filter("type IS NOT NULL")
    return s.select("message_id", "type", B.severity(F.col("type")).alias("severity"), "evidence")


@query("o7_first_trigger_sentence", with_(MESSAGES_SQL, SENTENCES_SQL, BEHAVIOUR_SQL) + """
SELECT message_id, type, min(pos) - 1 AS first_pos FROM cues GROUP BY message_id, type""")
def first_trigger(spark, sf):
    """Position form: explode with positions, keep the smallest per type."""
    rows, sent = _cue_sentences(spark, sf), F.col("sentence")
    tests = [F.when(B.is_request(sent, n) & ~sent.rlike(B.NEGATION_RX), F.lit(n)) for n in B.REQUEST_RX]
    tests += [F.when(B.is_cue(sent, n), F.lit(n)) for n in [*B.PRETEXT_RX, "URGENCY_MANIPULATION"]]
    hits = rows.select("message_id", "pos", F.explode_outer(F.array_compact(F.array(*tests))).alias("type")).filter("type IS NOT NULL")
    return hits.groupBy("message_id", "type").agg(F.min("pos").cast("bigint").alias("first_pos"))


@query("fk10_negated_request_guard", with_(MESSAGES_SQL, SENTENCES_SQL, _NEGATED) + """
SELECT message_id, n.message_id IS NOT NULL AS negated_request FROM messages LEFT JOIN negated n USING (message_id)""")
def negated_guard(spark, sf):
    return P.with_behaviour(messages(spark, sf)).select("message_id", "negated_request")


# -- entities ----------------------------------------------------------------

def _entity_query(name: str, cte: str, fn):
    sql = with_(MESSAGES_SQL, RAW_ENTITIES_SQL) + f"SELECT message_id, {JOIN}(vals, '|') AS vals, len(vals)::INT AS n FROM {cte}"

    @query(name, sql)
    def run(spark, sf):
        out = messages(spark, sf).select("message_id", fn(F.col("text")).alias("v")).filter(F.size("v") > 0)
        return out.select("message_id", F.array_join("v", "|").alias("vals"), F.size("v").alias("n"))

    return run


_entity_query("fe1_upi_ids", "upi", E.upi_ids)
_entity_query("fe2_phone_numbers", "phone", E.phone_numbers)
_entity_query("fe3_bank_accounts", "acct", E.bank_accounts)
_entity_query("fe4_suspicious_links", "link", E.suspicious_links)


@query("fe5_extract_entities", with_(MESSAGES_SQL, LOW_SQL, SUSP_SQL, RAW_ENTITIES_SQL, INTEL_SQL) + f"""
SELECT message_id, {JOIN}(upi, '|') AS upi, {JOIN}(phone, '|') AS phone, {JOIN}(acct, '|') AS acct, {JOIN}(link, '|') AS link, {JOIN}(kw, '|') AS kw FROM intel""")
def extract_entities(spark, sf):
    i = P.with_intel(messages(spark, sf))
    names = {"upi": "upiIds", "phone": "phoneNumbers", "acct": "bankAccounts", "link": "phishingLinks", "kw": "suspiciousKeywords"}
    return i.select("message_id", *[F.array_join(F.col("intel")[b], "|").alias(a) for a, b in names.items()])


@query("fe6_validate_upi", with_(MESSAGES_SQL, RAW_ENTITIES_SQL, "v AS (SELECT message_id, unnest(vals) AS value FROM upi)") + f"""
SELECT message_id, value, true AS valid, CASE WHEN h THEN 0.95 ELSE 0.7 END::DOUBLE AS confidence,
       CASE WHEN h THEN 'Valid format and known bank handle' ELSE 'Valid format but unknown bank handle' END AS reason
FROM (SELECT *, split_part(value, '@', 2) IN ({", ".join(quote(h) for h in L.UPI_HANDLES)}) AS h FROM v)""")
def validate_upi(spark, sf):
    v = messages(spark, sf).select("message_id", F.explode(E.upi_ids(F.col("text"))).alias("value"))
    return v.select("message_id", "value", E.check_upi(F.col("value")).alias("c")).select("message_id", "value", "c.*")


@query("fe7_validate_phone", with_(MESSAGES_SQL, RAW_ENTITIES_SQL, f"v AS (SELECT message_id, value, regexp_replace(value, '{_PFX}', '') AS bare FROM (SELECT message_id, unnest(vals) AS value FROM phone))") + r"""
SELECT message_id, value, ok AND NOT rep AS valid, CASE WHEN NOT ok THEN 0.0 WHEN rep THEN 0.1 ELSE 0.9 END::DOUBLE AS confidence,
       CASE WHEN NOT ok THEN 'Invalid Indian mobile format' WHEN rep THEN 'Suspicious repeating digits' ELSE 'Valid Indian mobile format' END AS reason
FROM (SELECT *, regexp_matches(bare, '^[6-9]\p{Nd}{9}$') AS ok, len(list_distinct(string_split(bare, ''))) = 1 AS rep FROM v)""")
def validate_phone(spark, sf):
    v = messages(spark, sf).select("message_id", F.explode(E.phone_numbers(F.col("text"))).alias("value"))
    return v.select("message_id", "value", E.check_phone(F.col("value")).alias("c")).select("message_id", "value", "c.*")


@query("fe8_validate_account", with_(MESSAGES_SQL) + f"""
SELECT message_id, value, ok AS valid, CASE WHEN ok THEN 0.8 ELSE 0.0 END::DOUBLE AS confidence,
       CASE WHEN ok THEN 'Valid account number format' ELSE 'Invalid length' END AS reason
FROM (SELECT *, regexp_matches(value, '^\\p{{Nd}}{{9,18}}$') AS ok FROM (SELECT message_id, unnest(regexp_extract_all(text, '\\p{{Nd}}+')) AS value FROM messages))""")
def validate_account(spark, sf):
    v = messages(spark, sf).select("message_id", F.explode(F.regexp_extract_all("text", F.lit(r"\p{Nd}+"), F.lit(0))).alias("value"))
    return v.select("message_id", "value", E.check_account(F.col("value")).alias("c")).select("message_id", "value", "c.*")


_URL_TESTS = [(f"regexp_matches(v, '{L.URL_CHECK_IP}')", 0.4, "IP address usage"), (f"regexp_matches(v, '(?i){L.URL_CHECK_TLDS}')", 0.3, "Risky TLD"),
              (f"regexp_matches(v, '(?i){L.URL_CHECK_LURES}')", 0.2, "Phishing keywords in URL"), (f"regexp_matches(v, '(?i){L.URL_CHECK_SHORT}')", 0.1, "URL shortener used")]


@query("fe9_validate_url", f"""WITH u AS (SELECT page_id, unnest([url, replace(url, '://', '://bit.ly/login.'), replace(url, '.example', '-example'), 'http://10.1.2.3/secure.xyz']) AS v FROM pages),
s AS (SELECT page_id, v, {_DOTTED} AS dotted, {" + ".join(f"(CASE WHEN {c} THEN {p} ELSE 0.0 END)" for c, p, _ in _URL_TESTS)} AS risk,
      array_to_string(list_filter([{", ".join(f"CASE WHEN {c} THEN '{w}' END" for c, _, w in _URL_TESTS)}], lambda x: x IS NOT NULL), ', ') AS why FROM u)
SELECT page_id, v AS url, dotted AS valid, CASE WHEN NOT dotted THEN 0.0 ELSE round(least(0.5 + risk, 1.0)::DOUBLE, 6) END::DOUBLE AS confidence,
       CASE WHEN NOT dotted THEN 'Not a URL' WHEN risk > 0 THEN why ELSE 'URL detected but no specific phishing indicators' END AS reason FROM s""")
def validate_url(spark, sf):
    url = F.col("url")
    forms = F.array(url, F.replace(url, F.lit("://"), F.lit("://bit.ly/login.")), F.replace(url, F.lit(".example"), F.lit("-example")),
                    F.lit("http://10.1.2.3/secure.xyz"))
    u = table(spark, sf, "pages").select("page_id", F.explode(forms).alias("url"))
    c = u.select("page_id", "url", E.check_url(F.col("url")).alias("c"))
    return c.select("page_id", "url", "c.valid", F.round("c.confidence", 6).alias("confidence"), "c.reason")


_TAGGED_SQL = """tagged AS (SELECT c_custkey, ['NUM', 'NUMBER', 'MONEY', 'ORG', 'DATE'][(c_custkey % 5 + 1)::INT] AS label,
  CASE c_custkey % 5 WHEN 0 THEN '+98-' || (70000000 + c_custkey)::VARCHAR WHEN 1 THEN 'A/C ' || (100000000000 + c_custkey)::VARCHAR
       WHEN 2 THEN 'Rs ' || c_custkey::VARCHAR ELSE c_name END AS text FROM customer)"""


@query("fe10_u2_merge_model_entities", f"""WITH {_TAGGED_SQL}, d AS (SELECT *, regexp_replace(text, '\\P{{Nd}}', '', 'g') AS digits FROM tagged),
m AS (SELECT c_custkey, CASE WHEN label IN ('NUM', 'NUMBER') AND length(digits) = 10 AND regexp_matches(digits, '^[6-9]') THEN 'phoneNumbers'
   WHEN label IN ('NUM', 'NUMBER') AND length(digits) BETWEEN 9 AND 18 THEN 'bankAccounts' WHEN label = 'MONEY' THEN 'amounts' WHEN label = 'ORG' THEN 'organizations' END AS bucket,
   CASE WHEN label IN ('NUM', 'NUMBER') THEN digits ELSE text END AS value FROM d),
rules AS (SELECT c_custkey, 'bankAccounts' AS bucket, (100000000000 + c_custkey)::VARCHAR AS value FROM customer)
SELECT c_custkey, bucket, value FROM m WHERE bucket IS NOT NULL UNION SELECT * FROM rules""")
def merge_model_entities(spark, sf):
    c = table(spark, sf, "customer")
    key, slot = F.col("c_custkey"), F.col("c_custkey") % 5
    label = F.try_element_at(F.lit(["NUM", "NUMBER", "MONEY", "ORG", "DATE"]), (slot + 1).cast("int"))
    text = (
        F.when(slot == 0, F.concat(F.lit("+98-"), (key + 70000000).cast("string")))
        .when(slot == 1, F.concat(F.lit("A/C "), (key + 100000000000).cast("string")))
        .when(slot == 2, F.concat(F.lit("Rs "), key.cast("string"))).otherwise(F.col("c_name"))
    )
    model = c.select("c_custkey", E.model_entity(label, text).alias("m")).filter("m IS NOT NULL").select("c_custkey", "m.*")
    rules = c.select("c_custkey", F.lit("bankAccounts").alias("bucket"), (key + 100000000000).cast("string").alias("value"))
    return model.unionByName(rules).distinct()


# -- verdicts ----------------------------------------------------------------

@query("fc4_intel_score", with_(MESSAGES_SQL, LOW_SQL, SUSP_SQL, RAW_ENTITIES_SQL, INTEL_SQL) + "SELECT message_id, base_score FROM base")
def intel_score(spark, sf):
    return P.with_intel(messages(spark, sf)).select("message_id", E.intel_score(F.col("intel")).alias("base_score"))


@query("fc1_scam_type", with_(*TO_RULES) + "SELECT message_id, raw_type AS scam_type FROM rules")
def scam_type(spark, sf):
    return P.rules_verdict(messages(spark, sf)).select("message_id", F.col("raw_type").alias("scam_type"))


@query("fc10_rules_only_verdict", with_(*TO_RULES) + """
SELECT message_id, risk_score, base_score, round(conf, 6) AS confidence, scam_type, is_scam FROM rules""")
def rules_only(spark, sf):
    return P.rules_verdict(messages(spark, sf)).select(
        "message_id", "risk_score", "base_score", F.round("pattern_confidence", 6).alias("confidence"), "scam_type", "is_scam"
    )


@query("fc2_fc3_pattern_verdict", with_(*TO_PATTERN) + f"""
SELECT message_id, risk_score, round(conf, 6) AS confidence, scam_type, is_scam, primary_type, {JOIN}(sec, ',') AS secondary FROM pattern""")
def pattern_verdict(spark, sf):
    return P.pattern_verdict(messages(spark, sf)).select(
        "message_id", "risk_score", F.round("pattern_confidence", 6).alias("confidence"), "scam_type", "is_scam",
        F.col("primary")["type"].alias("primary_type"), F.array_join("secondary", ",").alias("secondary"),
    )


@query("o4_indicator_list", with_(*TO_RULES, """flags AS (SELECT message_id, unnest(kw) AS flag FROM rules
   UNION SELECT message_id, unnest(matches[1:2]) AS flag FROM cats)""") + f"""
SELECT message_id, coalesce(indicators, '') AS indicators FROM low LEFT JOIN
  (SELECT message_id, {JOIN}(list(flag ORDER BY flag)[1:10], '|') AS indicators FROM flags GROUP BY message_id) USING (message_id)""")
def indicator_list(spark, sf):
    df = P.rules_verdict(messages(spark, sf))
    return df.select("message_id", F.array_join("indicators", "|").alias("indicators"))


@query("fc7_evidence_list", with_(*TO_PATTERN) + f"""
SELECT message_id, source, type, round(weight::DOUBLE, 6) AS weight FROM (
  SELECT message_id, 'rule_detector' AS source, upper(category) AS type, round(least(score / 100.0, 1.0), 3) AS weight FROM cats
  UNION ALL SELECT message_id, 'behavioral_detector', primary_type, o_conf FROM pattern WHERE primary_type IS NOT NULL
  UNION ALL SELECT message_id, 'behavioral_detector', unnest(sec), 0.2 FROM pattern WHERE primary_type IS NOT NULL)""")
def evidence_list(spark, sf):
    df = P.pattern_verdict(messages(spark, sf))
    items = P.evidence_items(F.col("categories"), F.col("primary"), F.col("override_base"), F.col("secondary"))
    return df.select("message_id", F.inline(items)).withColumn("weight", F.round("weight", 6))


@query("fc5_label_has_evidence", with_(MESSAGES_SQL) + f"""
SELECT message_id, claimed, CASE claimed WHEN 'investment_scam' THEN regexp_matches(text, {_rx(L.whole(L.INVESTMENT_CONTEXT))})
  WHEN 'bank_fraud' THEN regexp_matches(text, {_rx(L.whole(L.BANK_CONTEXT))}) WHEN 'phishing' THEN contains(lower(text), 'http://') OR contains(lower(text), 'https://')
  ELSE true END AS grounded FROM (SELECT *, unnest(['investment_scam', 'bank_fraud', 'phishing', 'lottery']) AS claimed FROM messages)""")
def label_has_evidence(spark, sf):
    m = messages(spark, sf).withColumn("claimed", F.explode(F.lit(["investment_scam", "bank_fraud", "phishing", "lottery"])))
    return m.select("message_id", "claimed", D.type_has_evidence(F.col("claimed"), F.col("text")).alias("grounded"))


@query("highest_risk_messages", with_(*TO_PATTERN) + f"""
SELECT message_id, risk_score, CASE WHEN risk_score >= 80 THEN 'critical' WHEN risk_score >= 60 THEN 'high' WHEN risk_score >= 30 THEN 'medium'
         WHEN risk_score > 0 THEN 'low' ELSE 'none' END AS severity, scam_type, {JOIN}(names, ',') AS categories, {JOIN}(upi, ',') AS upi_ids
FROM pattern ORDER BY risk_score DESC, message_id LIMIT 50""")
def highest_risk(spark, sf):
    """Flagship report: the fifty riskiest messages with severity, type and handles."""
    df = P.pattern_verdict(messages(spark, sf))
    return df.select(
        "message_id", "risk_score", D.severity(F.col("risk_score")).alias("severity"), "scam_type",
        F.array_join("category_names", ",").alias("categories"), F.array_join(F.col("intel")["upiIds"], ",").alias("upi_ids"),
    ).orderBy(F.desc("risk_score"), "message_id").limit(50)
