"""Conversation and session queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lurewatch import lexicon as L
from lurewatch.operators import sessions as S
from lurewatch.operators.reports import agent_notes
from lurewatch.plans.detection_queries import INTEL_SQL, LOW_SQL, RAW_ENTITIES_SQL, SUSP_SQL
from lurewatch.plans.inputs import TURNS_SQL, quote, turns, with_
from lurewatch.plans.registry import query
from lurewatch.plans.text_queries import _neutral_sql, _sum_sql, sql_strip

_AS_MESSAGES = "messages AS (SELECT session_id * 1000 + turn AS message_id, text FROM turns)"
_LONG = """tent AS MATERIALIZED (SELECT message_id // 1000 AS session_id, message_id % 1000 AS turn, kind, value FROM (
  SELECT message_id, 'upi_id' AS kind, unnest(upi) AS value FROM intel UNION ALL SELECT message_id, 'phone', unnest(phone) FROM intel UNION ALL
  SELECT message_id, 'bank_account', unnest(acct) FROM intel UNION ALL SELECT message_id, 'url', unnest(link) FROM intel UNION ALL SELECT message_id, 'keyword', unnest(kw) FROM intel)),
vals AS MATERIALIZED (SELECT session_id, kind, value, min(turn) AS first_turn FROM tent GROUP BY ALL),
scores AS (SELECT session_id, count(*) FILTER (kind = 'upi_id') AS n_upi_id, count(*) FILTER (kind = 'phone') AS n_phone, count(*) FILTER (kind = 'bank_account') AS n_bank_account,
  count(*) FILTER (kind = 'url') AS n_url, count(*) FILTER (kind = 'keyword') AS n_keyword FROM vals GROUP BY session_id)"""
TO_VALUES = (TURNS_SQL, _AS_MESSAGES, LOW_SQL, SUSP_SQL, RAW_ENTITIES_SQL, INTEL_SQL, _LONG)
SCORE = "(30 * n_upi_id + 20 * n_phone + 25 * n_bank_account + 15 * n_url)"


@query("a18_session_intel_union", with_(*TO_VALUES) + "SELECT * FROM vals")
def session_values(spark, sf):
    return S.session_values(S.turn_entities(turns(spark, sf)))


@query("a17_session_intel_score", with_(*TO_VALUES) + f"SELECT session_id, n_upi_id, n_phone, n_bank_account, n_url, {SCORE} AS intel_score FROM scores")
def intel_score(spark, sf):
    s = S.intel_scores(S.session_values(S.turn_entities(turns(spark, sf))))
    return s.select("session_id", "n_upi_id", "n_phone", "n_bank_account", "n_url", "intel_score")


PROGRESS_SQL = """fresh AS (SELECT session_id, first_turn AS turn, count(*) FILTER (kind = 'upi_id') AS u, count(*) FILTER (kind = 'phone') AS p, count(*) FILTER (kind = 'bank_account') AS b,
  count(*) FILTER (kind = 'url') AS l, count(*) AS a FROM vals GROUP BY ALL),
prog AS (SELECT session_id, turn, row_number() OVER w AS position, sum(coalesce(u, 0)) OVER w AS n_upi_id, sum(coalesce(p, 0)) OVER w AS n_phone, sum(coalesce(b, 0)) OVER w AS n_bank_account,
  sum(coalesce(l, 0)) OVER w AS n_url, coalesce(a, 0) AS a FROM turns LEFT JOIN fresh USING (session_id, turn) WINDOW w AS (PARTITION BY session_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
gaps AS (SELECT *, position - coalesce(max(CASE WHEN a > 0 THEN position END) OVER (PARTITION BY session_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS gap FROM prog)"""


ROLLUP_SQL = f"""sbase AS (SELECT session_id, count(*) AS message_count, epoch(max(ts) - min(ts))::BIGINT AS engagement_seconds, arg_max(sender, turn) AS last_sender, arg_max(text, turn) AS last_text FROM turns GROUP BY 1),
r1 AS (SELECT b.*, message_count // 2 AS turns, coalesce({SCORE}, 0) AS score, coalesce(n_upi_id, 0) AS n_upi, coalesce(n_phone, 0) AS n_phone, coalesce(n_url, 0) AS n_url,
  last_sender <> 'agent' AND length(last_text) > 0 AND (CASE WHEN {sql_strip('last_text')} = '' THEN 0 ELSE len(string_split_regex({sql_strip('last_text')}, '[{L.SPACE}]+')) END) < 3
    AND {_sum_sql('lower(last_text)', L.DISENGAGE_WORDS)} > 0 AS gone FROM sbase b LEFT JOIN scores USING (session_id)),
asked AS (SELECT g.session_id, g.turn, position, {SCORE}::BIGINT AS score, position // 2 AS n,
  sender <> 'agent' AND length(text) > 0 AND (CASE WHEN {sql_strip('text')} = '' THEN 0 ELSE len(string_split_regex({sql_strip('text')}, '[{L.SPACE}]+')) END) < 3
    AND {_sum_sql('lower(text)', L.DISENGAGE_WORDS)} > 0 AS quits FROM gaps g JOIN turns USING (session_id, turn)),
fired AS (SELECT session_id, min(turn) AS completed_turn, arg_min(position, turn) AS completed_at, arg_min(score, turn) AS completed_score FROM asked
  WHERE CASE WHEN n < 8 THEN quits WHEN n >= 25 THEN true WHEN score < 50 AND n < 15 THEN false WHEN score >= 80 THEN true WHEN score >= 50 AND n >= 12 THEN true ELSE quits END GROUP BY 1),
roll AS (SELECT r1.*, completed_turn, completed_at, completed_score, completed_at IS NOT NULL AS done FROM r1 LEFT JOIN fired USING (session_id))"""


@query("a19_session_rollup", with_(*TO_VALUES, PROGRESS_SQL, ROLLUP_SQL) + """
SELECT session_id, message_count, turns, engagement_seconds, last_sender, md5(last_text) AS last_md5, score AS intel_score, gone AS disengaged, done AS is_complete, coalesce(completed_turn, -1) AS completed_turn, coalesce(completed_at, -1) AS completed_at FROM roll""")
def rollup(spark, sf):
    r = S.rollup(turns(spark, sf))
    return r.select("session_id", "message_count", "turns", "engagement_seconds", "last_sender", F.md5("last_text").alias("last_md5"), "intel_score", "disengaged", "is_complete", F.coalesce("completed_turn", F.lit(-1)).alias("completed_turn"), F.coalesce("completed_at", F.lit(-1)).alias("completed_at"))


@query("fk16_disengagement", with_(TURNS_SQL) + f"""
SELECT session_id, turn FROM turns WHERE sender <> 'agent' AND length(text) > 0
  AND len(string_split_regex({sql_strip('text')}, '[{L.SPACE}]+')) < 3 AND {_sum_sql('lower(text)', L.DISENGAGE_WORDS)} > 0
UNION ALL SELECT session_id, -1 - turn FROM turns WHERE sender <> 'agent' AND {_sum_sql('lower(text)', L.DISENGAGE_WORDS)} > 0""")
def disengagement(spark, sf):
    from lurewatch.functions.replies import _count_any, is_disengaged

    t = turns(spark, sf)
    short = t.filter(is_disengaged(F.col("sender"), F.col("text"))).select("session_id", "turn")
    cue = t.filter((F.col("sender") != "agent") & (_count_any(F.lower("text"), L.DISENGAGE_WORDS) > 0))
    return short.unionByName(cue.select("session_id", (-1 - F.col("turn")).alias("turn")))


@query("w5_conversation_states", with_(TURNS_SQL, "p AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn) // 2 AS turn_no FROM turns)") + f"""
SELECT session_id, turn, turn_no, CASE {" ".join(f"WHEN turn_no <= {n} THEN {quote(s)}" for n, s in L.CONVERSATION_STATES)} ELSE 'exit' END AS state FROM p""")
def states(spark, sf):
    return S.with_states(turns(spark, sf)).select("session_id", "turn", "turn_no", "state")


@query("w8_progressive_intel", with_(*TO_VALUES, PROGRESS_SQL) + f"""
SELECT session_id, turn, n_upi_id::BIGINT AS n_upi_id, n_phone::BIGINT AS n_phone, n_bank_account::BIGINT AS n_bank_account, n_url::BIGINT AS n_url, {SCORE}::BIGINT AS intel_score FROM gaps""")
def progressive(spark, sf):
    return S.progressive_intel(turns(spark, sf)).select("session_id", "turn", "n_upi_id", "n_phone", "n_bank_account", "n_url", "intel_score")


@query("w9_stalling_tactic", with_(*TO_VALUES, PROGRESS_SQL) + f"""
SELECT session_id, turn, gap, CASE WHEN gap > 3 THEN 'TECHNICAL_DIFFICULTY' ELSE {L.STALLING_TACTICS}[((position // 2) % 5 + 1)::INT] END AS tactic FROM gaps""")
def stalling(spark, sf):
    p = S.progressive_intel(turns(spark, sf))
    return p.select("session_id", "turn", "gap", S.tactic(F.floor(F.col("position") / 2), F.col("gap")).alias("tactic"))


@query("w6_x2_repeated_replies")
def repeated(spark, sf):
    return S.repeated_replies(turns(spark, sf))


@query("w7_least_similar_reply")
def least_similar(spark, sf):
    options = ["ok tell me more", "what do i need to do?", "The build is green and the release notes are ready."]
    return S.least_similar(turns(spark, sf), options).select("session_id", "candidate")


@query("a24_conversation_context", with_(TURNS_SQL, f"w AS (SELECT session_id, turn, sender || ': {L.UNTRUSTED_BEGIN}' || chr(10) || {_neutral_sql('text')} || chr(10) || '{L.UNTRUSTED_END}' AS line FROM turns)") + """
SELECT session_id, md5(string_agg(line, chr(10) ORDER BY turn)) AS context_md5 FROM w GROUP BY session_id""")
def context(spark, sf):
    return S.context(turns(spark, sf)).select("session_id", F.md5("context").alias("context_md5"))


@query("p24_agent_notes", with_(*TO_VALUES, PROGRESS_SQL, ROLLUP_SQL) + """
SELECT session_id, array_to_string(list_filter([CASE WHEN session_id % 2 = 0 THEN 'Scam type: phishing' END, CASE WHEN session_id % 3 = 0 THEN 'Used Elderly Person persona' END,
  CASE WHEN n_upi > 0 THEN 'Got ' || n_upi::VARCHAR || ' UPI ID(s)' END, CASE WHEN n_phone > 0 THEN 'Got ' || n_phone::VARCHAR || ' phone(s)' END,
  CASE WHEN n_url > 0 THEN 'Found ' || n_url::VARCHAR || ' suspicious link(s)' END, message_count::VARCHAR || ' messages total'], lambda x: x IS NOT NULL), '. ') || '.' AS notes FROM roll""")
def notes(spark, sf):
    r = S.rollup(turns(spark, sf))
    kind, persona = F.when(F.col("session_id") % 2 == 0, "phishing"), F.when(F.col("session_id") % 3 == 0, "Elderly Person")
    return r.select("session_id", agent_notes(kind, persona, F.col("n_upi_id"), F.col("n_phone"), F.col("n_url"), F.col("message_count")).alias("notes"))
