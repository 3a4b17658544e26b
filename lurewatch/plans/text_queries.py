"""Text normalisation, redaction, reply checks and keyword queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lurewatch import lexicon as L
from lurewatch.functions import keys as Y
from lurewatch.functions import replies as R
from lurewatch.functions import text as T
from lurewatch.plans.inputs import MESSAGES_SQL, TURNS_SQL, messages, quote, turns, with_
from lurewatch.plans.registry import query

SP = L.SPACE
W = L.WORD


def sql_strip(expr: str) -> str:
    return f"regexp_replace(regexp_replace({expr}, '^[{SP}]+', ''), '[{SP}]+$', '')"


def digest(col):
    return F.md5(col)


@query("fn1_nfkc")
def nfkc(spark, sf):
    m = messages(spark, sf).withColumn("text", F.translate("text", "aeo", "ａｅｏ"))
    out = m.select("message_id", T.nfkc(F.col("text")).alias("t"))
    return out.select("message_id", digest("t").alias("text_md5"), F.length("t").alias("n_chars"))


@query("fn2_strip_invisible", with_(MESSAGES_SQL, "d AS (SELECT message_id, replace(text, 'a', 'a' || chr(8203) || chr(173)) AS text FROM messages)") + f"""
SELECT message_id, md5(regexp_replace(text, '[{L.INVISIBLE}]', '', 'g')) AS text_md5,
       length(text) - length(regexp_replace(text, '[{L.INVISIBLE}]', '', 'g')) AS removed FROM d""")
def strip_invisible(spark, sf):
    m = messages(spark, sf).withColumn("text", F.replace(F.col("text"), F.lit("a"), F.lit("a\u200b\u00ad")))
    out = m.withColumn("t", T.strip_invisible(F.col("text")))
    return out.select("message_id", digest("t").alias("text_md5"), (F.length("text") - F.length("t")).cast("bigint").alias("removed"))


@query("fn3_fold_lookalikes", with_(MESSAGES_SQL, "d AS (SELECT message_id, translate(text, 'aeopTH', 'аеорΤΗ') AS text FROM messages)") + f"""
SELECT message_id, md5(translate(text, '{L.HOMOGLYPHS_FROM}', '{L.HOMOGLYPHS_TO}')) AS text_md5 FROM d""")
def fold_lookalikes(spark, sf):
    m = messages(spark, sf).withColumn("text", F.translate("text", "aeopTH", "аеорΤΗ"))
    return m.select("message_id", digest(T.fold_lookalikes(F.col("text"))).alias("text_md5"))


_IN = SP.replace("\\t-\\r", "\\t\\x{b}-\\r")  # white space other than the line feed


@query("fn4_collapse_space", with_(
    MESSAGES_SQL,
    "d AS (SELECT message_id, replace(replace(text, '. ', '.  ' || chr(160) || chr(10) || ' '), ', ', ',' || chr(10) || chr(10) || chr(10) || chr(9)) || '  ' AS text FROM messages)",
    f"c AS (SELECT message_id, regexp_replace(regexp_replace(text, '[{L.BLANK_RUN}]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g') AS text FROM d)",
    f"t AS (SELECT message_id, regexp_replace(text, '[{_IN}]*\\n[{_IN}]*', chr(10), 'g') AS text FROM c)",
) + f"""
SELECT message_id, md5({sql_strip('text')}) AS text_md5, length({sql_strip('text')}) AS n_chars FROM t""")
def collapse_space(spark, sf):
    text = F.replace(F.col("text"), F.lit(". "), F.lit(".  \u00a0\n "))
    text = F.concat(F.replace(text, F.lit(", "), F.lit(",\n\n\n\t")), F.lit("  "))
    out = messages(spark, sf).select("message_id", T.collapse_space(text).alias("t"))
    return out.select("message_id", digest("t").alias("text_md5"), F.length("t").cast("bigint").alias("n_chars"))


@query("fn4_normalize_text")
def normalize_text(spark, sf):
    out = messages(spark, sf).select("message_id", T.normalize(F.col("text")).alias("t"), F.length("text").alias("n"))
    return out.select("message_id", digest("t").alias("text_md5"), (F.col("n") > L.LIMITS["text_chars"]).alias("too_long"))


@query("fn5_language_default", with_(MESSAGES_SQL) + f"""
SELECT CASE WHEN {sql_strip("coalesce(text, '')")} = '' THEN 'en' ELSE coalesce(nullif(trim(CASE WHEN message_id % 5 = 0 THEN ' ' ELSE lang END), ''), 'en') END AS language,
       count(*) AS n FROM messages GROUP BY 1""")
def language_default(spark, sf):
    lang = F.when(F.col("message_id") % 5 == 0, F.lit(" ")).otherwise(F.col("lang"))
    return messages(spark, sf).groupBy(T.language_or_default(lang, F.col("text")).alias("language")).agg(F.count("*").alias("n"))


@query("fn6_repair_transcribed_urls", with_(
    MESSAGES_SQL,
    "d AS (SELECT message_id, replace(replace(text, 'https://', 'https I| '), 'http://', 'http lI ') AS text FROM messages)",
    "l AS (SELECT message_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d)",
    f"""f AS (SELECT message_id, pos, regexp_replace(regexp_replace(line, '(?i)(^|[^{W}])https[{SP}]*[Il|]{{1,2}}[{SP}]*', '\\1https://', 'g'),
             '(?i)(^|[^{W}])http[{SP}]*[Il|]{{1,2}}[{SP}]*', '\\1http://', 'g') AS line FROM l)""",
    """r AS (SELECT message_id, pos, CASE WHEN contains(line, '://')
             THEN substr(line, 1, instr(line, '://') + 2) || replace(substr(line, instr(line, '://') + 3), ' ', '.') ELSE line END AS line FROM f)""",
) + "SELECT message_id, md5(string_agg(line, chr(10) ORDER BY pos)) AS text_md5 FROM r GROUP BY message_id")
def repair_urls(spark, sf):
    text = F.replace(F.replace(F.col("text"), F.lit("https://"), F.lit("https I| ")), F.lit("http://"), F.lit("http lI "))
    return messages(spark, sf).select("message_id", digest(T.repair_transcribed_urls(text)).alias("text_md5"))


SENTENCES_SQL = f"""parts AS (
  SELECT message_id, unnest(string_split_regex(marked, '\\n+')) AS s, generate_subscripts(string_split_regex(marked, '\\n+'), 1) AS pos
  FROM (SELECT message_id, regexp_replace(text, '([.?!])[{SP}]+', '\\1' || chr(10), 'g') AS marked FROM messages)),
sentences AS (SELECT message_id, pos, {sql_strip('s')} AS sentence FROM parts WHERE {sql_strip('s')} <> '')"""


@query("fn7_sentences", with_(MESSAGES_SQL, SENTENCES_SQL) + """
SELECT message_id, count(*) AS n_sentences, md5(string_agg(sentence, '|' ORDER BY pos)) AS joined_md5 FROM sentences GROUP BY message_id""")
def sentence_split(spark, sf):
    out = messages(spark, sf).select("message_id", T.sentences(F.col("text")).alias("s"))
    return out.filter(F.size("s") > 0).select(
        "message_id", F.size("s").cast("bigint").alias("n_sentences"), digest(F.array_join("s", "|")).alias("joined_md5")
    )


_MASK = [
    (f"[{W}][{W}.+-]*@[{W}-]+\\.[a-zA-Z]{{2,}}", "[redacted-email]"),
    (f"[{W}][{W}.+-]*@[a-zA-Z]{{2,}}", "[redacted-upi]"),
    (r"\p{Nd}{10,13}", "[redacted-phone]"),
]


def _mask_sql(expr: str) -> str:
    for pattern, mark in _MASK:
        for _ in range(2):  # neighbours share a delimiter, so every mask runs twice
            expr = f"regexp_replace({expr}, '(^|[^{W}])(?:{pattern})($|[^{W}])', '\\1{mark}\\2', 'g')"
    return expr


@query("fh5_redact_sensitive", with_(MESSAGES_SQL, f"r AS (SELECT message_id, {_mask_sql('text')} AS t FROM messages)") + """
SELECT message_id, md5(t) AS text_md5, (length(t) - length(replace(t, '[redacted-', ''))) // 10 AS n_masks FROM r""")
def redact(spark, sf):
    out = messages(spark, sf).select("message_id", T.redact(F.col("text")).alias("t"))
    n = F.floor((F.length("t") - F.length(F.replace(F.col("t"), F.lit("[redacted-"), F.lit("")))) / 10)
    return out.select("message_id", digest("t").alias("text_md5"), n.cast("bigint").alias("n_masks"))


def _neutral_sql(expr: str) -> str:
    for p in L.OVERRIDE_PHRASES:
        if "{b}" in p:
            expr = f"regexp_replace({expr}, '(?i)(^|[^{W}])DAN($|[^{W}])', '\\1{L.OVERRIDE_MARK}\\2', 'g')"
        else:
            expr = f"regexp_replace({expr}, '(?i){L.rx(p)}', '{L.OVERRIDE_MARK}', 'g')"
    return expr


@query("fk11_neutralize_untrusted", with_(MESSAGES_SQL, f"n AS (SELECT message_id, text, {_neutral_sql('text')} AS t FROM messages)") + f"""
SELECT message_id, t <> text AS had_override,
       md5('{L.UNTRUSTED_BEGIN}' || chr(10) || t || chr(10) || '{L.UNTRUSTED_END}') AS wrapped_md5 FROM n""")
def neutralize(spark, sf):
    return messages(spark, sf).select(
        "message_id", T.has_override(F.col("text")).alias("had_override"), digest(T.wrap_untrusted(F.col("text"))).alias("wrapped_md5")
    )


def _any_sql(patterns: list[str]) -> str:
    return "(?i)" + L.whole("|".join(patterns)).replace("'", "''")


@query("fk12_reply_flags", with_(TURNS_SQL) + f"""
SELECT session_id, turn, regexp_matches(text, '{_any_sql(L.META_PHRASES)}') AS meta_language,
       regexp_matches(text, '{_any_sql(L.LEAK_PHRASES)}') AS prompt_leak,
       {" + ".join(f"(CASE WHEN regexp_matches(text, '{_any_sql([p])}') THEN 1 ELSE 0 END)" for p in L.META_PHRASES)} AS n_meta_patterns
FROM turns""")
def reply_flags(spark, sf):
    return turns(spark, sf).select(
        "session_id", "turn", R.is_meta_language(F.col("text")).alias("meta_language"),
        R.is_prompt_leak(F.col("text")).alias("prompt_leak"), F.size(R.meta_hits(F.col("text"))).alias("n_meta_patterns"),
    )


def _strip_meta_sql(expr: str) -> str:
    for p in L.REPLY_PREFIXES:
        expr = f"regexp_replace({expr}, '(?i)^(?:{p.replace(chr(39), chr(39) * 2)}[.,!?]?[{SP}]*)+', '')"
    for a in L.REPLY_ASIDES:
        expr = f"regexp_replace({expr}, '(?i)[{SP}]*\\([^\\n]*?{a}[^\\n]*?\\)', '', 'g')"
    return sql_strip(expr)


@query("fk13_sanitize_reply", with_(
    TURNS_SQL,
    f"""a AS (SELECT session_id, turn, text, {sql_strip('text')} = '' AS blank, regexp_matches(text, '{_any_sql(L.LEAK_PHRASES)}') AS leak,
         regexp_matches(text, '{_any_sql(L.META_PHRASES)}') AS meta, {_strip_meta_sql('text')} AS cleaned FROM turns)""",
    "b AS (SELECT *, CASE WHEN meta THEN cleaned ELSE text END AS kept FROM a)",
    f"""c AS (SELECT *, list_filter(list_transform(string_split_regex(kept, '[.!?]+'), lambda x: {sql_strip('x')}), lambda x: x <> '') AS parts FROM b)""",
    "d AS (SELECT *, CASE WHEN len(parts) > 2 THEN array_to_string(parts[1:2], '. ') || '.' ELSE kept END AS final FROM c)",
    "e AS (SELECT *, CASE WHEN length(final) > 200 THEN left(final, 197) || '...' ELSE final END AS short FROM d)",
) + """
SELECT session_id, turn, CASE WHEN blank OR leak OR (meta AND length(cleaned) < 3) OR length(short) < 2 THEN 'ok tell me more' ELSE short END AS reply FROM e""")
def sanitize_reply(spark, sf):
    return turns(spark, sf).select("session_id", "turn", R.sanitize(F.col("text"), F.lit("ok tell me more")).alias("reply"))


def _sum_sql(col: str, words: list[str]) -> str:
    return "(" + " + ".join(f"contains({col}, {quote(w)})::INT" for w in words) + ")"


@query("fk14_behaviour_profile", with_(
    TURNS_SQL,
    f"a AS (SELECT session_id, turn, text, lower(text) AS low, {sql_strip('text')} AS t FROM turns)",
    f"""b AS (SELECT *, {_sum_sql('low', L.AGGRESSION_WORDS)} AS aggr, {_sum_sql('low', L.FRUSTRATION_WORDS)} AS frus,
         CASE WHEN t = '' THEN 0 ELSE len(string_split_regex(t, '[{SP}]+')) END AS words FROM a)""",
) + """
SELECT session_id, turn, CASE WHEN aggr >= 1 OR (upper(text) = text AND low <> text) THEN 'HIGH' ELSE 'LOW' END AS aggression,
       CASE WHEN frus = 0 THEN 'HIGH' ELSE 'LOW' END AS patience, CASE WHEN words > 20 AND aggr = 0 THEN 'HIGH' ELSE 'LOW' END AS sophistication FROM b""")
def behaviour_profile(spark, sf):
    return turns(spark, sf).select("session_id", "turn", R.behaviour_profile(F.col("text")).alias("p")).select("session_id", "turn", "p.*")


@query("fk15_new_information", with_(TURNS_SQL) + f"""
SELECT session_id, turn, regexp_matches(text, '\\p{{Nd}}{{10,12}}') AS has_phone, regexp_matches(text, '[{W}]@[{W}]') AS has_upi,
       regexp_matches(text, '\\p{{Nd}}{{10,18}}') AS has_bank, regexp_matches(text, 'https?://') AS has_link,
       regexp_matches(text, '(?i)rs\\.?[{SP}]*\\p{{Nd}}') AS mentioned_amount, {_sum_sql('lower(text)', L.NEW_INFO_URGENCY)} > 0 AS shows_urgency
FROM turns""")
def new_information(spark, sf):
    return turns(spark, sf).select("session_id", "turn", R.new_information(F.col("text")).alias("p")).select("session_id", "turn", "p.*")


@query("ft1_flexible_timestamp", """
WITH raw AS (SELECT event_id, CASE event_id % 6
    WHEN 0 THEN epoch(ts)::BIGINT::VARCHAR WHEN 1 THEN epoch_ms(ts)::VARCHAR
    WHEN 2 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') WHEN 3 THEN strftime(ts, '%Y-%m-%d %H:%M:%S+05:30')
    WHEN 4 THEN 'not a time' ELSE strftime(ts, '%Y-%m-%d') END AS raw, ts FROM events)
SELECT event_id, CASE event_id % 6
    WHEN 0 THEN epoch(ts)::BIGINT WHEN 1 THEN epoch_ms(ts) // 1000 WHEN 2 THEN floor(epoch(ts))::BIGINT
    WHEN 3 THEN floor(epoch(ts))::BIGINT - 19800 WHEN 4 THEN 0 ELSE epoch(date_trunc('day', ts))::BIGINT END AS epoch_seconds FROM raw""")
def flexible_timestamp(spark, sf):
    from lurewatch.plans.registry import table

    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    slot = F.col("event_id") % 6
    raw = (
        F.when(slot == 0, F.round(F.unix_micros("ts") / 1e6).cast("bigint").cast("string"))
        .when(slot == 1, F.unix_millis("ts").cast("string"))
        .when(slot == 2, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
        .when(slot == 3, F.date_format("ts", "yyyy-MM-dd HH:mm:ss'+05:30'"))
        .when(slot == 4, F.lit("not a time"))
        .otherwise(F.date_format("ts", "yyyy-MM-dd"))
    )
    parsed = Y.flexible_timestamp(raw, F.timestamp_seconds(F.lit(0)))
    return e.select("event_id", F.unix_seconds(parsed).alias("epoch_seconds"))


_REPLY_SQL = """replies AS (SELECT event_id, CASE event_id % 4
    WHEN 0 THEN '```json' || chr(10) || '{"isScam": true, "confidence": 0.' || (event_id % 90 + 10)::VARCHAR || ', "scamType": "' || event_type || '"}' || chr(10) || '```'
    WHEN 1 THEN '{"isScam": false}' WHEN 2 THEN 'Sure: ``` {"confidence": 0.25, "indicators": ["a", "b"]} ``` done' ELSE 'no json here' END AS reply, event_type FROM events)"""


@query("fj1_parse_opinion_reply", f"WITH {_REPLY_SQL}" + """
SELECT event_id, CASE event_id % 4 WHEN 0 THEN true ELSE false END AS is_scam,
       CASE event_id % 4 WHEN 0 THEN ('0.' || (event_id % 90 + 10)::VARCHAR)::DOUBLE WHEN 1 THEN 0.5 ELSE 0.25 END AS confidence,
       CASE event_id % 4 WHEN 0 THEN event_type ELSE 'other' END AS scam_type,
       CASE event_id % 4 WHEN 2 THEN 2 ELSE 0 END AS n_indicators
FROM replies WHERE event_id % 4 <> 3""")
def parse_opinion_reply(spark, sf):
    from lurewatch.plans.registry import table

    e = table(spark, sf, "events")
    slot = F.col("event_id") % 4
    reply = (
        F.when(slot == 0, F.concat(F.lit('```json\n{"isScam": true, "confidence": 0.'), (F.col("event_id") % 90 + 10).cast("string"),
                                   F.lit(', "scamType": "'), F.col("event_type"), F.lit('"}\n```')))
        .when(slot == 1, F.lit('{"isScam": false}'))
        .when(slot == 2, F.lit('Sure: ``` {"confidence": 0.25, "indicators": ["a", "b"]} ``` done'))
        .otherwise(F.lit("no json here"))
    )
    o = e.select("event_id", Y.parse_opinion(reply).alias("o")).filter(F.col("o").isNotNull())
    return o.select("event_id", "o.is_scam", "o.confidence", "o.scam_type", F.size("o.indicators").alias("n_indicators"))
