"""Streaming operators run over the given tables to completion."""

from __future__ import annotations

from pyspark.sql import functions as F

from lurewatch import schemas
from lurewatch.operators.reports import has_content
from lurewatch.plans.detection_queries import TO_PATTERN
from lurewatch.plans.inputs import MESSAGES_SQL, SIGHTINGS_SQL, messages_from, occurrences_from, sightings_from, turns_from, with_
from lurewatch.plans.intel_queries import EMA_SQL, TO_IND, TO_MATCH
from lurewatch.plans.registry import query, table
from lurewatch.plans.report_queries import investigate
from lurewatch.plans.session_queries import PROGRESS_SQL, ROLLUP_SQL, TO_VALUES
from lurewatch.plans.store_queries import _FEED_SQL, _feed_payloads
from lurewatch.session import scratch_path
from lurewatch.streaming import streams as ST


def _stream(spark, sf, name):
    return ST.file_stream(spark, sf, name, table(spark, sf, name).schema)


def _to_files(spark, df, label, mode="append"):
    """Run a stream into a parquet folder and read it back."""
    path = scratch_path(spark, label)
    if mode == "append":
        ST.run_available(df.writeStream.format("parquet").option("path", f"{path}/out"), f"{path}/cp")
    else:
        def write(batch, epoch):
            batch.write.mode("overwrite").parquet(f"{path}/out/epoch={epoch}")

        ST.run_available(df.writeStream.outputMode(mode).foreachBatch(write), f"{path}/cp")
    return spark.read.parquet(f"{path}/out")


def _batches(spark, df, handler, label, *names):
    root = scratch_path(spark, label)
    ST.run_available(df.writeStream.foreachBatch(handler(root)), f"{root}/cp")
    return [spark.read.parquet(f"{root}/{n}") for n in names] if names else root


def _deliveries(spark, df, keys, ttl, label):
    """(keys, ts, n, let_through) of a stream's deliveries."""
    (judged,) = _batches(spark, df, lambda root: ST.deliveries_batch(root, keys, ttl), label, "judged")
    return judged


@query("t1_redelivery_dedup", """
SELECT event_type AS platform, event_id AS message_id, epoch_us(ts) + wait * 1000000 AS ts_us FROM events, (VALUES (0::BIGINT), (3600::BIGINT)) AS w(wait)""")
def redelivery(spark, sf):
    """Every message again after 5, 14, 60 and 70 minutes: the one after an hour is past its TTL of 15 minutes, the last is not."""
    e = _stream(spark, sf, "events").withColumn("wait", F.explode(F.array(*map(F.lit, (0, 300, 840, 3600, 4200)))))
    copies = e.select(F.col("event_type").alias("platform"), F.col("event_id").alias("message_id"), (F.col("ts").cast("timestamp") + F.make_dt_interval(secs=F.col("wait"))).alias("ts"))
    judged = _deliveries(spark, copies, ["platform", "message_id"], 900, "dedup")
    return judged.filter("let_through").select("platform", "message_id", F.unix_micros("ts").alias("ts_us"))


_TTL_SQL = """WITH RECURSIVE d AS MATERIALIZED (SELECT event_type AS platform, user_id % 50 AS message_id, epoch_us(ts) AS t, count(*) AS n FROM events GROUP BY ALL),
chain AS (SELECT platform, message_id, min(t) AS t FROM d GROUP BY ALL
  UNION ALL SELECT c.platform, c.message_id, min(d.t) FROM chain c JOIN d ON d.platform = c.platform AND d.message_id = c.message_id AND d.t >= c.t + 86400000000 GROUP BY ALL)
SELECT d.platform, d.message_id, d.t AS ts_us, n, c.t IS NOT NULL AS let_through FROM d LEFT JOIN chain c ON c.platform = d.platform AND c.message_id = d.message_id AND c.t = d.t"""


@query("t1_redelivery_exact_ttl", _TTL_SQL)
def redelivery_exact(spark, sf):
    """Few keys with long chains of deliveries, each let through a day after the last."""
    e = _stream(spark, sf, "events").select(F.col("event_type").alias("platform"), (F.col("user_id") % 50).alias("message_id"), F.col("ts").cast("timestamp").alias("ts"))
    judged = _deliveries(spark, e, ["platform", "message_id"], 24 * 3600, "ttl")
    return judged.select("platform", "message_id", F.unix_micros("ts").alias("ts_us"), "n", "let_through")


@query("t2_rate_limit", """WITH RECURSIVE c AS MATERIALIZED (SELECT event_type AS caller, event_id AS seq, epoch_us(ts) AS t, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn FROM events),
walk AS (SELECT caller, seq, rn, true AS allowed, [t] AS kept FROM c WHERE rn = 1
  UNION ALL SELECT caller, seq, rn, len(k) < 3, CASE WHEN len(k) < 3 THEN list_append(k, t) ELSE k END
  FROM (SELECT c.caller, c.seq, c.rn, c.t, list_filter(w.kept, lambda x: c.t - x < 3600000000) AS k FROM walk w JOIN c ON c.caller = w.caller AND c.rn = w.rn + 1))
SELECT caller, seq, allowed FROM walk""")
def rate_limit(spark, sf):
    """Three calls an hour and caller."""
    e = _stream(spark, sf, "events").select(F.col("event_type").alias("caller"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"))
    (calls,) = _batches(spark, e, lambda root: ST.admission_batch(root, limit=3, window=3600), "rate", "calls")
    return calls.select("caller", "seq", "allowed")


def _sessions(spark, sf, label, conversations=None):
    conversations = _stream(spark, sf, "conversations") if conversations is None else conversations
    (snapshots,) = _batches(spark, turns_from(conversations), ST.sessions_batch, label, "snapshots")
    return ST.current_sessions(snapshots)


@query("t3_session_state", with_(*TO_VALUES, PROGRESS_SQL, ROLLUP_SQL) + "SELECT session_id, message_count, score::BIGINT AS intel_score, done AS is_complete, coalesce(completed_turn, -1) AS completed_turn FROM roll")
def session_state(spark, sf):
    return _sessions(spark, sf, "sessions").select("session_id", "message_count", "intel_score", "is_complete", F.coalesce("completed_turn", F.lit(-1)).alias("completed_turn"))


@query("t4_session_completions", with_(*TO_VALUES, PROGRESS_SQL, ROLLUP_SQL) + "SELECT session_id, completed_at AS message_count, completed_score AS intel_score FROM roll WHERE done")
def session_completions(spark, sf):
    return ST.completions(_sessions(spark, sf, "completions"))


_LONG_SQL = "long_conversations AS (SELECT conv_id // 12 AS conv_id, conv_id % 12 * 50 + turn AS turn, role, text FROM conversations)"
_LONG_TURNS = (_LONG_SQL, TO_VALUES[0].replace("FROM conversations", "FROM long_conversations"), *TO_VALUES[1:])


@query("t4_long_session_completions", with_(*_LONG_TURNS, PROGRESS_SQL, ROLLUP_SQL) + "SELECT session_id, completed_at AS message_count, completed_score AS intel_score FROM roll WHERE done")
def long_session_completions(spark, sf):
    """Twelve conversations on end make a session, long enough for every rule of completion."""
    c = _stream(spark, sf, "conversations").withColumn("turn", (F.col("conv_id") % 12 * 50 + F.col("turn")).cast("int")).withColumn("conv_id", F.floor(F.col("conv_id") / 12))
    return ST.completions(_sessions(spark, sf, "long-completions", c))


@query("t5_incremental_correlation", with_(*TO_MATCH) + """
SELECT investigation_id, kind, value, n_prior, epoch_us(first_seen) AS first_seen_us, campaign_id FROM matched""")
def incremental_correlation(spark, sf):
    (m,) = _batches(spark, occurrences_from(_stream(spark, sf, "events")), ST.correlate_batch, "correlate", "matches")
    return m.select("investigation_id", "kind", "value", "n_prior", F.unix_micros("first_seen").alias("first_seen_us"), "campaign_id")


@query("t5_incremental_rollup", with_(*TO_IND) + "SELECT kind, value_hash, epoch_us(min(ts)) AS first_seen_us, epoch_us(max(ts)) AS last_seen_us, count(*) AS occurrence_count FROM ind GROUP BY kind, value_hash")
def incremental_rollup(spark, sf):
    c = ST.current_rollup(spark, _batches(spark, occurrences_from(_stream(spark, sf, "events")), ST.correlate_batch, "rollup"))
    return c.select("kind", "value_hash", F.unix_micros("first_seen").alias("first_seen_us"), F.unix_micros("last_seen").alias("last_seen_us"), "occurrence_count")


@query("t6_incremental_reputation", with_(SIGHTINGS_SQL, EMA_SQL) + "SELECT domain, round(reputation_score + 1e-9, 6) AS reputation_score, sightings FROM ema")
def incremental_reputation(spark, sf):
    root = _batches(spark, sightings_from(_stream(spark, sf, "events")), ST.reputation_batch, "ema")
    return ST.current_reputation(spark, root).select("domain", F.round(F.col("reputation_score") + 1e-9, 6).alias("reputation_score"), "sightings")


@query("t7_exactly_once_jobs", with_(MESSAGES_SQL) + """
SELECT CASE WHEN message_id % 17 <> 0 THEN 'report' ELSE 'dead_letter' END AS what, message_id::VARCHAR AS investigation_id FROM messages""")
def exactly_once(spark, sf):
    m = messages_from(_stream(spark, sf, "documents")).withColumn("text", F.when(F.col("message_id") % 17 == 0, F.lit(" ")).otherwise(F.col("text")))
    m = m.withColumn("investigation_id", F.col("message_id"))
    none = F.array().cast("array<string>")

    def job(df):
        return investigate(df, normalize=False)

    reports, dead = _batches(spark, m, lambda root: ST.investigation_batch(root, job, has_content(F.col("text"), none, none)), "jobs", "reports", "dead_letters")
    return reports.select(F.lit("report").alias("what"), F.col("investigation_id").cast("string").alias("investigation_id")).unionByName(
        dead.select(F.lit("dead_letter").alias("what"), F.col("target_id").cast("string").alias("investigation_id")))


@query("t8_feed_snapshot", f"WITH {_FEED_SQL.replace('WHERE', 'WHERE page_id // 40 = (SELECT max(page_id // 40) FROM pages) AND')} SELECT * FROM feed")
def feed_snapshot(spark, sf):
    """Polls of forty entries every six minutes, each asked for again while it is fresh, then an unreadable one; the last taken is the feed."""
    src = scratch_path(spark, "polls")
    entry = F.from_json("payload", schemas.FEED)["urls"][0]
    entries = _feed_payloads(spark, sf, "page_id").select((F.floor(F.col("page_id") / 40) * 360).alias("polled_at"), entry.alias("e"))
    polls = entries.groupBy("polled_at").agg(F.to_json(F.struct(F.collect_list("e").alias("urls"))).alias("payload"))  # forty entries at most
    again = polls.withColumn("polled_at", F.col("polled_at") + 100).withColumn("payload", F.lit('{"urls": [{"url": "http://too.soon.example/"}]}'))
    polls = polls.unionByName(again).unionByName(polls.agg((F.max("polled_at") + 360).alias("polled_at")).withColumn("payload", F.lit("<html>busy</html>")))
    polls.repartitionByRange(4, "polled_at").write.parquet(src)
    (kept,) = _batches(spark, spark.readStream.schema(polls.schema).parquet(src), ST.feed_batch, "feed", "polls")
    return ST.current_feed(kept)


@query("t9_streaming_scores", with_(*TO_PATTERN) + "SELECT message_id, risk_score, scam_type, is_scam FROM pattern")
def streaming_scores(spark, sf):
    scored = ST.score_messages(messages_from(_stream(spark, sf, "documents"))).select("message_id", "risk_score", "scam_type", "is_scam")
    return _to_files(spark, scored, "scores")
