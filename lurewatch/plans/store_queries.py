"""Sources, sinks, table maintenance and corpus queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lurewatch import lexicon as L
from lurewatch.operators import corpus as C
from lurewatch.operators import evidence as EV
from lurewatch.operators import fusion as FU
from lurewatch.operators import maintenance as M
from lurewatch.plans.inputs import (
    EVIDENCE_SQL, INVESTIGATIONS_SQL, MESSAGES_SQL, SIGNALS_SQL, TURNS_SQL, evidence_rows, investigations, messages, quote, signals, sql_list, turns, with_,
)
from lurewatch.plans.intel_queries import FUSED_SQL, WEIGHTED_SQL
from lurewatch.plans.registry import query, table
from lurewatch.session import scratch_path
from lurewatch.sources import readers as R
from lurewatch.sources import sinks as K
from lurewatch.sources.keyed import KeyedTable

# -- sources -----------------------------------------------------------------


@query("s1_labelled_examples", """
SELECT CASE WHEN toxic = 1 THEN 'phishing' ELSE 'benign' END AS label, toxic = 1 AS is_scam, count(*) AS n, sum(length(text))::BIGINT AS n_chars FROM labels JOIN documents USING (doc_id) GROUP BY ALL""")
def labelled_examples(spark, sf):
    j = table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id")
    example = F.struct("text", F.when(F.col("toxic") == 1, "phishing").otherwise("benign").alias("label"), (F.col("toxic") == 1).alias("is_scam"))
    path = scratch_path(spark, "examples")
    j.select(F.to_json(F.struct(F.lit("training").alias("purpose"), F.array(example).alias("examples")))).write.text(path)
    e = R.labelled_examples(spark, path, multi_line=False)
    return e.groupBy("label", "is_scam").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("n_chars"))


@query("s2_paraphrase_pairs", """
SELECT 'p' || item_id::VARCHAR AS pair_id, 'known' AS half, md5(text) AS text_md5, true AS is_scam FROM benchmark
UNION ALL SELECT 'p' || item_id::VARCHAR, 'unseen', md5('~' || text), item_id % 2 = 0 FROM benchmark""")
def paraphrase_pairs(spark, sf):
    b = table(spark, sf, "benchmark")
    half = lambda t, s: F.struct(t.alias("text"), s.alias("is_scam"))
    pair = F.struct(F.concat(F.lit("p"), F.col("item_id").cast("string")).alias("id"), half(F.col("text"), F.lit(True)).alias("known"),
                    half(F.concat(F.lit("~"), F.col("text")), F.col("item_id") % 2 == 0).alias("unseen"))
    path = scratch_path(spark, "pairs")
    b.select(F.to_json(F.struct(F.array(pair).alias("pairs")))).write.text(path)
    return R.paraphrase_pairs(spark, path, multi_line=False).select("pair_id", "half", F.md5("text").alias("text_md5"), "is_scam")


def _session_payloads(spark, sf):
    """One legacy session per turn, as JSON text."""
    t = turns(spark, sf)
    sid = F.concat(F.lit("s"), F.col("session_id").cast("string"), F.lit("_"), F.col("turn").cast("string"))
    intel = F.struct(
        F.when(F.col("turn") % 2 == 0, F.array(F.lit("a@ybl"), F.concat(F.lit("b"), F.col("session_id").cast("string"), F.lit("@ybl")))).alias("upiIds"),
        F.when(F.col("turn") % 3 == 0, F.array(F.lit("9876543210"))).alias("phoneNumbers"),
    )
    session = F.struct(
        (F.col("turn") % 2 == 0).alias("scamDetected"), F.lit("upi_fraud").alias("scamType"),
        F.array(F.struct("sender", "text", F.unix_seconds("ts").cast("string").alias("timestamp"))).alias("conversationHistory"),
        intel.alias("extractedIntelligence"), F.unix_millis("ts").cast("string").alias("startTime"),
    )
    return t.select(F.to_json(F.struct(F.create_map(sid, session).alias("sessions"))).alias("payload"))


_SESSION_SQL = """sess AS (SELECT 's' || session_id::VARCHAR || '_' || turn::VARCHAR AS id, turn % 2 = 0 AS scam, CASE WHEN turn % 2 = 0 THEN 2 ELSE 0 END AS n_upi,
  CASE WHEN turn % 3 = 0 THEN 1 ELSE 0 END AS n_phone, sender, text, ts FROM turns)"""


@query("s3_s14_import_sessions", with_(TURNS_SQL, _SESSION_SQL) + """
SELECT id, CASE WHEN scam THEN 'scam' ELSE 'likely_safe' END AS verdict, (CASE WHEN scam THEN least(100, n_upi * 30 + n_phone * 20) ELSE 0 END)::INT AS risk_score,
  epoch(ts)::BIGINT AS created, epoch(ts + INTERVAL 90 DAY)::BIGINT AS purge, n_upi + n_phone AS n_entities, 1 AS n_messages FROM sess""")
def import_sessions(spark, sf):
    path = scratch_path(spark, "legacy")
    _session_payloads(spark, sf).write.text(path)
    s = R.sessions_from_json(spark.read.text(path).withColumnRenamed("value", "payload"))
    root = scratch_path(spark, "evidence")
    for _ in range(2):  # the import may be repeated
        K.log_sessions(s, root)
    stored = K.evidence_tables(spark, root)
    inv = stored["investigations"].read()
    ent = stored["entities"].read().groupBy("investigation_id").agg(F.count("*").alias("n_entities"))
    msg = stored["messages"].read().groupBy("investigation_id").agg(F.count("*").alias("n_messages"))
    j = inv.join(ent, inv["id"] == ent["investigation_id"], "left").drop("investigation_id").join(msg, inv["id"] == msg["investigation_id"])
    return j.select("id", "verdict", "risk_score", F.unix_seconds("created_at").alias("created"), F.unix_seconds("purge_at").alias("purge"),
                    F.coalesce("n_entities", F.lit(0)).alias("n_entities"), "n_messages")


def _feed_payloads(spark, sf, *keys):
    p = table(spark, sf, "pages")
    entry = F.struct(
        F.when(F.col("page_id") % 5 != 0, F.col("url")).alias("url"), F.when(F.col("page_id") % 3 != 0, F.lit("h.example")).alias("host"),
        F.when(F.col("page_id") % 2 == 0, F.lit("malware")).alias("threat"), F.format_string("2024-01-%02d", (F.col("page_id") % 28 + 1)).alias("date_added"),
    )
    return p.select(*keys, F.to_json(F.struct(F.array(entry).alias("urls"))).alias("payload"))


_FEED_SQL = """feed AS (SELECT url, CASE WHEN page_id % 3 <> 0 THEN 'h.example' ELSE '' END AS host, CASE WHEN page_id % 2 = 0 THEN 'malware' ELSE 'unknown' END AS threat,
  printf('2024-01-%02d', page_id % 28 + 1) AS date_added FROM pages WHERE page_id % 5 <> 0)"""


@query("s4_feed_entries", f"WITH {_FEED_SQL} SELECT * FROM feed")
def feed_entries(spark, sf):
    return R.feed_entries(_feed_payloads(spark, sf))


@query("o2_recent_feed", f"WITH {_FEED_SQL} SELECT * FROM feed ORDER BY date_added DESC, url LIMIT 20")
def recent_feed(spark, sf):
    return R.feed_entries(_feed_payloads(spark, sf)).orderBy(F.desc("date_added"), "url").limit(20)


@query("s5_bot_updates", """
SELECT 'telegram' AS platform, (100 + doc_id % 7)::VARCHAR AS user_id, CASE WHEN doc_id % 4 = 0 THEN 'text' ELSE CASE WHEN doc_id % 4 = 3 THEN 'pdf' ELSE 'mixed' END END AS content_type,
  CASE WHEN doc_id % 4 = 3 THEN '' ELSE md5(text) END AS text_md5, CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'telegram:big' WHEN 2 THEN 'telegram:v1' ELSE 'telegram:d1' END AS uris, doc_id::VARCHAR AS message_id
FROM documents WHERE doc_id % 13 <> 0""")
def bot_updates(spark, sf):
    d = table(spark, sf, "documents")
    k = F.col("doc_id")
    file = lambda i, n, m: F.struct(F.lit(i).alias("file_id"), F.lit(n).alias("file_size"), F.lit(m).alias("mime_type"))
    msg = F.struct(
        k.alias("message_id"), F.when(k % 13 != 0, F.struct((k % 3 + 1).alias("id"))).alias("chat"), F.struct((k % 7 + 100).alias("id"), F.lit("u").alias("username")).alias("from"),
        F.when(k % 4 == 0, F.col("text")).alias("text"), F.when((k % 4 == 1) | (k % 4 == 2), F.col("text")).alias("caption"),
        F.when(k % 4 == 1, F.array(file("small", 10, ""), file("big", 20, ""))).alias("photo"),
        F.when(k % 4 == 3, file("d1", 5, "application/pdf")).alias("document"), F.when(k % 4 == 2, file("v1", 7, "audio/ogg")).alias("voice"),
    )
    out = R.bot_updates(d.select(F.to_json(F.struct(k.alias("update_id"), msg.alias("message"))).alias("payload")))
    return out.select("platform", "user_id", "content_type", F.coalesce(F.md5("text"), F.lit("")).alias("text_md5"),
                      F.array_join(F.transform("media", lambda m: m["uri"]), ",").alias("uris"), "message_id")


@query("s6_hook_messages", """
SELECT 'whatsapp' AS platform, 'n' || (doc_id % 9)::VARCHAR AS user_id, 'm' || doc_id::VARCHAR AS message_id,
  CASE doc_id % 3 WHEN 0 THEN 'text' WHEN 1 THEN 'mixed' ELSE 'image' END AS content_type, CASE WHEN doc_id % 3 = 2 THEN '' ELSE md5(text) END AS text_md5, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 1 END AS n_media
FROM documents""")
def hook_messages(spark, sf):
    d = table(spark, sf, "documents")
    k = F.col("doc_id")
    block = lambda m, c: F.struct(F.lit("id1").alias("id"), F.lit(m).alias("mime_type"), c.alias("caption"))
    message = F.struct(
        F.concat(F.lit("n"), (k % 9).cast("string")).alias("from"), F.concat(F.lit("m"), k.cast("string")).alias("id"),
        F.when(k % 3 == 0, "text").when(k % 3 == 1, "image").otherwise("document").alias("type"),
        F.when(k % 3 == 0, F.struct(F.col("text").alias("body"))).alias("text"), F.when(k % 3 == 1, block("image/png", F.col("text"))).alias("image"),
        F.when(k % 3 == 2, block("image/jpeg", F.lit(None).cast("string"))).alias("document"),
    )
    value = F.struct(F.struct(F.lit("pn").alias("phone_number_id")).alias("metadata"), F.array(message).alias("messages"))
    hook = F.struct(F.array(F.struct(F.array(F.struct(value.alias("value"))).alias("changes"))).alias("entry"))
    out = R.hook_messages(d.select(F.to_json(hook).alias("payload")))
    return out.select("platform", "user_id", "message_id", "content_type", F.coalesce(F.md5("text"), F.lit("")).alias("text_md5"), F.size("media").alias("n_media"))


@query("s7_api_calls", """
SELECT 'api' AS platform, 'c' || conv_id::VARCHAR AS session_id, CASE WHEN turn % 3 = 0 THEN 'text' ELSE 'mixed' END AS content_type,
  CASE turn % 3 WHEN 1 THEN 'http://i/x.png' WHEN 2 THEN 'http://i/meta.jpg' ELSE '' END AS uri, CASE turn % 3 WHEN 1 THEN 'image/png' WHEN 2 THEN 'image/jpeg' ELSE '' END AS mime, md5(text) AS text_md5,
  1700000000 + turn AS ts FROM conversations WHERE text <> ''""")
def api_calls(spark, sf):
    c = table(spark, sf, "conversations").filter("text <> ''")
    k = F.col("turn")
    message = F.struct(F.col("role").alias("sender"), "text", (k + 1700000000).cast("string").alias("timestamp"), F.lit("  ").alias("image"),
                       F.when(k % 3 == 1, F.lit(" http://i/x.png ")).alias("image_url"))
    meta = F.when(k % 3 == 2, F.create_map(F.lit("media_url"), F.lit("http://i/meta.jpg")))
    call = F.struct(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("sessionId"), message.alias("message"), meta.alias("metadata"))
    out = R.api_calls(c.select(F.to_json(call).alias("payload")))
    first = F.try_element_at("media", F.lit(1))
    return out.select("platform", "session_id", "content_type", F.coalesce(first["uri"], F.lit("")).alias("uri"), F.coalesce(first["mime_type"], F.lit("")).alias("mime"),
                      F.md5("text").alias("text_md5"), F.unix_seconds("ts").alias("ts"))


_HEADS = [c for c, _, _ in L.MAGIC_NUMBERS] + ["5249464600000000" + c for c, _, _ in L.RIFF_TYPES] + [""]
_TYPES = [k for _, _, k in L.MAGIC_NUMBERS] + [k for _, _, k in L.RIFF_TYPES]
_MIMES = [m for _, m, _ in L.MAGIC_NUMBERS] + [m for _, m, _ in L.RIFF_TYPES]


@query("s8_sniff_attachments", f"""
SELECT doc_id, {_MIMES}[(doc_id % 11 + 1)::INT] AS mime, {_TYPES}[(doc_id % 11 + 1)::INT] AS kind FROM documents""")
def sniff_attachments(spark, sf):
    d = table(spark, sf, "documents")
    head = F.unhex(F.try_element_at(F.lit(_HEADS), (F.col("doc_id") % 11 + 1).cast("int")))
    body = F.concat(head, F.encode(F.concat(F.lit("~"), F.col("text")), "UTF-8"))
    return d.select("doc_id", R.sniff(body).alias("s")).select("doc_id", "s.mime", "s.kind")


@query("s8_attachment_files", f"""
WITH f AS (SELECT s_suppkey, CASE WHEN s_suppkey = 0 THEN 10485761 ELSE strlen({_HEADS}[(s_suppkey % 11 + 1)::INT]) // 2 + 1 + strlen(s_name) END AS length FROM supplier)
SELECT s_suppkey, length::BIGINT AS length, CASE WHEN s_suppkey > 0 THEN {_MIMES}[(s_suppkey % 11 + 1)::INT] END AS mime,
       CASE WHEN s_suppkey > 0 THEN {_TYPES}[(s_suppkey % 11 + 1)::INT] END AS kind,
       CASE WHEN s_suppkey = 0 THEN 'too_large' WHEN s_suppkey % 11 = 10 THEN 'unsupported_media' END AS rejection FROM f""")
def attachment_files(spark, sf):
    """A file for each supplier, of all ten types and of none; one is a byte over the limit."""
    d = table(spark, sf, "supplier")
    head = F.unhex(F.try_element_at(F.lit(_HEADS), (F.col("s_suppkey") % 11 + 1).cast("int")))
    body = F.concat(head, F.encode(F.concat(F.lit("~"), F.col("s_name")), "UTF-8"))
    body = F.when(F.col("s_suppkey") == 0, F.rpad(body, L.LIMITS["media_bytes"] + 1, F.lit(b"~"))).otherwise(body)
    folder = scratch_path(spark, "attachments")
    K.write_files(d.select(F.format_string("supplier %d.bin", "s_suppkey").alias("name"), body.alias("content")), folder)
    key = F.regexp_extract("path", r"(\d+)\.bin$", 1).cast("long")
    return R.attachments(spark, folder).select(key.alias("s_suppkey"), "length", "mime", "kind", "rejection")


# -- sinks -------------------------------------------------------------------

@query("s9_s10_u4_report_upsert", with_(INVESTIGATIONS_SQL) + "SELECT id AS investigation_id, CASE WHEN risk_score > 50 THEN risk_score + 1000 ELSE risk_score END AS risk_score FROM investigations")
def report_upsert(spark, sf):
    r = investigations(spark, sf).select(F.col("id").alias("investigation_id"), "risk_score")
    stored = KeyedTable(spark, scratch_path(spark, "reports"), ("investigation_id",)).create(r)
    changed = r.filter("risk_score > 50").withColumn("risk_score", F.col("risk_score") + 1000)
    for _ in range(2):  # a replay must not change the outcome
        stored.replace(changed, version=1)
    stored.compact()
    return stored.read()


@query("s10_report_lookup", with_(INVESTIGATIONS_SQL) + "SELECT id, risk_score FROM investigations WHERE id = 'inv_42'")
def report_lookup(spark, sf):
    return investigations(spark, sf).filter(F.col("id") == "inv_42").select("id", "risk_score")


@query("s11_signal_replay", with_(SIGNALS_SQL, WEIGHTED_SQL, FUSED_SQL) + "SELECT investigation_id, round(risk_score, 9) AS risk_score FROM fused")
def signal_replay(spark, sf):
    """Stored signals fuse to the same number later."""
    path = scratch_path(spark, "signals")
    s = FU.attach_weights(signals(spark, sf)).withColumn("day", F.to_date("ts"))
    K.append(s, path, ["day"])
    return FU.fuse(spark.read.parquet(path), digits=9).select("investigation_id", "risk_score")


@query("s12_audit_trail", with_(INVESTIGATIONS_SQL) + """
SELECT 'analyst' AS actor, 'view' AS action, id AS target_id FROM investigations WHERE id = 'inv_7' UNION ALL SELECT 'analyst', 'export', id FROM investigations WHERE id = 'inv_7'""")
def audit_trail(spark, sf):
    path = scratch_path(spark, "audit")
    ids = investigations(spark, sf).select(F.col("id").alias("investigation_id"))
    for action in ("view", "export"):
        K.append(M.audit_rows(ids, "analyst", action, "review"), path)
    trail = spark.read.parquet(path).filter((F.col("target_type") == "investigation") & (F.col("target_id") == "inv_7"))
    return trail.select("actor", "action", "target_id")


_RUNS_SQL = """runs AS (SELECT ['local', 'hosted', 'vision'][(event_id % 3 + 1)::INT] AS provider, event_type AS stage, event_id % 10 = 0 AS failed, event_id % 500 AS prompt_tokens, event_id % 90 AS completion_tokens FROM events)"""


@query("s13_a23_model_usage", f"WITH {_RUNS_SQL}" + """
SELECT provider, count(*) AS requests, count(*) FILTER (failed) AS failures, sum(prompt_tokens)::BIGINT AS prompt_tokens, sum(completion_tokens)::BIGINT AS completion_tokens FROM runs GROUP BY provider""")
def model_usage(spark, sf):
    e = table(spark, sf, "events")
    k = F.col("event_id")
    runs = e.select(F.try_element_at(F.lit(["local", "hosted", "vision"]), (k % 3 + 1).cast("int")).alias("provider"), F.col("event_type").alias("stage"),
                    (k % 10 == 0).alias("failed"), (k % 500).alias("prompt_tokens"), (k % 90).alias("completion_tokens"))
    path = scratch_path(spark, "runs")
    K.append(runs, path)
    return spark.read.parquet(path).groupBy("provider").agg(
        F.count("*").alias("requests"), F.count_if("failed").alias("failures"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens")
    )


@query("s15_register_pending", with_(INVESTIGATIONS_SQL) + "SELECT 'inv_' || l_orderkey::VARCHAR AS id FROM lineitem UNION SELECT id FROM investigations")
def register_pending(spark, sf):
    have = investigations(spark, sf).select("id")
    new = evidence_rows(spark, sf).select(F.col("investigation_id").alias("id"))
    return have.unionByName(M.add_missing(have, new, ["id"]))


@query("s16_declared_tables", with_(INVESTIGATIONS_SQL) + "SELECT platform, count(*) AS n, sum(risk_score)::BIGINT AS risk FROM investigations GROUP BY platform")
def declared_tables(spark, sf):
    root = scratch_path(spark, "base")
    investigations(spark, sf).write.parquet(f"{root}/investigations")
    return R.table(spark, root, "investigations").groupBy("platform").agg(F.count("*").alias("n"), F.sum("risk_score").alias("risk"))


# -- maintenance --------------------------------------------------------------

_NOW = "TIMESTAMP '1998-01-01 00:00:00'"
_GONE = f"gone AS (SELECT id FROM investigations WHERE purge_at <= {_NOW} AND evidence_state <> 'purged')"


_CHILDREN = """SELECT 'entities' AS what, investigation_id AS id, count(*)::VARCHAR AS value FROM evidence WHERE investigation_id NOT IN (SELECT id FROM {0}) GROUP BY investigation_id
UNION ALL SELECT 'messages', id, platform FROM investigations WHERE id NOT IN (SELECT id FROM {0}) UNION ALL SELECT 'reports', id, risk_score::VARCHAR FROM investigations WHERE id NOT IN (SELECT id FROM {0})
UNION ALL SELECT 'audit', id, '{1}' FROM {0} UNION ALL """


def _evidence_base(spark, sf):
    """Investigations and the tables that hang on them."""
    inv = investigations(spark, sf)
    key = F.col("id").alias("investigation_id")
    return inv, {"entities": evidence_rows(spark, sf), "messages": inv.select(key, "platform"), "reports": inv.select(key, "risk_score")}


def _stored_evidence(spark, sf, label):
    """The evidence tables, stored, and the path of their audit trail."""
    root = scratch_path(spark, label)
    inv, children = _evidence_base(spark, sf)
    tables = K.evidence_tables(spark, root)
    for name, df in ({"investigations": inv} | children).items():
        tables[name].create(df)
    return tables, f"{root}/audit"


def _survivors(out):
    one = lambda name, key, value: out[name].select(F.lit(name).alias("what"), F.col(key).alias("id"), F.col(value).cast("string").alias("value"))
    counted = out["entities"].groupBy("investigation_id").agg(F.count("*").cast("string").alias("value"))
    rows = counted.select(F.lit("entities").alias("what"), F.col("investigation_id").alias("id"), "value")
    for part in (one("messages", "investigation_id", "platform"), one("reports", "investigation_id", "risk_score"), one("audit", "target_id", "action"), one("investigations", "id", "evidence_state")):
        rows = rows.unionByName(part)
    return rows


@query("u5_retention_purge", with_(INVESTIGATIONS_SQL, EVIDENCE_SQL, _GONE) + _CHILDREN.format("gone", "purge") + f"""
SELECT 'investigations', id, CASE WHEN purge_at <= {_NOW} THEN 'purged' ELSE evidence_state END FROM investigations""")
def retention_purge(spark, sf):
    """Surviving rows of all tables after a purge and a second one, which adds nothing; only changes are written."""
    tables, audit = _stored_evidence(spark, sf, "purge")
    for _ in range(2):
        K.purge(tables, audit, F.lit("1998-01-01 00:00:00").cast("timestamp"))
    return _survivors({name: t.read() for name, t in tables.items()} | {"audit": spark.read.parquet(audit)})


@query("u6_owner_deletion", with_(INVESTIGATIONS_SQL, EVIDENCE_SQL, "mine AS (SELECT id FROM investigations WHERE user_id = 11)") + _CHILDREN.format("mine", "delete") + """
SELECT 'investigations', id, evidence_state FROM investigations WHERE user_id <> 11""")
def owner_deletion(spark, sf):
    tables, audit = _stored_evidence(spark, sf, "deletion")
    ids = tables["investigations"].read().filter("user_id = 11").select(F.col("id").alias("investigation_id"))
    K.delete_for_owner(tables, audit, ids, "user:11", "owner request")
    return _survivors({name: t.read() for name, t in tables.items()} | {"audit": spark.read.parquet(audit)})


@query("j4_unreported_requests", with_(MESSAGES_SQL) + "SELECT message_id FROM messages WHERE message_id NOT IN (SELECT doc_id FROM labels)")
def unreported(spark, sf):
    req = messages(spark, sf).select(F.col("message_id").alias("investigation_id"))
    done = table(spark, sf, "labels").select(F.col("doc_id").alias("investigation_id"))
    return M.unreported(req, done).select(F.col("investigation_id").alias("message_id"))


# -- corpora -------------------------------------------------------------------

@query("u1_corpus_overlap", """
WITH corpus AS (SELECT DISTINCT text FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)),
frozen AS (SELECT DISTINCT 'unlabelled' AS set_name, text FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT DISTINCT 'benchmark', text FROM benchmark UNION ALL SELECT DISTINCT 'conversations', text FROM conversations)
SELECT set_name, count(*) AS n_texts, count(c.text) AS n_overlap, count(c.text) = 0 AS passed FROM frozen f LEFT JOIN corpus c USING (text) GROUP BY set_name""")
def corpus_overlap(spark, sf):
    docs, lab = table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "labels").select("doc_id")
    named = lambda df, name: df.select(F.lit(name).alias("set_name"), "text")
    frozen = named(docs.join(lab, "doc_id", "left_anti"), "unlabelled").unionByName(named(table(spark, sf, "benchmark"), "benchmark"))
    return C.overlap(docs.join(lab, "doc_id", "left_semi"), frozen.unionByName(named(table(spark, sf, "conversations"), "conversations")))


@query("u3_first_by_text", "SELECT min(doc_id) AS doc_id, md5(text) AS text_md5 FROM documents GROUP BY text")
def first_by_text(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    return C.first_by_text(d, "doc_id").select("doc_id", F.md5("text").alias("text_md5"))


_SLOTS = [["asks you to", "urgently needs you to", "says you must"], ["share", "confirm", "read out"], ["the verification code", "your password", "the card number"], ["today.", "before noon.", "now."]]


@query("u7_corpus_grid", "WITH g AS (SELECT DISTINCT concat_ws(' ', c_name, a, b, c, d) AS text FROM (SELECT DISTINCT c_name FROM customer), " + ", ".join(
    f"(SELECT unnest({s}) AS {n})" for s, n in zip(_SLOTS, "abcd")) + ") SELECT text FROM g ORDER BY md5(text || '#7'), text LIMIT 200")
def corpus_grid(spark, sf):
    return C.grid(table(spark, sf, "customer").select(F.col("c_name").alias("sender")), _SLOTS, 200, 7)


#: Sentence slots of each label of the corpus: who, what, when.
_LABEL_SLOTS = {
    "benign": [["wishes you", "reminds you of", "writes about"], ["a calm week", "the garden day", "Sunday's match"], ["at noon.", "as agreed.", "with thanks."]],
    "mfa_code_theft": [["needs", "asks for", "waits for"], ["the six digits just sent", "your login code", "the code on your screen"], ["at once.", "before it lapses.", "to finish."]],
    "credential_access": [["wants", "requires", "must see"], ["your mailbox password", "the portal login", "your VPN phrase"], ["today.", "for the audit.", "or access ends."]],
    "social_engineering": [["says the chief needs", "begs for", "quietly requests"], ["a favour with vouchers", "help with a transfer", "your silence on a deal"], ["this hour.", "while travelling.", "before the call."]],
    "it_support_pretext": [["from the help desk will", "of IT has to", "at support wants to"], ["take over your desktop", "install a remote tool", "reset your profile"], ["now.", "after lunch.", "for an update."]],
    "bank_impersonation": [["of your bank's fraud team", "from card services", "at the branch"], ["asks for your card number", "blocks your account", "verifies your savings"], ["tonight.", "until you confirm.", "within the hour."]],
    "investment_fraud": [["doubles", "guarantees", "multiplies"], ["your deposit", "every coin you send", "a small stake"], ["in ten days.", "without risk.", "each night."]],
    "payment_fraud": [["sends a new account for", "re-directs", "demands"], ["the open invoice", "this month's rent", "the customs fee"], ["from now on.", "by wire only.", "at once."]],
    "phishing": [["links you to", "urges you to open", "shares"], ["a parcel page", "a refund form", "a locked document"], ["before midnight.", "to keep it.", "with your login."]],
}


def _drawn_sql(place, label):
    slots = _LABEL_SLOTS[label]
    radix = "".join(f" * {len(v)}" for v in slots)
    digit, parts = "number // s", []
    for v in slots:
        parts.append(f"{sql_list(v)}[({digit}) % {len(v)} + 1]")
        digit = f"({digit}) // {len(v)}"
    return f"""SELECT '{label}' AS label, number % s + 1 AS place, concat_ws(' ', {', '.join(parts)}) AS rest FROM (SELECT s, (i * (SELECT min(x) FROM range(greatest(1, n * 618 // 1000 + {7 + place}), n * 618 // 1000 + 1000) AS r(x) WHERE gcd(x, n) = 1)
  + {(7 + place) * 7919} % n) % n AS number FROM (SELECT s, s{radix} AS n FROM (SELECT count(DISTINCT c_name) AS s FROM customer)), range({L.CORPUS_TARGETS[label]}) AS t(i))"""


@query("u7_labelled_corpus", "WITH numbered AS (SELECT sender, row_number() OVER (ORDER BY sender) AS place FROM (SELECT DISTINCT c_name AS sender FROM customer)), drawn AS ("
       + " UNION ALL ".join(_drawn_sql(i, label) for i, label in enumerate(sorted(L.CORPUS_TARGETS))) + ") SELECT label, sender || ' ' || rest AS text FROM drawn JOIN numbered USING (place)")
def labelled_corpus(spark, sf):
    """As many different texts of every label as the corpus asks for, drawn from grids over all customers."""
    return C.labelled_grid(table(spark, sf, "customer").select(F.col("c_name").alias("sender")), _LABEL_SLOTS, L.CORPUS_TARGETS)


@query("u8_stratified_split", """
WITH p AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id::VARCHAR || '#7'), doc_id) AS rn, count(*) OVER (PARTITION BY source) AS n FROM documents)
SELECT doc_id, source, CASE WHEN rn <= greatest(1, round_even(n * 0.22, 0)::BIGINT) THEN 'validation' ELSE 'train' END AS split FROM p""")
def stratified_split(spark, sf):
    return C.stratified_split(table(spark, sf, "documents").select("doc_id", "source"), "source", "doc_id")


@query("u9_benign_bank_union", """
SELECT origin, count(*) AS n FROM (SELECT 'documents' AS origin, d.text FROM documents d JOIN labels USING (doc_id) WHERE toxic = 0 UNION ALL SELECT 'conversations', text FROM conversations WHERE role = 'assistant') GROUP BY origin""")
def benign_union(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text").join(table(spark, sf, "labels").filter("toxic = 0").select("doc_id"), "doc_id")
    conv = table(spark, sf, "conversations").filter("role = 'assistant'")
    both = docs.select(F.lit("documents").alias("origin"), "text").unionByName(conv.select(F.lit("conversations").alias("origin"), "text"))
    return both.groupBy("origin").agg(F.count("*").alias("n"))
