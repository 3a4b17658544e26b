"""Declared schemas of stored tables and wire payloads."""

MEDIA = "STRUCT<kind: STRING, uri: STRING, mime_type: STRING, size_bytes: BIGINT>"
REQUEST = (
    f"platform STRING, user_id STRING, content_type STRING, text STRING, media ARRAY<{MEDIA}>, "
    "chat_id STRING, message_id STRING"
)
LABELLED_DOCUMENT = "purpose STRING, labels ARRAY<STRING>, examples ARRAY<STRUCT<text: STRING, label: STRING, is_scam: BOOLEAN, category: STRING>>"
PAIR_DOCUMENT = (
    "pairs ARRAY<STRUCT<id: STRING, known: STRUCT<text: STRING, is_scam: BOOLEAN>, unseen: STRUCT<text: STRING, is_scam: BOOLEAN>>>"
)
SESSION = (
    "STRUCT<sessionId: STRING, scamDetected: BOOLEAN, scamType: STRING, "
    "conversationHistory: ARRAY<STRUCT<sender: STRING, text: STRING, timestamp: STRING>>, "
    "extractedIntelligence: STRUCT<upiIds: ARRAY<STRING>, phoneNumbers: ARRAY<STRING>, bankAccounts: ARRAY<STRING>, "
    "phishingLinks: ARRAY<STRING>, suspiciousKeywords: ARRAY<STRING>>, startTime: STRING, messageCount: BIGINT, isComplete: BOOLEAN>"
)
SESSION_FILE = f"STRUCT<sessions: MAP<STRING, {SESSION}>>"
FEED = "STRUCT<urls: ARRAY<STRUCT<url: STRING, host: STRING, threat: STRING, date_added: STRING>>>"
_FILE = "STRUCT<file_id: STRING, file_size: BIGINT, mime_type: STRING>"
_BOT_MESSAGE = (
    f"STRUCT<message_id: BIGINT, chat: STRUCT<id: BIGINT>, `from`: STRUCT<id: BIGINT, username: STRING>, text: STRING, caption: STRING, "
    f"photo: ARRAY<{_FILE}>, document: {_FILE}, voice: {_FILE}, audio: {_FILE}>"
)
BOT_UPDATE = f"STRUCT<update_id: BIGINT, message: {_BOT_MESSAGE}, channel_post: {_BOT_MESSAGE}>"
_BLOCK = "STRUCT<id: STRING, mime_type: STRING, caption: STRING>"
HOOK = (
    "STRUCT<entry: ARRAY<STRUCT<changes: ARRAY<STRUCT<value: STRUCT<metadata: STRUCT<phone_number_id: STRING>, "
    "messages: ARRAY<STRUCT<`from`: STRING, id: STRING, type: STRING, text: STRUCT<body: STRING>, "
    f"image: {_BLOCK}, document: {_BLOCK}, audio: {_BLOCK}, voice: {_BLOCK}, video: {_BLOCK}>>>>>>>>"
)
API_CALL = (
    "STRUCT<sessionId: STRING, message: STRUCT<sender: STRING, text: STRING, timestamp: STRING, image: STRING, imageUrl: STRING, "
    "image_url: STRING, media_url: STRING>, metadata: MAP<STRING, STRING>>"
)
TABLES = {
    "investigations": (
        "id STRING, user_id BIGINT, platform STRING, content_type STRING, verdict STRING, risk_score INT, confidence DOUBLE, scam_type STRING, "
        "data_origin STRING, evidence_state STRING, created_at TIMESTAMP, purge_at TIMESTAMP"
    ),
    "messages": "investigation_id STRING, sender STRING, text STRING, ts TIMESTAMP",
    "entities": "investigation_id STRING, kind STRING, value STRING, source STRING",
    "signals": "investigation_id STRING, source STRING, score DOUBLE, label STRING, confidence DOUBLE, model_id STRING, weight DOUBLE",
    "audit": "actor STRING, action STRING, target_type STRING, target_id STRING, reason STRING",
    "model_runs": "investigation_id STRING, stage STRING, model_id STRING, version STRING, duration_ms BIGINT",
}
