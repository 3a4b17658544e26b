"""Evidence sessions to the rows stored for them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lurewatch import lexicon as L
from lurewatch.functions.keys import flexible_timestamp
from lurewatch.operators.maintenance import purge_time
from lurewatch.operators.sessions import SCORED_KINDS

_BUCKETS = {b: k for b, k in L.BUCKET_KINDS.items() if b not in ("organizations", "amounts")}


def session_tables(sessions: DataFrame) -> dict[str, tuple[DataFrame, str]]:
    """Investigation, message, entity and report rows (with key) of parsed sessions."""
    weights = {b: SCORED_KINDS.get(k, 0) for b, k in _BUCKETS.items()}
    size = lambda b: F.coalesce(F.size(F.col("intel")[b]), F.lit(0))
    score = F.least(sum((F.greatest(size(b), F.lit(0)) * w for b, w in weights.items() if w), F.lit(0)), F.lit(100))
    inv = sessions.select(
        F.col("session_id").alias("id"), F.lit("api").alias("platform"), F.lit("text").alias("content_type"),
        F.lit("honeypot_research").alias("data_origin"), F.when(F.col("scam_detected"), "scam").otherwise("likely_safe").alias("verdict"),
        F.when(F.col("scam_detected"), score).otherwise(0).alias("risk_score"), "scam_type", F.lit("retained").alias("evidence_state"),
        F.col("started_at").alias("created_at"), purge_time(F.col("started_at")).alias("purge_at"),
    )
    turns = sessions.select(F.col("session_id").alias("investigation_id"), F.inline_outer("history")).filter("text IS NOT NULL OR sender IS NOT NULL")
    messages = turns.select(
        "investigation_id", F.coalesce("sender", F.lit("unknown")).alias("sender"), F.coalesce("text", F.lit("")).alias("text"),
        flexible_timestamp(F.col("timestamp")).alias("ts"),
    )
    values = F.concat(*[
        F.transform(F.coalesce(F.col("intel")[b], F.array().cast("array<string>")), lambda v: F.struct(v.alias("value"))) for b in _BUCKETS
    ])
    kinds = F.concat(*[F.array_repeat(F.lit(k), F.greatest(size(b), F.lit(0))) for b, k in _BUCKETS.items()])
    pairs = F.arrays_zip(kinds.alias("kind"), values.alias("v"))
    entities = sessions.select(F.col("session_id").alias("investigation_id"), F.inline_outer(pairs)).filter("kind IS NOT NULL")
    entities = entities.select("investigation_id", "kind", F.col("v.value").alias("value"), F.lit("regex").alias("source"))
    reports = sessions.select(F.col("session_id").alias("investigation_id"), F.to_json(F.struct(*sessions.columns)).alias("payload"))
    return {
        "investigations": (inv, "id"), "messages": (messages, "investigation_id"),
        "entities": (entities, "investigation_id"), "reports": (reports, "investigation_id"),
    }
