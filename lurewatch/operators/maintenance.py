"""Keyed upsert, retention purge, owner deletion and evidence views.

All functions return new table versions; ``sources.sinks`` writes them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lurewatch import lexicon as L


def upsert(current: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``changes`` replace those of ``current`` with the same key."""
    kept = current.join(changes.select(*keys).distinct(), keys, "left_anti")
    return kept.unionByName(changes, allowMissingColumns=True)


def add_missing(current: DataFrame, candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates whose key is not there yet, one row per key."""
    return candidates.dropDuplicates(keys).join(current.select(*keys), keys, "left_anti")


def unreported(requests: DataFrame, reports: DataFrame) -> DataFrame:
    """Replay guard: requests without a report."""
    return requests.join(reports.select("investigation_id"), "investigation_id", "left_anti")


def expired(investigations: DataFrame, now: Column) -> DataFrame:
    """Past their purge time and not purged yet (so that replays add nothing)."""
    return investigations.filter(F.col("purge_at").isNotNull() & (F.col("purge_at") <= now) & (F.col("evidence_state") != "purged"))


def purge(investigations: DataFrame, children: dict[str, DataFrame], now: Column) -> dict[str, DataFrame]:
    """Retention purge: new versions of all tables plus the audit rows to append."""
    gone = expired(investigations, now).select(F.col("id").alias("investigation_id"))
    due = F.col("purge_at").isNotNull() & (F.col("purge_at") <= now)
    out = {name: df.join(gone, "investigation_id", "left_anti") for name, df in children.items()}
    out["investigations"] = investigations.withColumn("evidence_state", F.when(due, "purged").otherwise(F.col("evidence_state")))
    out["audit"] = audit_rows(gone, "retention-purge-job", "purge", "retention period elapsed")
    return out


def delete_for_owner(investigations: DataFrame, children: dict[str, DataFrame], ids: DataFrame, actor: str, reason: str) -> dict[str, DataFrame]:
    """Owner deletion: the same cascade and the investigation row itself, audited."""
    gone = investigations.join(ids, investigations["id"] == ids["investigation_id"], "left_semi").select(F.col("id").alias("investigation_id"))
    out = {name: df.join(gone, "investigation_id", "left_anti") for name, df in children.items()}
    out["investigations"] = investigations.join(gone, investigations["id"] == gone["investigation_id"], "left_anti")
    out["audit"] = audit_rows(gone, actor, "delete", reason)
    return out


def audit_rows(targets: DataFrame, actor: str, action: str, reason: str) -> DataFrame:
    return targets.select(
        F.lit(actor).alias("actor"), F.lit(action).alias("action"), F.lit("investigation").alias("target_type"),
        F.col("investigation_id").alias("target_id"), F.lit(reason).alias("reason"),
    )


def research_origin(investigations: DataFrame) -> DataFrame:
    """The only investigations evidence views may see."""
    return investigations.filter(F.col("data_origin") == "honeypot_research")


def master_intel(entities: DataFrame, investigations: DataFrame) -> DataFrame:
    """Distinct values per kind over all research sessions, one row per value."""
    visible = research_origin(investigations).select(F.col("id").alias("investigation_id"))
    known = [k for b, k in L.BUCKET_KINDS.items() if b not in ("organizations", "amounts")]
    kept = entities.filter(F.col("kind").isin(known)).join(visible, "investigation_id", "left_semi")
    return kept.select("kind", "value").distinct()


def purge_time(created_at: Column, data_class: str = "messages") -> Column:
    days = L.RETENTION_DAYS[data_class]
    return F.when(F.lit(days > 0), created_at + F.make_dt_interval(F.lit(days)))
