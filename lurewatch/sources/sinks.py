"""Append writers, evidence tables and their upkeep."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lurewatch.operators import maintenance as M
from lurewatch.operators.evidence import session_tables
from lurewatch.session import cut_lineage
from lurewatch.sources.keyed import KeyedTable
from lurewatch.sources.readers import file_system, qualified

EVIDENCE = {"investigations": "id", "messages": "investigation_id", "entities": "investigation_id", "reports": "investigation_id"}


def append(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Append-only tables: signals, audit rows, model runs."""
    writer = df.write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_files(df: DataFrame, folder: str) -> int:
    """One file per row (``name``, ``content``) in ``folder``, written by the tasks; a retried task writes the same files again.

    Names are plain and unique. Returns how many rows were written; a null content gives an empty file.
    """
    root = qualified(df.sparkSession, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, place = file_system(root)
        system.create_dir(place, recursive=True)
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                with system.open_output_stream(f"{place}/{name.as_py()}") as file:
                    file.write(content.as_buffer() if content.is_valid else b"")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    return df.select("name", F.col("content").cast("binary")).mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def evidence_tables(spark: SparkSession, root: str) -> dict[str, KeyedTable]:
    """The keyed tables of stored evidence below ``root``."""
    return {name: KeyedTable(spark, f"{root.rstrip('/')}/{name}", (key,)) for name, key in EVIDENCE.items()}


def log_sessions(sessions: DataFrame, root: str, version: int | None = None) -> None:
    """Store evidence sessions: their messages, entities and report replace those stored before. A replay changes nothing."""
    tables = evidence_tables(sessions.sparkSession, root)
    for name, (df, key) in session_tables(sessions).items():
        tables[name].replace(df, version, also=sessions.select(F.col("session_id").alias(key)))


def purge(tables: dict[str, KeyedTable], audit: str, now: Column) -> None:
    """Retention purge: expired investigations lose all that hangs on them and are marked; one audit row each. Writes changes only."""
    due = cut_lineage(M.expired(tables["investigations"].read(), now))
    for name, table in tables.items():
        if name != "investigations":
            table.delete(due.select(F.col("id").alias("investigation_id")))
    append(M.audit_rows(due.select(F.col("id").alias("investigation_id")), "retention-purge-job", "purge", "retention period elapsed"), audit)
    tables["investigations"].replace(due.withColumn("evidence_state", F.lit("purged")))


def delete_for_owner(tables: dict[str, KeyedTable], audit: str, ids: DataFrame, actor: str, reason: str) -> None:
    """Owner deletion: the same cascade and the investigation rows themselves, audited. ``ids``: investigation_id."""
    inv = tables["investigations"].read(ids.select(F.col("investigation_id").alias("id")))
    gone = cut_lineage(inv.select(F.col("id").alias("investigation_id")))
    append(M.audit_rows(gone, actor, "delete", reason), audit)
    for name, table in tables.items():
        table.delete(gone.withColumnRenamed("investigation_id", EVIDENCE[name]))
