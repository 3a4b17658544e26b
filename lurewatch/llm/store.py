"""Tables written to the shared folder, so that later steps read one frozen version."""

from __future__ import annotations

from pyspark.sql import DataFrame

from lurewatch.session import scratch_path


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet below ``spark.checkpoint.dir`` and read again."""
    path = scratch_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
