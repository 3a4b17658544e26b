"""Named queries and their equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import wraps

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        if name in REGISTRY:
            raise ValueError(f"query {name} registered twice")
        REGISTRY[name] = Query(_in_utc(fn), sql)
        return fn

    return register


def _in_utc(fn):
    """Stored times are UTC wall-clock times, so queries run in that session zone."""

    @wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        if spark.conf.get("spark.sql.session.timeZone") != "UTC":
            spark.conf.set("spark.sql.session.timeZone", "UTC")
        return fn(spark, sf_dir)

    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt out anew if the session asks for it (``spark.lurewatch.spreadInputs``), else as it is read.

    Meant for a few files of one row group each, which Spark cannot split; off by default, as it shuffles the rows.
    """
    session = df.sparkSession
    if session.conf.get("spark.lurewatch.spreadInputs", "false") != "true":
        return df
    return df.repartition(session.sparkContext.defaultParallelism * 4)
