"""The corpus pipeline: stages over documents, each written and read again before the next.

doc_id is the key: documents without one are dropped by the first stage, and of rows that repeat one a single
row passes the second. Columns that a stage does not name pass through. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lurewatch.llm import decontaminate, langid, mixing, simhash, suffix_dedup
from lurewatch.llm.store import stored


#: Documents whose language is less certain than this are rejected.
LEAST_CERTAIN = 0.5


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, without text or of no certain language go."""
    judged = langid.identify(docs).where(f"lang_pred <> 'und' and score >= {LEAST_CERTAIN}").select("doc_id")
    return docs.join(judged.distinct(), "doc_id").select(docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with near-equal SimHash fingerprints, the one with the smallest doc_id stays.

    Of rows that repeat a doc_id one stays, the same in every run unless they agree in text, source, lang and n_chars.
    """
    keep = simhash.near_duplicates(docs).where("doc_id = component_id").select("doc_id")
    near = docs.join(keep.distinct(), "doc_id").select(docs.columns)
    one = near.groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), F.xxhash64("text", "source", "lang", "n_chars")).alias("one"))
    return one.select("one.*")


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte strings that occur twice are cut out of the texts; every document stays."""
    kept = suffix_dedup.remove_repeats(docs, as_text=True).select("doc_id", F.col("kept").alias("text"))
    return docs.drop("text").join(kept, "doc_id").withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item of at least ``decontaminate.LEAST_WORDS`` words, or nearly, go.

    Shorter items are phrases that clean documents use too; op6 reports them.
    """
    benchmark = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")
    found = stored(decontaminate.contaminated(docs, benchmark).select("doc_id").distinct(), "contaminated")
    return docs.join(found, "doc_id", "left_anti").select(docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in training order: every document at least once, sources held to their weights.

    The columns slot, place and epoch are added and take the place of columns of these names.
    """
    placed = mixing.mix(docs).select("doc_id", "slot", "place", "epoch")
    rest = docs.drop("slot", "place", "epoch")
    return rest.join(placed, "doc_id").select(*rest.columns, "slot", "place", "epoch")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", known_language),
    ("simhash_near_dedup", one_of_each_group),
    ("suffix_array_dedup", without_repeats),
    ("benchmark_decontamination", without_benchmark),
    ("source_mixing", mixed),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
