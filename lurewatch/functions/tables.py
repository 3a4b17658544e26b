"""Entities of a text as rows: an expression that lists them and a table function for SQL."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from lurewatch import lexicon as L
from lurewatch.functions import entities as E
from lurewatch.functions import keywords as K
from lurewatch.functions.bind import let

ROW = "ARRAY<STRUCT<kind: STRING, value: STRING, confidence: DOUBLE>>"
#: Confidence of kinds that no validator judges.
UNCHECKED = 0.8
_CHECKS = {"upiIds": E.check_upi, "phoneNumbers": E.check_phone, "bankAccounts": E.check_account, "phishingLinks": E.check_url}


def entity_rows(text: Column, spans: Column | None = None) -> Column:
    """array<struct<kind, value, confidence>>: what the rules find in a text and what outside tags (label, text) add.

    Values are distinct within a kind, in the order of the kinds; each has the confidence of its validator.
    """
    def row(bucket: str, value: Column) -> Column:
        confidence = _CHECKS[bucket](value)["confidence"] if bucket in _CHECKS else F.lit(UNCHECKED)
        return F.struct(F.lit(L.BUCKET_KINDS[bucket]).alias("kind"), value.alias("value"), confidence.cast("double").alias("confidence"))

    tagged = F.array().cast("array<struct<bucket:string,value:string>>")
    if spans is not None:
        tagged = F.array_compact(F.transform(F.coalesce(spans, F.array()), lambda s: E.model_entity(s["label"], s["text"])))
    known = lambda intel, bucket: intel[bucket] if bucket not in ("organizations", "amounts") else F.array().cast("array<string>")

    def rows(p: Column) -> Column:
        def typed(bucket: str) -> Column:
            outside = F.transform(F.filter(p["tagged"], lambda t: t["bucket"] == bucket), lambda t: t["value"])
            values = F.filter(F.array_distinct(F.concat(known(p["intel"], bucket), outside)), lambda v: F.trim(v) != "")
            return F.transform(values, lambda v: row(bucket, v))

        return F.concat(*map(typed, L.BUCKET_KINDS))

    found = let(K.scan(text), lambda kw: E.extract(text, K.suspicious(kw["hits"])))
    return let(F.struct(found.alias("intel"), tagged.alias("tagged")), rows)


def register(spark: SparkSession) -> None:
    """The table function ``entities_of(found)``: rows of an ``entity_rows`` column, for use with LATERAL."""
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION entities_of(found {ROW}) RETURNS TABLE (kind STRING, value STRING, confidence DOUBLE)
        RETURN SELECT e.kind, e.value, e.confidence FROM (SELECT explode(found) AS e)""")
