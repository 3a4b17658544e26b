"""One investigation from all that belongs to it: request, attachments, links, model layers, earlier cases.

The inputs are tables keyed by ``investigation_id``. Laid out in buckets of that key (``lay_out``) they meet without a
shuffle; scoring is then one projection. Only the comparison with earlier cases deals rows by another key, and it sees
nothing but indicators. A stage whose input is not given is reported as skipped, never left out.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lurewatch import lexicon as L
from lurewatch.functions import detection as D
from lurewatch.functions import urls as U
from lurewatch.functions.bind import let
from lurewatch.operators import detection as P
from lurewatch.operators import fusion as FU
from lurewatch.operators import intel as I
from lurewatch.operators import reports as R
from lurewatch.session import scratch_path

KEY = "investigation_id"
#: Columns of a layers table; a null says that the layer did not run.
LAYERS = {
    "spam_score": "double", "spam_type": "string", "supervised_label": "string", "supervised_score": "double", "semantic_label": "string",
    "semantic_score": "double", "semantic_margin": "double", "opinion_is_scam": "boolean", "opinion_type": "string", "opinion_confidence": "double",
    "opinion_indicators": "array<string>",
}
_STAGE = "struct<stage:string,state:string,error:string>"


def lay_out(tables: dict[str, DataFrame], buckets: int = 64) -> dict[str, DataFrame]:
    """Each table written in ``buckets`` buckets of the investigation's id, sorted by it, and read again."""
    out = {}
    for name, df in tables.items():
        spark, stored = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
        writer = df.repartition(buckets, KEY).write.format("parquet").bucketBy(buckets, KEY).sortBy(KEY)
        writer.option("path", scratch_path(spark, name)).saveAsTable(stored)
        out[name] = spark.table(stored)
    return out


def ingest(requests: DataFrame, attachments: DataFrame | None = None) -> DataFrame:
    """Valid requests with ``links`` (caller's first, then those read), ``content`` to analyse, and ``rejections``.

    ``requests``: investigation_id, text, urls; ``attachments``: investigation_id, seq, uri, extracted_text, rejection.
    """
    if attachments is None:
        df = requests.withColumn("media", F.array().cast("array<struct<seq:long,uri:string,extracted_text:string,rejection:string>>"))
    else:
        parts = attachments.groupBy(KEY).agg(F.array_sort(F.collect_list(F.struct("seq", "uri", "extracted_text", "rejection"))).alias("media"))
        df = requests.join(parts, KEY, "left")
    media = F.coalesce(F.col("media"), F.array())
    df = df.filter(R.has_content(F.col("text"), F.col("media"), F.col("urls")))
    read = F.transform(F.filter(media, lambda m: F.coalesce(m["extracted_text"], F.lit("")) != ""), lambda m: m["extracted_text"])
    haystack = F.array_join(F.concat(F.array(F.coalesce("text", F.lit(""))), read), "\n")
    df = df.withColumn("read", read).withColumn("links", U.merge_candidates(F.col("urls"), U.extract_urls(haystack)))
    return df.withColumns({
        "content": R.analyzable_text(F.col("text"), F.col("read"), F.col("links")),
        "rejections": F.transform(F.filter(media, lambda m: m["rejection"].isNotNull()), lambda m: F.struct(m["uri"].alias("source"), m["rejection"].alias("detail"))),
    }).drop("read", "media")


def link_findings(links: Column) -> Column:
    """array<struct<finding, score>> of the links of a request."""
    def one(raw: Column) -> Column:
        return let(U.observe(raw), lambda o: let(U.lexical_reasons(o["host"], o["was_defanged"]), lambda r: let(U.lexical_score(r), lambda s: F.struct(
            R.url_finding(o["raw"], o["normalized"], F.lit(None).cast("string"), s, U.lexical_label(r)).alias("finding"), s.alias("score")))))

    return F.transform(links, one)


def fused(pattern: Column) -> Column:
    """Weighted mean of the layers that ran, the pattern layer among them."""
    def unless_benign(name: str) -> Column:
        return F.when(F.col(f"{name}_label") == "benign", 0.0).otherwise(F.col(f"{name}_score"))

    opinion = F.when(F.col("opinion_is_scam").isNotNull(), F.when(F.col("opinion_is_scam"), F.greatest(F.least(F.col("opinion_confidence"), F.lit(1.0)), F.lit(0.0))).otherwise(0.0))
    w = L.FUSION_WEIGHTS
    parts = [(pattern, w["pattern"]), (F.col("spam_score"), w["ml_text"]), (unless_benign("supervised"), w["ml_text"]), (unless_benign("semantic"), w["ml_text"]), (opinion, w["llm"])]
    total = sum((F.coalesce(s * x, F.lit(0.0)) for s, x in parts), F.lit(0.0))
    return total / sum((F.when(s.isNotNull(), x).otherwise(0.0) for s, x in parts), F.lit(0.0))


def detect(content: DataFrame, layers: DataFrame | None = None) -> DataFrame:
    """Adds the pattern verdict ``v``, the decision over all layers and their fused confidence.

    An outside opinion counts only with ``consent`` and while the cheaper layers are unsure.
    """
    if layers is None:
        df = content.withColumns({c: F.lit(None).cast(kind) for c, kind in LAYERS.items()})
    else:
        df = content.join(layers.select(KEY, *LAYERS), KEY, "left")
    df = df.withColumn("v", P.pattern_struct(F.col("content")))
    asked = FU.wants_opinion(F.coalesce("consent", F.lit(False)), F.col("spam_score") > L.MODEL_THRESHOLDS["spam"], F.col("v.pattern_confidence"))
    df = df.withColumns({c: F.when(asked, F.col(c)) for c in LAYERS if c.startswith("opinion_")})
    df = df.withColumns({
        "pattern_is_scam": F.col("v.is_scam"), "pattern_type": F.col("v.scam_type"), "negated_request": F.col("v.negated_request"),
        "fused": F.round(fused(F.col("v.pattern_confidence")), 6),
    })
    text = "text"
    return FU.decide(df.withColumnRenamed(text, "message").withColumnRenamed("content", text)).withColumnRenamed(text, "content").withColumnRenamed("message", text)


def _stage(name: str, state="ok", error=None) -> Column:
    state, error = (x if isinstance(x, Column) else F.lit(x) for x in (state, error))
    return F.struct(F.lit(name).alias("stage"), state.alias("state"), error.cast("string").alias("error"))


def _agent_stage(feature_enabled: bool) -> Column:
    asked = F.coalesce("engagement_requested", F.lit(False))
    allowed = R.may_engage(F.lit(feature_enabled), F.col("scopes"), F.coalesce("prior_confirmed_scam", F.lit(False)) | F.col("is_scam"))
    return _stage("agent", F.when(asked & allowed, "ok").otherwise("skipped"), F.when(asked & ~allowed, L.STAGE_ERRORS["agent"]))


def assemble(detected: DataFrame, feature_enabled: bool = False) -> DataFrame:
    """The report of each detected request, all stages but threat intelligence settled."""
    df = detected.withColumn("scored_links", link_findings(F.col("links")))
    link_risk = F.round(F.coalesce(F.array_max(F.transform("scored_links", lambda u: u["score"])), F.lit(0.0)) * 100).cast("int")
    df = df.withColumn("link_risk", link_risk)
    df = df.withColumn("risk", F.greatest(F.col("v.risk_score"), F.col("link_risk"))).withColumn("scam", F.col("is_scam") | (F.col("link_risk") >= 50))
    flags = F.array_distinct(F.concat(F.col("v.indicators"), F.coalesce("opinion_indicators", F.array().cast("array<string>"))))
    rejected = F.try_element_at(F.col("rejections"), F.lit(1))["detail"]
    stages = F.array_compact(F.array(
        _stage("ingestion"), F.when(rejected.isNotNull(), _stage("ingestion.rejections", "degraded", rejected)), _stage("entities"),
        _stage("threat_intel", "skipped", L.STAGE_ERRORS["threat_intel"]), _stage("detection"), _stage("risk_fusion", "skipped", L.STAGE_ERRORS["risk_fusion"]),
        _agent_stage(feature_enabled), _stage("protection"),
    ))
    return df.select(
        KEY, "seq", F.when(F.col("scam"), "scam").otherwise("likely_safe").alias("verdict"), F.least("risk", F.lit(100)).alias("risk_score"),
        D.severity(F.col("risk")).alias("severity"), F.least(F.greatest(F.round("fused", 3), F.lit(0.0)), F.lit(1.0)).alias("confidence"), "scam_type",
        F.slice(flags, 1, 10).alias("red_flags"), R.entity_list(F.col("v.intel")).alias("extracted_entities"),
        F.transform("scored_links", lambda u: u["finding"]).alias("url_findings"), "rejections",
        F.array(F.struct(F.lit("detection").alias("stage"), F.lit(L.DETECTION_MODEL).alias("model_id"))).alias("model_metadata"),
        stages.cast(f"array<{_STAGE}>").alias("stage_status"), F.col("ts").alias("generated_at"),
    )


def reports_of(requests: DataFrame, attachments: DataFrame | None = None, layers: DataFrame | None = None, feature_enabled: bool = False) -> DataFrame:
    """Requests to reports without threat intelligence. No shuffle over inputs in the same buckets.

    ``requests`` needs investigation_id, seq, text, urls, ts, consent, engagement_requested, scopes, prior_confirmed_scam.
    """
    return assemble(detect(ingest(requests, attachments), layers), feature_enabled)


def with_threat_intel(reports: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """Adds ``threat_intel``: what each report shares with cases before it, of this table and of ``history``.

    ``history``: investigation_id, kind, value, ts, seq of earlier cases. ``reports`` is read twice, so should be stored.
    """
    entity = F.posexplode("extracted_entities").alias("at", "e")
    found = reports.select(KEY, "seq", "generated_at", entity).select(
        F.col(KEY).cast("string").alias(KEY), F.col("e.kind").alias("kind"), F.col("e.value").alias("value"), F.col("generated_at").alias("ts"),
        (F.col("seq") * (1 << 20) + F.col("at")).alias("seq"))
    if history is not None:
        found = found.unionByName(history.select(F.col(KEY).cast("string").alias(KEY), "kind", "value", "ts", "seq"))
    match = F.struct("kind", F.col("value").alias("indicator"), F.lit(L.CORRELATION_SOURCE).alias("source"), "confidence", "first_seen", "campaign_id")
    matches = I.correlate(I.indicators(found)).groupBy(KEY).agg(F.array_sort(F.collect_list(match)).alias("threat_intel"))
    kind = dict(reports.dtypes)[KEY]
    joined = reports.join(matches.withColumn(KEY, F.col(KEY).cast(kind)), KEY, "left")
    done = F.transform("stage_status", lambda s: F.when(s["stage"] == "threat_intel", _stage("threat_intel")).otherwise(s))
    return joined.withColumn("stage_status", done).withColumn("threat_intel", F.coalesce("threat_intel", F.array()))


def protect(reports: DataFrame) -> DataFrame:
    """Adds explanation, recommended actions and follow-up questions."""
    c = F.col
    n_matches = F.size("threat_intel") if "threat_intel" in reports.columns else F.lit(0)
    ambiguous = R.is_ambiguous(c("verdict"), c("confidence"))
    return reports.withColumns({
        "explanation": R.explanation(c("verdict"), c("scam_type"), c("severity"), c("confidence"), c("red_flags")),
        "recommended_actions": R.recommended_actions(c("verdict"), c("scam_type"), F.size("url_findings"), n_matches),
        "follow_up": R.follow_up_questions(ambiguous, F.size("extracted_entities"), F.size("url_findings")),
    })


def engagement_audit(reports: DataFrame, actor: str) -> DataFrame:
    """Audit rows of the engagements that were authorised."""
    ran = F.exists("stage_status", lambda s: (s["stage"] == "agent") & (s["state"] == "ok"))
    return reports.filter(ran).select(
        F.lit(actor).alias("actor"), F.lit("honeypot_engagement").alias("action"), F.lit("investigation").alias("target_type"),
        F.col(KEY).alias("target_id"), F.lit("confirmed scam, researcher-authorized engagement").alias("reason"))
