"""Report assembly, derived texts and list projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lurewatch import lexicon as L
from lurewatch.functions import detection as D
from lurewatch.functions import replies as R
from lurewatch.functions import text as T
from lurewatch.functions import urls as U
from lurewatch.functions.bind import let

_STRINGS = "array<string>"


def has_content(text: Column, media: Column, urls: Column) -> Column:
    """A request needs non-blank text, media or URLs."""
    filled = F.coalesce(T.strip_space(text) != "", F.lit(False))
    return filled | (F.coalesce(F.size(media), F.lit(0)) > 0) | (F.coalesce(F.size(urls), F.lit(0)) > 0)


def analyzable_text(text: Column, attachment_texts: Column, raw_urls: Column) -> Column:
    """Message, attachment texts and raw URLs, blanks dropped, parted by an empty line."""
    parts = F.concat(F.array(text), F.coalesce(attachment_texts, F.array().cast(_STRINGS)), F.coalesce(raw_urls, F.array().cast(_STRINGS)))
    return F.array_join(F.filter(parts, lambda p: p.isNotNull() & (T.strip_space(p) != "")), "\n\n")


def url_finding(raw: Column, normalized: Column, reason: Column, score: Column, label: Column) -> Column:
    """struct(url, normalized_url, verdict, reasons, confidence) of one link."""
    blocked = reason.isNotNull()
    verdict = (
        F.when(blocked, "suspicious").when(score.isNull(), "unknown").when(score == 0, "likely_safe")
        .when(score >= 0.5, "suspicious").otherwise("unknown")
    )
    reasons = (
        F.when(blocked, F.array(reason)).when(label.isNull() | (label == "no_lexical_flags"), F.array().cast(_STRINGS))
        .otherwise(F.split(label, ", "))
    )
    return F.struct(
        raw.alias("url"), normalized.alias("normalized_url"), verdict.alias("verdict"), reasons.alias("reasons"),
        F.when(blocked, 0.0).otherwise(F.round(F.coalesce(score, F.lit(0.0)), 3)).alias("confidence"),
    )


def findings_of(text: Column) -> Column:
    """array<struct<finding, score>> of the links in a message (at most the intake limit)."""
    def one(raw: Column) -> Column:
        return let(U.observe(raw), lambda o: let(U.lexical_reasons(o["host"], o["was_defanged"]), lambda r: let(U.lexical_score(r), lambda s: F.struct(
            url_finding(o["raw"], o["normalized"], F.lit(None).cast("string"), s, U.lexical_label(r)).alias("finding"), s.alias("score")
        ))))

    return F.transform(U.extract_urls(text), one)


def entity_list(intel: Column, with_model_buckets: bool = False) -> Column:
    """Typed entities of the extractor buckets, in declared order, blanks dropped.

    Organisations and amounts come only from externally tagged spans; ask for
    them when ``intel`` carries those two buckets.
    """
    known = [(b, k) for b, k in L.BUCKET_KINDS.items() if with_model_buckets or k not in ("organization", "amount")]
    parts = [_typed(intel[bucket], bucket, kind) for bucket, kind in known]
    return F.concat(*parts)


def _typed(values: Column, bucket: str, kind: str) -> Column:
    kept = F.filter(values, lambda v: T.strip_space(v) != "")
    return F.transform(kept, lambda v: F.struct(
        F.lit(kind).alias("kind"), v.alias("value"), F.lit(0.8).alias("confidence"), F.lit(f"regex.{bucket}").alias("source")
    ))


def assemble(df: DataFrame) -> DataFrame:
    """One report per message from ``investigation_id, text, ts, verdict`` and ``urls``.

    ``verdict`` is ``detection.pattern_struct`` (or the same fields), ``urls``
    is ``findings_of``.
    """
    v, urls = F.col("verdict"), F.col("urls")
    url_risk = F.round(F.coalesce(F.array_max(F.transform(urls, lambda u: u["score"])), F.lit(0.0)) * 100).cast("int")
    base = df.withColumn("__risk", F.greatest(v["risk_score"], url_risk)).withColumn("__scam", v["is_scam"] | (url_risk >= 50))
    return base.select(
        "investigation_id",
        F.when(F.col("__scam"), "scam").otherwise("likely_safe").alias("verdict"),
        F.least(F.col("__risk"), F.lit(100)).alias("risk_score"),
        D.severity(F.col("__risk")).alias("severity"),
        F.least(F.greatest(F.round(v["pattern_confidence"], 3), F.lit(0.0)), F.lit(1.0)).alias("confidence"),
        v["scam_type"].alias("scam_type"),
        F.slice(v["indicators"], 1, 10).alias("red_flags"),
        entity_list(v["intel"]).alias("extracted_entities"),
        F.transform(urls, lambda u: u["finding"]).alias("url_findings"),
        F.array().cast("array<struct<indicator:string,kind:string,confidence:double,campaign_id:string>>").alias("threat_intel"),
        F.array(*[F.struct(F.lit(s).alias("stage"), F.lit("ok").alias("state")) for s in ("ingestion", "entities", "detection")]).alias("stage_status"),
        F.col("ts").alias("generated_at"),
    )


def is_degraded(stage_status: Column) -> Column:
    return F.exists(stage_status, lambda s: s["state"].isin("degraded", "failed"))


def entities_of(entities: Column, kind: str) -> Column:
    return F.filter(entities, lambda e: e["kind"] == kind)


def is_ambiguous(verdict: Column, confidence: Column) -> Column:
    return verdict.isin("suspicious", "unknown") | ((verdict == "scam") & (confidence < 0.5))


def follow_up_questions(ambiguous: Column, n_entities: Column, n_urls: Column) -> Column:
    return F.when(ambiguous, F.array_compact(F.array(
        F.lit(L.FOLLOW_UP_WORDING), F.when(n_entities == 0, L.FOLLOW_UP_ENTITIES), F.when(n_urls == 0, L.FOLLOW_UP_LINK)
    ))).otherwise(F.array().cast(_STRINGS))


def explanation(verdict: Column, scam_type: Column, severity: Column, confidence: Column, red_flags: Column) -> Column:
    label = F.coalesce(D.lookup(F.coalesce(scam_type, F.lit("other")), L.SCAM_TYPE_LABELS), F.lit(L.SCAM_TYPE_LABELS["other"]))
    pct = F.bround(confidence * 100).cast("int").cast("string")
    sentence = F.concat(F.lit("This message shows signs of "), label, F.lit(" ("), severity, F.lit(" risk, "), pct, F.lit("% confidence)."))
    flags = F.when(F.size(red_flags) > 0, F.concat(F.lit(" Red flags: "), F.array_join(F.slice(red_flags, 1, 3), ", "), F.lit("."))).otherwise("")
    clean = R.sanitize(F.concat(sentence, flags), F.lit(L.FALLBACK_EXPLANATION), max_sentences=0, max_chars=500, check_meta=False)
    return F.when(verdict == "likely_safe", L.SAFE_EXPLANATION).otherwise(clean)


def recommended_actions(verdict: Column, scam_type: Column, n_urls: Column, n_matches: Column) -> Column:
    steps = F.array_compact(F.array(
        *[F.lit(a) for a in L.BASE_ACTIONS], F.when(n_urls > 0, L.LINK_ACTION), D.lookup(F.coalesce(scam_type, F.lit("")), L.SCAM_TYPE_ACTIONS),
        F.when(n_matches > 0, L.CAMPAIGN_ACTION), F.lit(L.REPORT_ACTION),
    ))
    return F.when(verdict == "likely_safe", F.array(F.lit(L.SAFE_ACTION))).otherwise(steps)


def incident_guidance(actions: Column) -> Column:
    """struct(freeze, report_to, preserve_evidence) for what a user already did."""
    steps = F.array_distinct(F.array_compact(F.transform(actions, lambda a: D.lookup(a, L.FREEZE_STEPS))))
    preserve = F.array_compact(F.array(
        *[F.lit(p) for p in L.PRESERVE], F.when(F.array_contains(actions, "paid"), L.PAYMENT_EVIDENCE),
        F.when(F.array_contains(actions, "installed_app"), L.APP_EVIDENCE),
    ))
    return F.struct(
        F.when(F.size(steps) > 0, steps).otherwise(F.array(F.lit(L.DEFAULT_FREEZE))).alias("freeze"),
        F.lit(L.REPORT_TO).alias("report_to"), preserve.alias("preserve_evidence"),
    )


def may_engage(feature_enabled: Column, scopes: Column, is_scam: Column) -> Column:
    """Engagement needs the feature, the research scope and a confirmed scam."""
    return feature_enabled & F.coalesce(F.array_contains(scopes, "research:honeypot"), F.lit(False)) & is_scam


def legal_transition(current: Column, target: Column) -> Column:
    allowed = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in L.EVIDENCE_TRANSITIONS]
    return F.exists(F.array(*allowed), lambda p: (p["a"] == current) & (p["b"] == target))


def list_row(df: DataFrame) -> DataFrame:
    """Dashboard row of a report joined with its investigation."""
    risk = F.col("risk_score")
    return df.select(
        F.col("investigation_id").alias("id"), F.upper(F.coalesce("platform", F.lit("web"))).alias("source"),
        D.lookup(F.coalesce("content_type", F.lit("text")), L.CONTENT_TYPE_LABELS, "Message").alias("type"),
        D.lookup(F.col("verdict"), L.VERDICT_LABELS).alias("verdict"), risk.alias("risk"),
        D.lookup(F.col("severity"), L.SEVERITY_LABELS).alias("severity"), F.round(F.col("confidence") * 100).cast("int").alias("confidence"),
        F.date_format("generated_at", "yyyy-MM-dd").alias("date"), F.lit("Closed").alias("status"),
        F.when(risk >= 61, "accent").when(risk >= 41, "accent-2").otherwise("neutral").alias("colour"),
    )


def threat_bars(red_flags: Column, confidence: Column) -> Column:
    """At least two labelled bars: the first five flags, each five points lower."""
    pct = F.round(confidence * 100).cast("int")

    def bar(label: Column, value: Column) -> Column:
        return F.struct(label.alias("label"), value.cast("int").alias("pct"))

    flags = F.transform(F.slice(red_flags, 1, 5), lambda f, i: bar(f, F.greatest(F.lit(20), pct - i * 5)))
    none = F.array(bar(F.lit("No strong red flags detected"), pct))
    return let(F.when(F.size(red_flags) > 0, flags).otherwise(none), lambda b: F.when(
        F.size(b) < 2, F.array_append(b, bar(F.lit("—"), F.lit(0)))
    ).otherwise(b))


def to_markdown(df: DataFrame) -> Column:
    return F.left(_render(df, T.escape_markdown, "• ", True), F.lit(4096))


def to_plain(df: DataFrame) -> Column:
    return F.left(_render(df, lambda c: c, "- ", False), F.lit(1600))


def _render(df: DataFrame, escape, bullet: str, rich: bool) -> Column:
    banner = D.lookup(F.col("severity"), L.SEVERITY_BANNERS)
    flags = F.slice("red_flags", 1, 5)
    title = F.concat(F.lit("*"), escape(banner), F.lit("*")) if rich else banner
    gap = F.lit("")
    degraded = is_degraded(F.col("stage_status"))
    note = "(partial analysis — some checks were unavailable)" if rich else "(partial analysis - some checks were unavailable)"
    lines = [
        F.array(title, escape(F.concat(F.lit("Risk: "), F.col("risk_score").cast("string"), F.lit("/100")))),
        F.when(F.col("scam_type").isNotNull() & (F.col("scam_type") != "") & (F.col("verdict") == "scam"),
               F.array(escape(F.concat(F.lit("Type: "), F.replace(F.col("scam_type"), F.lit("_"), F.lit(" ")))))),
        F.when(F.size("red_flags") > 0, F.concat(F.array(gap), F.transform(flags, lambda f: F.concat(F.lit(bullet), escape(f))))),
    ]
    if rich:
        lines.append(F.when(F.size("url_findings") > 0, F.array(gap, escape(F.concat(F.lit("Links checked: "), F.size("url_findings").cast("string"))))))
    lines.append(F.when(degraded, F.array(gap, escape(F.lit(note)))))
    empty = F.array().cast(_STRINGS)
    return F.array_join(F.concat(*[F.coalesce(x, empty) for x in lines]), "\n")


def agent_notes(scam_type: Column, persona: Column, n_upi: Column, n_phone: Column, n_link: Column, n_messages: Column) -> Column:
    def got(n: Column, head: str, tail: str) -> Column:
        return F.when(n > 0, F.concat(F.lit(head), n.cast("string"), F.lit(tail)))

    parts = F.array_compact(F.array(
        F.when(F.length(scam_type) > 0, F.concat(F.lit("Scam type: "), scam_type)),
        F.when(F.length(persona) > 0, F.concat(F.lit("Used "), persona, F.lit(" persona"))),
        got(n_upi, "Got ", " UPI ID(s)"), got(n_phone, "Got ", " phone(s)"), got(n_link, "Found ", " suspicious link(s)"),
        F.concat(n_messages.cast("string"), F.lit(" messages total")),
    ))
    return F.concat(F.array_join(parts, ". "), F.lit("."))


def under_evidenced(entities: DataFrame, ambiguous: DataFrame) -> DataFrame:
    """Entity kinds mentioned once in an ambiguous report."""
    kept = entities.join(ambiguous, "investigation_id", "left_semi")
    return kept.groupBy("investigation_id", "kind").agg(F.count(F.lit(1)).alias("n")).filter("n < 2").drop("n")


def intel_drilldown(matches: DataFrame) -> DataFrame:
    """Matches and distinct campaigns per report, with the summary sentence."""
    per = matches.groupBy("investigation_id", "campaign_id").agg(F.count(F.lit(1)).alias("n"))
    out = per.groupBy("investigation_id").agg(
        F.sum("n").alias("n_matches"), F.count("campaign_id").alias("n_campaigns")
    )
    tail = F.when(F.col("n_campaigns") > 0, F.concat(F.lit(" across "), F.col("n_campaigns").cast("string"), F.lit(" known campaign(s)."))).otherwise(".")
    return out.withColumn("summary", F.concat(F.col("n_matches").cast("string"), F.lit(" indicator(s) correlate with prior investigations"), tail))


def recent_reports(reports: DataFrame, investigations: DataFrame, limit: int = 50, user_id=None) -> DataFrame:
    """Most recent reports with their owner's channel; one user's, or all."""
    owners = investigations if user_id is None else investigations.filter(F.col("user_id") == user_id)
    owners = owners.select(F.col("id").alias("investigation_id"), "platform", "content_type", "user_id")
    order = [F.desc("generated_at"), F.col("investigation_id")]
    # the newest ids come from two narrow columns; whole rows are fetched for these ``limit`` ids only
    owned = reports.select("investigation_id", "generated_at").join(owners.select("investigation_id"), "investigation_id", "left_semi")
    newest = F.broadcast(owned.orderBy(*order).limit(limit).select("investigation_id").distinct())
    picked = lambda df: df.join(newest, "investigation_id", "left_semi")
    return picked(reports).join(picked(owners), "investigation_id").orderBy(*order).limit(limit)


def dashboard_counts(investigations: DataFrame) -> DataFrame:
    sev = D.severity(F.col("risk_score"))
    return investigations.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(~F.col("verdict").isin("likely_safe", "unknown")).alias("threats"),
        F.count_if(sev.isin("critical", "high")).alias("high_risk"),
    )
