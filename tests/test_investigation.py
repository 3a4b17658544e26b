"""Whole investigations: what each input adds to the report, and how the inputs meet."""

import pytest
from pyspark.sql import functions as F

from lurewatch.operators import investigation as V

ASK = "investigation_id long, seq long, text string, urls array<string>, ts timestamp, consent boolean, engagement_requested boolean, scopes array<string>, prior_confirmed_scam boolean"
FILE = "investigation_id long, seq long, uri string, extracted_text string, rejection string"
PLAIN = "The choir meets on Thursday."


def asked(spark, *rows):
    full = [{"urls": None, "consent": True, "engagement_requested": None, "scopes": None, "prior_confirmed_scam": None, **r, "seq": r["investigation_id"]} for r in rows]
    names = [f.split()[0] for f in ASK.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in full], ASK).withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("seq")))


def layered(spark, *rows):
    names = ", ".join(f"{c} {k}" for c, k in V.LAYERS.items())
    return spark.createDataFrame([(r["investigation_id"], *(r.get(c) for c in V.LAYERS)) for r in rows], f"investigation_id long, {names}")


def by_id(df):
    return {r["investigation_id"]: r for r in df.collect()}


def stages(row):
    return {s["stage"]: (s["state"], s["error"]) for s in row["stage_status"]}


def test_inputs_in_the_same_buckets_meet_without_a_shuffle(spark):
    t = V.lay_out({
        "requests": asked(spark, *({"investigation_id": i, "text": PLAIN} for i in range(40))),
        "attachments": spark.createDataFrame([(i % 40, i, "f", PLAIN, None) for i in range(90)], FILE),
        "layers": layered(spark, *({"investigation_id": i, "spam_score": 0.1} for i in range(30)))}, buckets=4)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = V.reports_of(t["requests"], t["attachments"], t["layers"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert "SortMergeJoin" in plan and "Exchange" not in plan


def test_links_of_caller_message_and_attachment(spark):
    many = [f"http://host{i}.example/" for i in range(30)]
    r = by_id(V.reports_of(
        asked(spark, {"investigation_id": 1, "text": "see http://b.example/x and http://a.example/", "urls": ["http://a.example/", "http://a.example/"]},
              {"investigation_id": 2, "text": None, "urls": ["http://10.0.0.7/pay"]}, {"investigation_id": 3, "text": " ", "urls": many}, {"investigation_id": 4, "text": " "}),
        spark.createDataFrame([(1, 2, "f2", "or https://c.example/", None), (1, 1, "f1", None, "too large"), (5, 1, "f", "nobody asked", None)], FILE)))
    assert sorted(r) == [1, 2, 3]
    assert [u["url"] for u in r[1]["url_findings"]] == ["http://a.example/", "http://b.example/x", "https://c.example/"]
    assert stages(r[1])["ingestion.rejections"] == ("degraded", "too large") and [x["source"] for x in r[1]["rejections"]] == ["f1"]
    assert [u["url"] for u in r[3]["url_findings"]] == many[:25]
    assert r[2]["risk_score"] >= 30 and "ingestion.rejections" not in stages(r[2])


def test_attachment_text_is_analysed(spark):
    files = spark.createDataFrame([(1, 1, "f", "URGENT please tell me the OTP that just reached your handset.", None)], FILE)
    r = by_id(V.reports_of(asked(spark, {"investigation_id": 1, "text": PLAIN}, {"investigation_id": 2, "text": PLAIN}), files))
    assert (r[1]["verdict"], r[2]["verdict"]) == ("scam", "likely_safe") and r[1]["model_metadata"][0]["model_id"] == "universal_detection"


@pytest.mark.parametrize(("consent", "verdict"), [(True, "scam"), (False, "likely_safe"), (None, "likely_safe")])
def test_an_opinion_needs_consent(spark, consent, verdict):
    opinion = {"investigation_id": 1, "opinion_is_scam": True, "opinion_type": "lottery", "opinion_confidence": 0.9, "opinion_indicators": ["too good"]}
    row = by_id(V.reports_of(asked(spark, {"investigation_id": 1, "text": PLAIN, "consent": consent}), None, layered(spark, opinion)))[1]
    assert row["verdict"] == verdict and ("too good" in row["red_flags"]) == bool(consent)


def test_stages_of_engagement(spark):
    scam = "URGENT please tell me the OTP that just reached your handset."
    rows = [{"investigation_id": 1, "text": scam}, {"investigation_id": 2, "text": scam, "engagement_requested": True},
            {"investigation_id": 3, "text": scam, "engagement_requested": True, "scopes": ["research:honeypot"]},
            {"investigation_id": 4, "text": PLAIN, "engagement_requested": True, "scopes": ["research:honeypot"]},
            {"investigation_id": 5, "text": PLAIN, "engagement_requested": True, "scopes": ["research:honeypot"], "prior_confirmed_scam": True}]
    on = V.reports_of(asked(spark, *rows), feature_enabled=True)
    agent = {i: stages(r)["agent"] for i, r in by_id(on).items()}
    assert agent == {1: ("skipped", None), 2: ("skipped", "honeypot engagement not authorized"), 3: ("ok", None), 4: ("skipped", "honeypot engagement not authorized"), 5: ("ok", None)}
    assert sorted(r["target_id"] for r in V.engagement_audit(on, "researcher").collect()) == [3, 5]
    assert V.engagement_audit(V.reports_of(asked(spark, *rows)), "researcher").count() == 0


def test_threat_intelligence_looks_back_only(spark):
    text = "Send 1450 rupees to parcel.desk@okicici today."
    core = V.reports_of(asked(spark, *({"investigation_id": i, "text": text} for i in (1, 2, 3)), {"investigation_id": 4, "text": PLAIN}))
    skipped = by_id(V.protect(core))
    assert {stages(r)["threat_intel"][0] for r in skipped.values()} == {"skipped"} and skipped[4]["recommended_actions"]
    r = by_id(V.protect(V.with_threat_intel(core)))
    assert {i: [round(m["confidence"], 2) for m in x["threat_intel"]] for i, x in r.items()} == {1: [], 2: [0.7], 3: [0.8], 4: []}
    assert {stages(x)["threat_intel"] for x in r.values()} == {("ok", None)} and len({m["campaign_id"] for x in r.values() for m in x["threat_intel"]}) == 1
    past = spark.createDataFrame([("old", "upi_id", "parcel.desk@okicici", 5)], "investigation_id string, kind string, value string, seq long").withColumn("ts", F.timestamp_seconds(F.lit(1)))
    with_past = by_id(V.with_threat_intel(core, past))
    assert {i: [round(m["confidence"], 2) for m in x["threat_intel"]] for i, x in with_past.items()} == {1: [0.7], 2: [0.8], 3: [0.9], 4: []}
    assert len(r[2]["recommended_actions"]) > len(r[1]["recommended_actions"])


def test_buckets_of_the_full_investigation_follow_the_cores(spark, sf, monkeypatch):
    from lurewatch.plans import investigation_queries as Q

    asked = []
    lay_out = Q.V.lay_out
    monkeypatch.setattr(Q.V, "lay_out", lambda tables, buckets=64: asked.append(buckets) or lay_out(tables, buckets))
    Q.full_investigation(spark, sf)
    assert asked == [4 * spark.sparkContext.defaultParallelism] * 2
