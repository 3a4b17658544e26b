"""Order-dependent and grouped operators against brute force, both ways of running."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from lurewatch.operators import corpus as C
from lurewatch.operators import evaluation as E
from lurewatch.operators import fusion as FU
from lurewatch.operators import intel as I
from lurewatch.operators import learning as ML
from lurewatch.operators import maintenance as M
from lurewatch.operators import sessions as S
from lurewatch.operators.ordering import MAX_GROUP_ROWS_KEY, hot_bounds, lagged, ranked, running
from lurewatch.sources import readers, sinks
from lurewatch.sources.keyed import KeyedTable


@pytest.fixture(params=["window", "ranges"])
def mode(request, spark):
    spark.conf.set(MAX_GROUP_ROWS_KEY, "1000000" if request.param == "window" else "5")
    yield request.param
    spark.conf.unset(MAX_GROUP_ROWS_KEY)


def skewed(spark, n=600):
    rng = random.Random(5)
    rows = [("hot" if rng.random() < 0.6 else f"k{rng.randrange(8)}", rng.randrange(50), i, rng.random()) for i in range(n)]
    return rows, spark.createDataFrame(rows, "k string, ts long, seq long, x double")


def test_running(spark, mode):
    rows, df = skewed(spark)
    out = running(df, ["k"], ["ts", "seq"], total=("sum", F.col("x")), top=("max", F.col("x")), low=("min", F.col("ts")), n=("count", F.lit(1)),
                  seen=("max", F.when(F.col("x") > 0.9, F.col("seq"))))
    got = {r["seq"]: r for r in out.collect()}
    assert len(got) == len(rows)
    for k in {r[0] for r in rows}:
        total, top, n, seen, low = 0.0, 0.0, 0, None, None
        for _, ts, seq, x in sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2])):
            total, top, n = total + x, max(top, x), n + 1
            low = ts if low is None else min(low, ts)
            seen = seq if x > 0.9 and (seen is None or seq > seen) else seen
            r = got[seq]
            assert r["total"] == pytest.approx(total) and (r["top"], r["n"], r["seen"], r["low"]) == (top, n, seen, low)


def test_ranked_descending(spark, mode):
    rows, df = skewed(spark)
    got = {r["seq"]: r["rn"] for r in ranked(df, ["k"], ["ts", "seq"], descending=True).collect()}
    for k in {r[0] for r in rows}:
        order = sorted((r for r in rows if r[0] == k), key=lambda r: (-r[1], -r[2]))
        assert [got[r[2]] for r in order] == list(range(1, len(order) + 1))


def test_hot_null_key_and_null_order(spark, mode):
    rows = [(None if i % 3 else "cold", None if i == 7 else i // 2, i) for i in range(60)]
    df = spark.createDataFrame(rows, "k string, ts long, seq long")
    for descending in (False, True):
        got = {r["seq"]: r["rn"] for r in ranked(df, ["k"], ["ts", "seq"], descending=descending).collect()}
        for k in (None, "cold"):
            order = sorted((r for r in rows if r[0] == k), key=lambda r: (r[1] is not None, r[1] or 0, r[2]), reverse=descending)
            assert [got[r[2]] for r in order] == list(range(1, len(order) + 1))


def test_only_hot_keys_are_cut_and_evenly(spark):
    """A key of 30 000 rows among keys of 60 is cut into ranges of about half the limit; nothing else is."""
    hot, cold = spark.range(30_000).select(F.lit("hot").alias("k"), "id"), spark.range(6_000).select((F.col("id") % 100).cast("string").alias("k"), "id")
    df = hot.unionByName(cold)
    assert hot_bounds(df, ["k"], ["id"]) is None
    spark.conf.set(MAX_GROUP_ROWS_KEY, "2000")
    try:
        (bounds,) = hot_bounds(df, ["k"], ["id"]).collect()
        cuts = [b["id"] for piece in bounds["__bounds"] for b in piece]
        sizes = [b - a for a, b in zip([0, *cuts], [*cuts, 30_000], strict=True)]
        assert bounds["__k_k"] == "hot" and sorted(cuts) == cuts and 20 <= len(cuts) <= 40 and max(sizes) <= 2_500
        out = ranked(df, ["k"], ["id"]).filter("k = 'hot'")
        assert out.filter("rn = id + 1").count() == 30_000
    finally:
        spark.conf.unset(MAX_GROUP_ROWS_KEY)


def test_lagged_blocks(spark):
    df = spark.range(1, 38).select(F.lit("s").alias("k"), F.col("id").alias("rn"))
    out = lagged(df, ["k"], "rn", {"prev": "rn"}, 5, block=7)
    assert {r["rn"]: r["prev"] for r in out.collect()} == {i: [j for j in range(i - 1, i - 6, -1) if j >= 1] for i in range(1, 38)}


def test_reputation(spark, mode):
    rows, df = skewed(spark, 300)
    got = {r["domain"]: r["reputation_score"] for r in I.reputation(df.select(F.col("k").alias("domain"), F.col("x").alias("lexical_score"), "ts", "seq")).collect()}
    for k in {r[0] for r in rows}:
        value = None
        for r in sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2])):
            value = r[3] if value is None else 0.3 * r[3] + 0.7 * value
        assert got[k] == pytest.approx(value)


def test_correlation_sequence(spark, mode):
    rows = [(f"inv{i}", "upi_id", v, None, i) for i, v in enumerate(["A@ybl", "a@ YBL", "a@ybl"])] + [("inv0", "upi_id", "a@ybl", None, 9), ("inv5", "keyword", "x", None, 10)]
    df = spark.createDataFrame(rows, "investigation_id string, kind string, value string, n string, seq long").withColumn("ts", F.timestamp_seconds("seq")).drop("n")
    ind = I.indicators(df)
    got = {r["investigation_id"]: r for r in I.correlate(ind).collect()}
    assert {k: v["n_prior"] for k, v in got.items()} == {"inv1": 1, "inv2": 2}
    assert len({v["campaign_id"] for v in got.values()}) == 1
    c = I.campaigns(ind).collect()
    assert len(c) == 1 and c[0]["name"] == "upi_id:a@ YBL" and c[0]["campaign_id"] == got["inv2"]["campaign_id"]
    assert I.rollup(ind).first()["occurrence_count"] == 4
    assert {r["investigation_id"] for r in I.matches_of(ind, "inv2").collect()} == {"inv0", "inv1"}


def test_fusion(spark):
    rows = [("a", "pattern", 0.8), ("b", "pattern", 1.0), ("b", "ml_text", 0.0), ("c", "nobody", 0.9)]
    df = FU.attach_weights(spark.createDataFrame(rows, "investigation_id string, source string, score double"))
    got = {r[0]: (r["risk_score"], r["contributing_sources"]) for r in FU.fuse(df).collect()}
    assert got == {"a": (0.8, ["pattern"]), "b": (0.625, ["ml_text", "pattern"]), "c": (0.0, [])}


@pytest.mark.parametrize("evidence,opinion,want", [
    (("scam", 80, 0.9, True), None, ("scam", 80, False)), (("likely_safe", 10, 0.9, True), ("scam", 70, 0.1), ("scam", 70, True)),
    (("scam", 80, 0.9, True), ("likely_safe", 5, 0.99), ("scam", 80, False)), (("scam", 80, 0.3, True), ("likely_safe", 5, 0.5), ("scam", 80, False)),
    (("scam", 80, 0.3, True), ("likely_safe", 5, 0.9), ("likely_safe", 5, True)), (("scam", 80, 0.9, False), ("likely_safe", 5, 0.9), ("likely_safe", 5, True)),
    (("scam", 80, 0.9, True), ("scam", 80, 0.9), ("scam", 80, False)),
])
def test_override(spark, evidence, opinion, want):
    o = opinion or (None, None, None)
    df = spark.createDataFrame([(*evidence, *o, "")], "verdict string, risk_score int, confidence double, deterministic boolean, o_verdict string, o_risk_score int, o_confidence double, o_rationale string")
    r = FU.resolve_opinion(df).first()
    assert (r["verdict"], r["risk_score"], r["overridden"]) == want


def test_repeated_replies(spark):
    rng = random.Random(3)
    words = "ok tell me more about the plan please now later send call".split()
    rows = [(s, t, "agent" if t % 2 else "scammer", " ".join(rng.choice(words) for _ in range(rng.randrange(2, 7)))) for s in range(4) for t in range(30)]
    got = {(r["session_id"], r["turn"]): r["too_similar"] for r in S.repeated_replies(spark.createDataFrame(rows, "session_id int, turn int, sender string, text string")).collect()}
    for s in range(4):
        past = []
        for _, t, sender, text in (r for r in rows if r[0] == s):
            if sender == "agent":
                want = any(difflib.SequenceMatcher(None, text, p).ratio() >= 0.75 for p in past[-5:])
                assert got[(s, t)] == want
                past.append(text)


@pytest.mark.parametrize("turns,score,gone,want", [(7, 100, False, False), (7, 0, True, True), (25, 0, False, True), (14, 49, True, False), (12, 50, False, True), (11, 50, False, False), (8, 80, False, True), (15, 0, True, True)])
def test_completion_ladder(spark, turns, score, gone, want):
    assert spark.range(1).select(S.complete(F.lit(turns), F.lit(score), F.lit(gone))).first()[0] is want


def test_sweep_equals_row_by_row(spark):
    rng = random.Random(1)
    rows = [(rng.random(), rng.random() < 0.4) for _ in range(200)]
    got = {r["threshold"]: (r["tp"], r["fp"], r["tn"], r["fn"]) for r in E.sweep(spark.createDataFrame(rows, "c double, is_scam boolean"), F.col("c")).collect()}
    assert len(got) == len(E.SWEEP)
    for t, cells in got.items():
        assert cells == tuple(sum(1 for c, a in rows if (c > t) == p and a == q) for p, q in ((True, True), (True, False), (False, False), (False, True)))


def test_purge_is_idempotent_and_audited(spark):
    inv = spark.sql("SELECT * FROM VALUES ('a', TIMESTAMP'2020-01-01', 'retained'), ('b', TIMESTAMP'2999-01-01', 'retained'), ('c', NULL, 'retained') AS t(id, purge_at, evidence_state)")
    ent = spark.createDataFrame([("a", "x"), ("b", "y")], "investigation_id string, value string")
    now = F.lit("2024-01-01").cast("timestamp")
    out = M.purge(inv, {"entities": ent}, now)
    assert [r[0] for r in out["entities"].collect()] == ["b"] and out["audit"].count() == 1
    assert M.purge(out["investigations"], {"entities": out["entities"]}, now)["audit"].count() == 0


def test_keyed_sink(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), ("k",)).create(spark.createDataFrame([(f"k{i}", i) for i in range(50)], "k string, v int"))
    for _ in range(2):
        table.replace(spark.createDataFrame([("k1", 100), ("new", 5)], "k string, v int"))
    got = dict(table.read().collect())
    assert len(got) == 51 and got["k1"] == 100 and got["new"] == 5 and got["k2"] == 2
    table.delete(spark.createDataFrame([(f"k{i}",) for i in range(50)], "k string"))
    assert dict(table.read().collect()) == {"new": 5}


def test_a_session_stored_again_loses_what_it_no_longer_has(spark, tmp_path):
    one = '{"sessions": {"s1": {"scamDetected": true, "startTime": 1700000000, "conversationHistory": [{"sender": "a", "text": "x"}], "extractedIntelligence": {"upiIds": ["a@ybl", "b@ybl"]}}, "s2": {"extractedIntelligence": {"upiIds": ["c@ybl"]}}}}'
    two = '{"sessions": {"s1": {"scamDetected": false, "startTime": 1700000000, "conversationHistory": [{"sender": "a", "text": "y"}, {"sender": "b", "text": "z"}]}}}'
    for payload in (one, two, two):
        sinks.log_sessions(readers.sessions_from_json(spark.createDataFrame([(payload,)], "payload string")), str(tmp_path))
    tables = sinks.evidence_tables(spark, str(tmp_path))
    assert [(r["investigation_id"], r["value"]) for r in tables["entities"].read().collect()] == [("s2", "c@ybl")]
    assert sorted(r["text"] for r in tables["messages"].read().collect()) == ["y", "z"]
    assert {r["id"]: r["verdict"] for r in tables["investigations"].read().collect()} == {"s1": "likely_safe", "s2": "likely_safe"}


def test_file_sources(spark, tmp_path):
    (tmp_path / "e.json").write_text('{"purpose": "p",\n "labels": ["a"],\n "examples": [{"text": "x", "is_scam": true, "category": "c"}, {"text": "y", "is_scam": false}]}')
    assert [r["text"] for r in readers.labelled_examples(spark, str(tmp_path / "e.json")).collect()] == ["x", "y"]
    (tmp_path / "p.json").write_text('{"pairs": [{"id": "1", "known": {"text": "k", "is_scam": true}, "unseen": {"text": "u", "is_scam": true}}]}')
    assert sorted((r["half"], r["text"]) for r in readers.paraphrase_pairs(spark, str(tmp_path / "p.json")).collect()) == [("known", "k"), ("unseen", "u")]
    (tmp_path / "blank.json").write_text("\n \n")
    assert readers.session_file(spark, str(tmp_path / "blank.json")).count() == 0
    assert readers.session_file(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "s.json").write_text('{"sessions": {"s1": {"scamDetected": true, "startTime": 1700000000, "extractedIntelligence": {"upiIds": ["a@ybl"]}}}}')
    row = readers.session_file(spark, str(tmp_path / "s.json")).first()
    assert row["session_id"] == "s1" and row["intel"]["upiIds"] == ["a@ybl"]
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.7 ...")
    (tmp_path / "b.bin").write_bytes(b"0" * 100)
    got = {r["path"].rsplit("/", 1)[1]: (r["kind"], r["rejection"]) for r in readers.attachments(spark, str(tmp_path), max_bytes=50, pattern="*.{pdf,bin}").collect()}
    assert got == {"a.pdf": ("pdf", None), "b.bin": (None, "too_large")}


def test_attachment_files_written_and_sniffed(spark, tmp_path):
    contents = {"a%20 b.png": b"\x89PNG\r\n\x1a\n..", "ü#1.wav": b"RIFF1234WAVE", "short": b"\xff\xd8", "empty": None, "at limit": b"BM" + b"0" * 48, "over": b"BM" + b"0" * 49}
    folder = str(tmp_path / "in here")
    for _ in range(2):  # written again, nothing changes
        assert sinks.write_files(spark.createDataFrame(list(contents.items()), "name string, content binary"), folder) == 6
    rows = readers.attachments(spark, folder, max_bytes=50).collect()
    assert {r["path"].rsplit("/", 1)[1]: (r["length"], r["mime"], r["rejection"]) for r in rows} == {
        "a%20 b.png": (10, "image/png", None), "ü#1.wav": (12, "audio/wav", None), "short": (2, None, "unsupported_media"),
        "at limit": (50, "image/bmp", None), "over": (51, None, "too_large")}
    plan = readers.attachments(spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan


def test_term_features(spark):
    df = spark.createDataFrame([("Pay now, pay",)], "text string")
    r = df.select(ML.word_terms(F.col("text")).alias("w"), ML.char_terms(F.col("text")).alias("c")).first()
    assert r["w"] == ["pay", "now", "pay", "pay now", "now pay"]
    assert r["c"][:6] == [" pa", "pay", "ay ", " pay", "pay ", " pay "]


def test_labelled_grid_draws_without_repeats(spark):
    senders = spark.createDataFrame([(f"s{i}",) for i in range(10)] * 2, "sender string")
    slots = {"a": [["x", "y", "z"], ["1", "2"]], "b": [["p", "q"]]}
    whole = C.labelled_grid(senders, slots, {"a": 60, "b": 20}).collect()
    assert {(r["label"], r["text"]) for r in whole} == {("a", f"s{i} {u} {v}") for i in range(10) for u in "xyz" for v in "12"} | {("b", f"s{i} {u}") for i in range(10) for u in "pq"} and len(whole) == 80
    some = [r["text"] for r in C.labelled_grid(senders, slots, {"a": 25}).collect()]
    assert len(set(some)) == 25 and len({t.split()[0] for t in some}) == 10 and some != [r["text"] for r in C.labelled_grid(senders, slots, {"a": 25}, seed=8).collect()]
    with pytest.raises(ValueError, match="grid has 20"):
        C.labelled_grid(senders, slots, {"b": 21})


def test_cumulated_and_nth_value(spark):
    rows = [(i * 7 % 101, i % 5) for i in range(101)]
    df = spark.createDataFrame(rows, "v long, n long")
    total, want = 0, {}
    for v, n in sorted(rows):
        total += n
        want[v] = total
    assert {r["v"]: r["upto"] for r in E.running_total(df, "v").collect()} == want
    assert E.nth_value(df, ["v"], 40).first()["v"] == 39


def test_chosen_thresholds_equal_trying_all(spark):
    rng = random.Random(9)
    for case in range(3):
        rows = [(rng.random() < 0.4, rng.choice(["benign", "phishing"]), rng.random(), rng.random(), rng.random()) for _ in range(80)]
        bank = [(rng.choice(["benign", "phishing"]), *(rng.random() * (0.2, 0.5, 1.2)[case] for _ in range(3))) for _ in range(6)]
        got = E.choose_thresholds(spark.createDataFrame(rows, "is_scam boolean, predicted_label string, confidence double, not_benign double, margin double"),
                                   spark.createDataFrame(bank, "predicted_label string, confidence double, not_benign double, margin double")).collect()
        for r in got:
            at = {"top1": 2, "not_benign": 3, "margin": 4}[r["framing"]]
            called = lambda x: r["framing"] == "not_benign" or x == "phishing"  # noqa: E731, B023
            floor = max([b[at - 1] for b in bank if called(b[0])], default=0.0)
            tried = []
            for t in E.SWEEP:
                hit = [called(x[1]) and x[at] > t for x in rows]
                tp, fp = sum(h and x[0] for h, x in zip(hit, rows, strict=True)), sum(h and not x[0] for h, x in zip(hit, rows, strict=True))
                fn, tn = sum(x[0] for x in rows) - tp, sum(not x[0] for x in rows) - fp
                tried.append((round(2 * tp / (2 * tp + fp + fn), 3), t, round(fp / (fp + tn), 3)))
            safe = [x for x in tried if x[1] > floor]
            good = [x for x in safe if x[2] <= 0.10]
            want = max(good or safe)[1] if safe else round(min(0.95, floor + 0.05), 2)
            assert r["threshold"] == pytest.approx(want) and r["rule"] == ("within_limit" if good else "above_floor" if safe else "fallback") and r["floor"] == pytest.approx(floor)


def test_grid_makes_only_its_first_texts_distinct(spark):
    from hashlib import md5

    senders = ["a", "a x", "a", None, "b x x", "b", ""]
    slots = [["x", "x x"], ["x y", "y", "x"]]
    got = C.grid(spark.createDataFrame([(s,) for s in senders], "sender string"), slots, 9, 7)
    texts = {" ".join(p for p in (s, a, b) if p is not None) for s in senders for a in slots[0] for b in slots[1]}
    assert [r["text"] for r in got.collect()] == sorted(texts, key=lambda t: (md5(f"{t}#7".encode()).hexdigest(), t))[:9]
    assert "hashpartitioning(text" not in got._jdf.queryExecution().executedPlan().toString()
