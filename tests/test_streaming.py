"""Streams fed file by file agree with the batch form or with brute force."""

import random

import pytest
from pyspark.sql import functions as F

from lurewatch.operators import intel as I
from lurewatch.sources import keyed
from lurewatch.sources.keyed import KeyedTable
from lurewatch.streaming import streams as ST


def feed(spark, df, tmp_path, parts, key="seq"):
    """Write ``df`` as ``parts`` ordered files and open them as a one-file-per-batch stream."""
    import time

    src = str(tmp_path / "src")
    n = df.count()
    for i in range(parts):
        df.filter(f"{key} >= {i * n // parts} AND {key} < {(i + 1) * n // parts}").coalesce(1).write.mode("append").parquet(src)
        time.sleep(0.05)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)


def events(spark, n=240, seed=2):
    rng = random.Random(seed)
    t, rows = 1_700_000_000, []
    for i in range(n):
        t += rng.randrange(1, 20)
        rows.append((i, t, f"c{rng.randrange(3)}", rng.choice(["A@ybl", "b@ybl", "c@ybl"]), rng.random()))
    df = spark.createDataFrame(rows, "seq long, t long, caller string, value string, x double")
    return rows, df.withColumn("ts", F.timestamp_seconds("t"))


@pytest.mark.parametrize("parts", [1, 3])
def test_rate_limit(spark, tmp_path, parts):
    rows, df = events(spark)
    (calls,) = through(spark, feed(spark, df, tmp_path, parts), lambda root: ST.admission_batch(root, limit=2, window=60), tmp_path, parts, "calls")
    got = {r["seq"]: r["allowed"] for r in calls.collect()}
    for c in {r[2] for r in rows}:
        kept = []
        for seq, t, *_ in (r for r in rows if r[2] == c):
            kept = [k for k in kept if t - k < 60]
            ok = len(kept) < 2
            kept += [t] if ok else []
            assert got[seq] == ok
    assert not all(got.values()) and len(got) == len(rows)


@pytest.mark.parametrize("parts", [1, 3])
def test_repeats_after_the_ttl_are_let_through(spark, tmp_path, parts):
    rows, df = events(spark)
    judged, late = through(spark, feed(spark, df, tmp_path, parts), lambda root: ST.deliveries_batch(root, ["caller"], 120), tmp_path, parts, "judged", "late")
    got = {(r["caller"], int(r["ts"].timestamp())): r["let_through"] for r in judged.collect()}
    for c in {r[2] for r in rows}:
        first = None
        for _, t, *_ in (r for r in rows if r[2] == c):
            fresh = first is None or t - first >= 120
            first = t if fresh else first
            assert got[(c, t)] == fresh
    assert late.count() == 0


def test_state_of_deliveries_forgets(spark, tmp_path):
    """Keys that were let through long before the newest leave the state, replays change nothing, and old rows are logged."""
    root = str(tmp_path / "state")
    handler = ST.deliveries_batch(root, ["id"], 900, delay_seconds=600)
    batch = lambda *rows: spark.createDataFrame(list(rows), "id string, s long").withColumn("ts", F.timestamp_seconds("s"))
    handler(batch(("a", 0), ("b", 100), ("a", 10)), 0)
    for _ in range(2):
        handler(batch(("a", 899), ("c", 900), ("b", 5)), 1)
    assert {(r["id"], r["n"], r["let_through"]) for r in spark.read.parquet(f"{root}/judged").filter("epoch = 1").collect()} == {("a", 1, False), ("c", 1, True), ("b", 1, False)}
    assert [r["id"] for r in spark.read.parquet(f"{root}/late").collect()] == ["b"]
    handler(batch(("d", 10_000)), 2)
    assert {r["epoch"] for r in spark.read.parquet(f"{root}/last").select("epoch").distinct().collect()} <= {1, 2}
    handler(batch(("a", 10_001), ("a", 10_002)), 3)
    assert {r["id"] for r in spark.read.parquet(f"{root}/last/epoch=3").collect()} == {"a", "d"}
    assert spark.read.parquet(f"{root}/judged").filter("epoch = 3 AND let_through").count() == 1


def shuffled(spark, rows, schema, tmp_path, files, per_trigger):
    """Rows in any order over ``files`` files, read so many per micro-batch."""
    random.Random(7).shuffle(rows)
    src = str(tmp_path / f"src{per_trigger}")
    for i in range(files):
        df = spark.createDataFrame(rows[i::files], schema).withColumn("ts", F.timestamp_seconds("t"))
        df.coalesce(1).write.mode("append").parquet(src)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", per_trigger).parquet(src)


def through(spark, stream, handler, tmp_path, per_trigger, *names):
    root = str(tmp_path / f"state{per_trigger}")
    ST.run_available(stream.writeStream.foreachBatch(handler(root)), f"{root}/cp")
    return [spark.read.parquet(f"{root}/{n}") for n in names]


@pytest.mark.parametrize("replay", [False, True])
def test_incremental_correlation(spark, tmp_path, replay):
    _, df = events(spark)
    occ = df.select(F.concat(F.lit("inv"), (F.col("seq") % 17).cast("string")).alias("investigation_id"), F.lit("upi_id").alias("kind"), "value", "ts", "seq")
    root = str(tmp_path / "state")
    handler = ST.correlate_batch(root)

    def twice(batch, epoch):
        handler(batch, epoch)
        if replay:
            handler(batch, epoch)

    ST.run_available(feed(spark, occ, tmp_path, 4).writeStream.foreachBatch(twice), str(tmp_path / "cp"))
    key = lambda r: (r["investigation_id"], r["value_hash"], r["n_prior"], r["first_seen"])
    got = sorted(key(r) for r in spark.read.parquet(f"{root}/matches").collect())
    assert got == sorted(key(r) for r in I.correlate(I.indicators(occ)).collect())
    counts = {r["value_hash"]: r["occurrence_count"] for r in ST.current_rollup(spark, root).collect()}
    assert counts == {r["value_hash"]: r["occurrence_count"] for r in I.rollup(I.indicators(occ)).collect()}


def test_incremental_reputation(spark, tmp_path):
    _, df = events(spark)
    s = df.select(F.col("caller").alias("domain"), F.col("x").alias("lexical_score"), "ts", "seq")
    root = str(tmp_path / "state")
    ST.run_available(feed(spark, s, tmp_path, 4).writeStream.foreachBatch(ST.reputation_batch(root)), str(tmp_path / "cp"))
    got = {r["domain"]: r["reputation_score"] for r in ST.current_reputation(spark, root).collect()}
    want = {r["domain"]: r["reputation_score"] for r in I.reputation(s).collect()}
    assert got == pytest.approx(want)


def test_session_state_for_any_cut(spark, tmp_path):
    rows = [(1, t, "scammer" if t % 2 == 0 else "agent", f"pay u{t}@ybl" if t < 8 else "ok", 1_700_000_000 + t * 10) for t in range(24)]
    rows += [(2, t, "scammer", "bye scam" if t == 4 else "hello there friend of mine", 1_600_000_000 + t * 50) for t in range(12)]
    rows += [(3, t, "scammer", "hello there friend of mine", 1_650_000_000 + t * 50) for t in range(3)]
    for per_trigger in (1, 2, 1000):
        stream = shuffled(spark, list(rows), "session_id long, turn long, sender string, text string, t long", tmp_path, 4, per_trigger)
        snapshots, late = through(spark, stream, ST.sessions_batch, tmp_path, per_trigger, "snapshots", "late")
        turns = KeyedTable(spark, str(tmp_path / f"state{per_trigger}/turns"), ("session_id", "turn"), ("session_id",)).read()
        got = {r["session_id"]: (r["message_count"], r["intel_score"], r["is_complete"], r["completed_turn"]) for r in ST.current_sessions(snapshots).collect()}
        # session 1 has 240 points after turn 7, and the rule looks at the score from the eighth exchange on, that is turn 15
        assert got == {1: (24, 240, True, 15), 2: (12, 0, True, 4), 3: (3, 0, False, None)}
        assert turns.count() == len(rows) and (late.count() > 0) == (per_trigger < 4)
        assert {(r["session_id"], r["message_count"]) for r in ST.completions(ST.current_sessions(snapshots)).collect()} == {(1, 16), (2, 5)}


def test_jobs_dead_letter(spark, tmp_path):
    df = spark.createDataFrame([(i, "" if i % 5 == 0 else "hi") for i in range(20)], "seq long, text string").withColumn("investigation_id", F.col("seq"))
    root = str(tmp_path / "jobs")
    calls = []

    def investigate(b):
        calls.append(1)
        return b.select("investigation_id", F.length("text").alias("n"))

    handler = ST.investigation_batch(root, investigate, F.col("text") != "")
    both = df.unionByName(df)
    handler(both, 0)
    handler(both, 1)  # redelivery
    reports = spark.read.parquet(f"{root}/reports")
    assert {r["investigation_id"] for r in reports.collect()} == {i for i in range(20) if i % 5}
    boom = F.when(F.col("seq") == 7, F.raise_error(F.lit("boom")).cast("int")).otherwise(F.length("text"))
    broken = ST.investigation_batch(root, lambda b: b.select("investigation_id", boom.alias("n")), F.col("text") != "")
    broken(df.withColumn("investigation_id", F.col("seq") + 100), 2)
    dead = spark.read.parquet(f"{root}/dead_letters").filter("epoch = 2").collect()
    assert sorted(r["target_id"] for r in dead) == [100, 105, 107, 110, 115]
    assert ["boom" in r["reason"] for r in dead if r["target_id"] == 107] == [True]
    assert spark.read.parquet(f"{root}/reports").filter("epoch = 2").count() == 15


def test_last_readable_poll_is_the_feed(spark, tmp_path):
    root = str(tmp_path / "feed")
    poll = lambda *rows: spark.createDataFrame(list(rows), "polled_at long, payload string")
    handler = ST.feed_batch(root)
    current = lambda: [r["url"] for r in ST.current_feed(spark.read.parquet(f"{root}/polls")).collect()]
    handler(poll((1000, '{"urls": [{"url": "http://a"}, {"url": "http://b"}]}'), (1200, '{"urls": [{"url": "http://fresh"}]}'), (1300, '{"urls": [{"url": "http://c"}]}')), 0)
    assert current() == ["http://c"]
    for _ in range(2):  # a replay
        handler(poll((1599, '{"urls": [{"url": "http://fresh"}]}'), (1700, "<html>"), (1800, None)), 1)
        assert current() == ["http://c"]
    handler(poll((1900, '{"urls": []}'), (2000, '{"urls": [{"url": "http://fresh"}]}')), 2)
    assert current() == []


def test_a_silent_session_begins_anew(spark, tmp_path):
    root = str(tmp_path / "sessions")
    handler = ST.sessions_batch(root)
    turn = lambda *rows: spark.createDataFrame(list(rows), "session_id long, turn long, sender string, text string, t long").withColumn("ts", F.timestamp_seconds("t"))
    handler(turn((1, 0, "scammer", "pay u1@ybl", 0), (2, 0, "scammer", "pay u2@ybl", 0)), 0)
    handler(turn((2, 1, "scammer", "hello again", 80_000)), 1)
    for _ in range(2):  # a replay
        handler(turn((1, 1, "scammer", "pay u3@ybl", 90_000), (2, 2, "agent", "well", 90_000)), 2)
    handler(turn((1, 2, "agent", "well", 90_100)), 3)
    got = {r["session_id"]: (r["message_count"], r["intel_score"]) for r in ST.current_sessions(spark.read.parquet(f"{root}/snapshots")).collect()}
    assert got == {1: (2, 30), 2: (3, 30)}


def test_work_of_an_epoch_does_not_grow_with_history(spark, tmp_path, monkeypatch):
    """Changes since the last compaction and one row per domain are all that an epoch reads."""
    root = str(tmp_path / "state")
    handler = ST.reputation_batch(root)
    monkeypatch.setattr(keyed.KeyedTable.maintain, "__defaults__", (None, None, 4))
    held = []
    for epoch in range(14):
        handler(spark.range(200).select(F.concat(F.lit("d"), (F.col("id") % 20).cast("string")).alias("domain"), (F.col("id") / 200).alias("lexical_score"),
                                        F.timestamp_seconds(F.col("id") + epoch * 1000).alias("ts"), F.col("id").alias("seq")), epoch)
        held.append(keyed.size_of(spark, f"{root}/reputation"))
    assert max(held[8:]) <= max(held[:8]) * 1.1 and len(KeyedTable(spark, f"{root}/reputation", ("domain",))._changes()) <= 4
    assert {r["sightings"] for r in ST.current_reputation(spark, root).collect()} == {140}


@pytest.mark.parametrize("layout", ["file", "folder", "both"])
def test_tables_of_one_file_or_a_folder_of_files_are_streamed_whole(spark, tmp_path, layout):
    _, df = events(spark, 60)
    pdf = df.select("seq", "caller").toPandas()
    if layout != "folder":
        pdf[:20].to_parquet(tmp_path / "events.parquet")
    if layout != "file":
        folder = "events.parquet" if layout == "folder" else "events-more.parquet"
        spark.createDataFrame(pdf[20:]).repartition(3).write.parquet(str(tmp_path / folder))
    pdf[:5].to_parquet(tmp_path / "others.parquet")
    stream = ST.file_stream(spark, str(tmp_path), "events", spark.createDataFrame(pdf).schema, max_files=2)
    ST.run_available(stream.writeStream.format("parquet").option("path", str(tmp_path / "out")), str(tmp_path / "cp"))
    got = sorted(r["seq"] for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == {"file": list(range(20)), "folder": list(range(20, 60)), "both": list(range(60))}[layout]
