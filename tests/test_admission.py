"""TTL dedup and rate limit against one-by-one decisions."""

import random

import pytest
from pyspark.sql import functions as F

from lurewatch.operators import admission as A


def chain(stamps, ttl):
    out, last = set(), None
    for t in sorted(set(stamps)):
        if last is None or t - last >= ttl:
            out.add(t)
            last = t
    return out


@pytest.mark.parametrize("seed", range(4))
def test_first_deliveries_equal_a_walk(spark, seed):
    rng = random.Random(seed)
    rows = []
    for key in range(12):
        t = rng.randrange(-5000, 5000)
        for _ in range(rng.choice([1, 2, 10, 60])):
            t += rng.choice([0, 1, 30, 450, 899, 900, 901, 2500][: rng.choice([4, 8])])
            rows.append((f"k{key}" if key else None, "p", t))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "id string, platform string, s long").withColumn("ts", F.timestamp_seconds("s"))
    got = [(r["id"], r["s"]) for r in A.first_deliveries(df, ["platform", "id"]).select("id", F.unix_seconds("ts").alias("s")).collect()]
    want = {(k, t) for k in {r[0] for r in rows} for t in chain([r[2] for r in rows if r[0] == k], 900)}
    assert len(got) == len(set(got)) and set(got) == want


def test_one_key_over_many_ttls(spark):
    df = spark.range(40_000).select(F.lit("k").alias("id"), F.timestamp_seconds(F.col("id") * 7).alias("ts"))
    got = sorted(r["s"] for r in A.first_deliveries(df, ["id"], 60).select(F.unix_seconds("ts").alias("s")).collect())
    assert got == list(range(0, 40_000 * 7, 63))


def walk(rows, limit, window):
    out = {}
    for c in {r[0] for r in rows}:
        kept = []
        for _, t, seq in sorted((r for r in rows if r[0] == c), key=lambda r: r[1:]):
            kept = [k for k in kept if t - k < window]
            out[(c, seq)] = len(kept) < limit
            if out[(c, seq)]:
                kept.append(t)
    return out


@pytest.mark.parametrize(("seed", "limit", "parts", "piece"), [(1, 1, 1, 1000), (2, 3, 4, 300), (3, 5, 2, 1000), (4, 60, 4, 400)])
def test_admission_equals_a_walk(spark, seed, limit, parts, piece):
    rng = random.Random(seed)
    rows, seq = [], 0
    for c in ("a", "b", None):
        t = -300
        while t < 1500:
            t += rng.choice([0, 0, 1, 2, 5, 20, 59, 60, 61, 200] if c is None else [0, 1, 2] if c == "a" else range(1, 40))
            rows.append((c, t, seq))
            seq += 1
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "caller string, s long, seq long").withColumn("ts", F.timestamp_seconds("s"))
    got = [((r["caller"], r["seq"]), r["allowed"]) for r in A.admitted(df, limit, 60, parts, piece).collect()]
    assert len(got) == len(rows) and dict(got) == walk(rows, limit, 60)


def test_a_million_calls_of_one_caller_are_many_pieces(spark):
    n = 1_000_000
    df = spark.range(n).select(F.lit("c").alias("caller"), F.col("id").alias("seq"), F.timestamp_micros(F.col("id") * 3600).alias("ts"))  # an hour, 278 calls a second
    out = A.admitted(df, 60, 60, piece_calls=250_000).agg(F.count("*").alias("n"), F.count_if("allowed").alias("ok"), F.max(F.when(F.col("allowed"), F.col("seq"))).alias("last")).first()
    assert (out["n"], out["ok"]) == (n, 60 * 60) and out["last"] > 59 * n // 60


def test_no_rows(spark):
    none = spark.createDataFrame([], "caller string, seq long, ts timestamp")
    assert A.admitted(none).count() == 0 and A.first_deliveries(none, ["caller"]).count() == 0
    some = spark.createDataFrame([("a", 1, None)], "caller string, seq long, ts timestamp")
    assert A.admitted(some).count() == 0 and A.first_deliveries(some, ["caller"]).count() == 0
