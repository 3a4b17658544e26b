"""Keyed tables: replace, delete, replay, compaction, and what a change costs."""

import random

from pyspark.sql import functions as F

from lurewatch.sources import keyed
from lurewatch.sources.keyed import KeyedTable


def rows(spark, items):
    return spark.createDataFrame(list(items), "id string, part long, value long")


def content(df):
    return sorted((r["id"], r["part"], r["value"]) for r in df.collect())


def test_changes_against_a_dictionary(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(keyed, "BUCKET_BYTES", 400)
    rng = random.Random(1)
    state = {f"k{i}": [(0, i), (1, i)] for i in range(40)}
    flat = lambda s: sorted((k, p, v) for k, ps in s.items() for p, v in ps)
    t = KeyedTable(spark, str(tmp_path / "t"), ("id",)).create(rows(spark, flat(state)))
    for step in range(6):
        picked = {f"k{rng.randrange(60)}": [(p, 100 * step + p) for p in range(rng.randrange(1, 4))] for _ in range(7)}
        state |= picked
        version = t.replace(rows(spark, flat(picked)))
        gone = rng.sample(sorted(state), 3)
        t.delete(rows(spark, [(k, 0, 0) for k in gone]))
        state = {k: v for k, v in state.items() if k not in gone}
        assert content(t.read()) == flat(state) and t.version() == version + 1
        some = rng.sample(sorted(state), 4) + ["nobody"]
        assert content(t.read(rows(spark, [(k, 0, 0) for k in some]))) == flat({k: v for k, v in state.items() if k in some})
        if step == 3:
            t.compact()
            assert content(t.read()) == flat(state) and not t._changes() and len(t._bases()) == 1 and t._base()[1] > 1


def test_a_replayed_change_changes_nothing(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "t"), ("id",)).create(rows(spark, [("a", 0, 1), ("b", 0, 1)]))
    for _ in range(2):
        t.replace(rows(spark, [("a", 0, 2)]), version=7)
    t.delete(rows(spark, [("b", 0, 0)]), version=8)
    assert content(t.read()) == [("a", 0, 2)] and content(t.read(before=8)) == [("a", 0, 2), ("b", 0, 1)] and content(t.read(before=7)) == [("a", 0, 1), ("b", 0, 1)]


def test_one_row_writes_one_small_file_however_large_the_table(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(keyed, "BUCKET_BYTES", 20_000)
    cost = []
    for n in (1_000, 100_000):
        t = KeyedTable(spark, str(tmp_path / f"t{n}"), ("id",)).create(spark.range(n).select(F.col("id").cast("string").alias("id"), F.lit(0).cast("long").alias("part"), F.col("id").alias("value")))
        version = t.replace(rows(spark, [("17", 0, -1)]).coalesce(1))
        cost.append(keyed.size_of(spark, f"{t.path}/changes/{version}"))
        assert t.read().filter("value = -1").count() == 1 and t.read().count() == n
        plan = t.read(rows(spark, [("17", 0, 0)]))
        assert content(plan) == [("17", 0, -1)]
        filters = plan._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("]")[0]
        assert "bucket" in filters  # one bucket of the base is read
    assert cost[1] <= cost[0] + 64 and cost[1] < 4_000


def test_without_a_base(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "t"), ("id", "part"), ("id",))
    assert t.version() == -1
    t.replace(rows(spark, [("a", 0, 1), ("a", 1, 1)]))
    t.replace(rows(spark, [("a", 1, 2), ("b", 0, 2)]))
    assert content(t.read()) == [("a", 0, 1), ("a", 1, 2), ("b", 0, 2)] and content(t.read(rows(spark, [("a", 9, 9)]))) == [("a", 0, 1), ("a", 1, 2)]
    t.maintain(most=2)
    assert t._changes() == [] and content(t.read()) == [("a", 0, 1), ("a", 1, 2), ("b", 0, 2)]
    t.replace(rows(spark, [("c", 0, 3)]))
    t.compact(keep=lambda df: df.filter("id <> 'a'"))
    assert content(t.read()) == [("b", 0, 2), ("c", 0, 3)]


def test_a_bucket_that_outgrows_a_task_is_written_as_several_files(spark, tmp_path):
    size = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64kb")
    try:
        rows = spark.range(0, 60_000, 1, 6).selectExpr("id % 20000 AS k", "sha2(cast(id AS string), 256) AS x")
        table = KeyedTable(spark, str(tmp_path / "t"), ("k",)).create(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", size)
    assert len(list((tmp_path / "t").glob("base/*/bucket=0/*.parquet"))) > 3
    assert table.read().exceptAll(rows).isEmpty() and table.read().count() == 60_000
    table.delete(spark.range(5).selectExpr("id AS k"))
    assert table.read().count() == 60_000 - 15
