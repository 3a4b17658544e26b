"""Structured Streaming forms of the operators.

Event time is the row's own time. Dedup and sessions keep their state in tables, one folder
per micro-batch, so that their answers do not depend on how the input is cut into batches.
Functions shipped to workers are built inside the calls, so they travel by
value.
"""

from __future__ import annotations

from collections.abc import Callable
from multiprocessing.pool import ThreadPool

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import IntegerType, StructField, StructType

from lurewatch import schemas
from lurewatch.operators import detection as P
from lurewatch.operators import intel as I
from lurewatch.operators import maintenance as M
from lurewatch.operators import sessions as S
from lurewatch.operators.admission import admitted, first_deliveries
from lurewatch.operators.ordering import ranked, running
from lurewatch.session import cut_lineage
from lurewatch.sources.keyed import KeyedTable
from lurewatch.sources.readers import feed_entries

DEDUP_TTL = 900
RATE_LIMIT, RATE_WINDOW = 60, 60
MAX_TRIES = 3
#: Seconds for which a feed that was read counts as fresh.
FEED_FRESH = 300


def file_stream(spark: SparkSession, folder: str, name: str, schema, max_files: int = 1000) -> DataFrame:
    """A table of ``folder`` as a stream, be it files or folders of files; the file limit bounds every micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(f"{folder.rstrip('/')}/{name}*.parquet")


def run_available(writer: DataStreamWriter, checkpoint: str) -> None:
    """Process everything there is, then stop."""
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


# -- tables of a stream ----------------------------------------------------------

def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _log(df: DataFrame, root: str, name: str, epoch: int) -> None:
    """One folder per epoch, overwritten on replay: exactly-once without a transaction."""
    df.write.mode("overwrite").parquet(f"{root}/{name}/epoch={epoch}")


def _earlier(spark: SparkSession, root: str, name: str, epoch: int, like: DataFrame) -> DataFrame:
    path = f"{root}/{name}"
    if not _exists(spark, path):
        return spark.createDataFrame([], like.schema)
    schema = StructType([*like.schema.fields, StructField("epoch", IntegerType())])
    return spark.read.schema(schema).parquet(path).filter(F.col("epoch") < epoch).drop("epoch")


# -- redelivery ---------------------------------------------------------------

def _epochs(spark: SparkSession, path: str) -> list[int]:
    """Finished epochs of a table."""
    if not _exists(spark, path):
        return []
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [f.getPath() for f in fs.listStatus(p) if f.getPath().getName().startswith("epoch=")]
    return sorted(int(f.getName()[6:]) for f in found if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f, "_SUCCESS")))


def _snapshot(spark: SparkSession, root: str, name: str, epoch: int, schema: str) -> DataFrame:
    """The newest snapshot before ``epoch``."""
    before = [e for e in _epochs(spark, f"{root}/{name}") if e < epoch]
    return spark.read.schema(schema).parquet(f"{root}/{name}/epoch={before[-1]}") if before else spark.createDataFrame([], schema)


def _forget(spark: SparkSession, root: str, name: str, epoch: int) -> None:
    """Drop snapshots that no replay of ``epoch`` can ask for."""
    old = [e for e in _epochs(spark, f"{root}/{name}") if e < epoch][:-1]
    for e in old:
        p = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}/epoch={e}")
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def deliveries_batch(root: str, keys: list[str], ttl_seconds: int = DEDUP_TTL, delay_seconds: int = 3600) -> Callable[[DataFrame, int], None]:
    """Micro-batch handler: which deliveries are let through, each at least one TTL after the last of its key.

    ``judged`` has every (key, ts) with its number of deliveries ``n`` and whether one of them was let through. State is one
    stamp per key that was let through not longer ago than the TTL and ``delay_seconds``, so it grows with the traffic of that
    time only. Batches in order of time give the same answer for any cut. A delivery older than its key's last one let
    through is judged by that one alone, and logged as ``late``.
    """
    ttl = F.make_dt_interval(secs=F.lit(ttl_seconds))

    def handle(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        kinds = dict(batch.dtypes)
        schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", last timestamp"
        state = _snapshot(spark, root, "last", epoch, schema).persist()
        counted = batch.select(*keys, F.col("ts").cast("timestamp").alias("ts")).filter("ts IS NOT NULL").groupBy(*keys, "ts").agg(F.count("*").alias("n"))
        same = lambda a, b: [a[k].eqNullSafe(b[k]) for k in keys]
        joined = counted.join(state, same(counted, state), "left").select(*[counted[k] for k in keys], "ts", "n", "last").persist()
        late = joined.filter("ts < last").withColumn("let_through", F.col("ts") + ttl <= F.col("last"))
        now = joined.filter("last IS NULL OR ts >= last")
        through = first_deliveries(now.select(*keys, "ts").unionByName(state.withColumnRenamed("last", "ts")), keys, ttl_seconds)
        through = through.withColumn("let_through", F.lit(True)).persist()
        marked = now.join(through.alias("a"), [*same(now, through), now["ts"] == through["ts"]], "left")
        fresh = F.coalesce(through["let_through"], F.lit(False)) & ~F.coalesce(now["ts"] == now["last"], F.lit(False))
        marked = marked.select(*[now[k] for k in keys], now["ts"], "n", fresh.alias("let_through"))
        _log(marked.unionByName(late.drop("last")), root, "judged", epoch)
        _log(late.select(*keys, "ts", "last"), root, "late", epoch)
        last = through.groupBy(*keys).agg(F.max("ts").alias("last"))
        newest = last.agg(F.max("last").alias("newest"))
        kept = last.join(F.broadcast(newest)).filter(F.col("last") + ttl > F.col("newest") - F.make_dt_interval(secs=F.lit(delay_seconds))).drop("newest")  # one row
        _log(kept, root, "last", epoch)
        _forget(spark, root, "last", epoch)
        for df in (state, joined, through):
            df.unpersist()

    return handle


# -- rate limiting -------------------------------------------------------------

def admission_batch(root: str, limit: int = RATE_LIMIT, window: int = RATE_WINDOW, delay_seconds: int = 60) -> Callable[[DataFrame, int], None]:
    """Micro-batch handler: ``allowed`` per call, at most ``limit`` allowed calls in the last ``window`` seconds.

    Needs caller, ts, seq. Refused calls do not count, so each decision depends on the ones before it; state is the allowed
    stamps of the window and ``delay_seconds`` before the newest call. A call that is older than one already allowed to its
    caller is judged as of that one.
    """
    def handle(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        kind = dict(batch.dtypes)["caller"]
        state = _snapshot(spark, root, "allowed", epoch, f"caller {kind}, ts timestamp, seq long").persist()
        newest = state.groupBy("caller").agg(F.max("ts").alias("newest"))
        calls = batch.select("caller", F.col("ts").cast("timestamp").alias("ts"), F.col("seq").cast("long").alias("seq"))
        calls = calls.join(newest, calls["caller"].eqNullSafe(newest["caller"]), "left").select(calls["caller"], F.greatest("ts", "newest").alias("ts"), "seq", F.lit(False).alias("fixed"))
        decided = admitted(calls.unionByName(state.withColumn("fixed", F.lit(True))), limit, window).persist()
        _log(decided, root, "calls", epoch)
        held = state.unionByName(decided.filter("allowed").select("caller", "ts", "seq"))
        end = held.agg(F.max("ts").alias("end"))
        span = F.make_dt_interval(secs=F.lit(window + delay_seconds))
        _log(held.join(F.broadcast(end)).filter(F.col("ts") > F.col("end") - span).drop("end"), root, "allowed", epoch)  # one row
        _forget(spark, root, "allowed", epoch)
        state.unpersist()
        decided.unpersist()

    return handle


# -- sessions ------------------------------------------------------------------

def sessions_batch(root: str, idle_hours: int = 24) -> Callable[[DataFrame, int], None]:
    """Micro-batch handler: a snapshot of every session that got new turns.

    Turns and first-seen values are keyed tables, of which a batch reads the sessions it touches; a snapshot is the batch
    roll-up of a session's turns so far, with the completion rule asked after every message in turn order. The last snapshot of
    a session therefore does not depend on how its turns were cut into batches. A turn that comes after a later one is also
    logged as ``late``. A session that was silent for ``idle_hours`` before its new turns begins anew.
    """
    idle = F.make_dt_interval(hours=F.lit(idle_hours))

    def fresh_only(rows: DataFrame) -> DataFrame:
        newest = rows.agg(F.max("ts").alias("newest"))  # one row
        last = rows.groupBy("session_id").agg(F.max("ts").alias("last")).join(F.broadcast(newest)).filter(F.col("last") + idle > F.col("newest"))
        return rows.join(last.select("session_id"), "session_id", "left_semi")

    def handle(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        turn_table = KeyedTable(spark, f"{root}/turns", ("session_id", "turn"), ("session_id",))
        value_table = KeyedTable(spark, f"{root}/values", ("session_id", "kind", "value"), ("session_id",))
        turn_table.maintain(fresh_only, before=epoch)
        value_table.maintain(before=epoch)
        turns = batch.select("session_id", "turn", "sender", "text", "ts").dropDuplicates(["session_id", "turn"]).persist()
        stored = turn_table.read(turns, before=epoch, like=turns.schema)
        new = turns.join(stored.select("session_id", "turn"), ["session_id", "turn"], "left_anti").persist()
        begins = new.groupBy("session_id").agg(F.min("ts").alias("begins"))
        silent = stored.groupBy("session_id").agg(F.max("ts").alias("last")).join(begins, "session_id").filter(F.col("last") + idle <= F.col("begins")).select("session_id")
        silent = cut_lineage(silent)
        history = stored.join(begins, "session_id", "left_semi").join(silent, "session_id", "left_anti")
        found = S.session_values(S.turn_entities(new)).persist()
        known = value_table.read(turns, before=epoch, like=found.schema)
        earlier = known.join(begins, "session_id", "left_semi").join(silent, "session_id", "left_anti")
        values = earlier.unionByName(found).groupBy("session_id", "kind", "value").agg(F.min("first_turn").alias("first_turn")).persist()
        snapshots = S.rollup(history.unionByName(new), values)
        _log(snapshots.select("session_id", "message_count", "intel_score", "is_complete", "completed_turn", "completed_at", "completed_score"), root, "snapshots", epoch)
        ahead = history.groupBy("session_id").agg(F.max("turn").alias("last_turn"))
        _log(new.join(ahead, "session_id").filter("turn < last_turn").select("session_id", "turn", "last_turn"), root, "late", epoch)
        gone = lambda df: df.join(silent, "session_id", "left_semi")
        value_table.replace(values.select(found.columns), epoch, also=gone(known))
        turn_table.replace(new, epoch, also=gone(stored))
        for df in (turns, new, found, values):
            df.unpersist()

    return handle


def current_sessions(snapshots: DataFrame) -> DataFrame:
    """The last snapshot of every session."""
    columns = [c for c in snapshots.columns if c not in ("session_id", "epoch")]
    last = snapshots.groupBy("session_id").agg(F.max_by(F.struct(*columns), "epoch").alias("s"))
    return last.select("session_id", "s.*")


def completions(sessions: DataFrame) -> DataFrame:
    """Sessions whose completion rule has fired, as they stood when it first did."""
    return sessions.filter("completed_at IS NOT NULL").select(
        "session_id", F.col("completed_at").alias("message_count"), F.col("completed_score").alias("intel_score"))


# -- incremental correlation and reputation --------------------------------------

def correlate_batch(root: str) -> Callable[[DataFrame, int], None]:
    """Micro-batch handler: new occurrences against the stored ones and each other.

    State is one row per indicator (``rollups``: occurrences of distinct investigations, calls, first and last sight) and one
    per investigation and indicator (``occurrences``); a batch reads the indicators it touches.
    """
    keys = ["kind", "value_hash"]

    def handle(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        occurrences = KeyedTable(spark, f"{root}/occurrences", ("investigation_id", *keys))
        rollups = KeyedTable(spark, f"{root}/rollups", tuple(keys))
        occurrences.maintain(before=epoch)
        rollups.maintain(before=epoch)
        ind = I.indicators(batch).persist()
        firsts = I.first_occurrences(ind).select("investigation_id", *keys, "value", "ts", "seq").persist()
        stored = occurrences.read(firsts, before=epoch, like=firsts.select("investigation_id", *keys).schema)
        new = firsts.join(stored, ["investigation_id", *keys], "left_anti").persist()
        seen = "kind string, value_hash string, n long, first_ts timestamp, first_seen timestamp, last_seen timestamp, occurrence_count long"
        known = cut_lineage(rollups.read(ind, before=epoch, like=seen))
        occ = running(new, keys, ["ts", "seq"], position=("count", F.lit(1)), batch_first=("min", F.col("ts")))
        joined = occ.join(known.select(*keys, "n", "first_ts"), keys, "left")
        prior = F.col("position") - 1 + F.coalesce("n", F.lit(0))
        matches = joined.withColumn("n_prior", prior).filter("n_prior > 0").select(
            "investigation_id", *keys, "value", "ts", F.coalesce(F.least("first_ts", "batch_first"), "batch_first").alias("first_seen"),
            "n_prior", I.campaign_id(F.col("kind"), F.col("value_hash")).alias("campaign_id"),
        )
        _log(matches, root, "matches", epoch)
        added = new.groupBy(*keys).agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"))
        merged = known.unionByName(I.rollup(ind).join(added, keys, "left")).groupBy(*keys).agg(
            F.sum("n").alias("n"), F.min("first_ts").alias("first_ts"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
            F.sum("occurrence_count").alias("occurrence_count"))
        rollups.replace(merged, epoch)
        occurrences.replace(new.select("investigation_id", *keys), epoch)
        for df in (ind, firsts, new):
            df.unpersist()

    return handle


def current_rollup(spark: SparkSession, root: str) -> DataFrame:
    """First and last sight and number of calls per indicator so far."""
    return KeyedTable(spark, f"{root}/rollups", ("kind", "value_hash")).read().select("kind", "value_hash", "first_seen", "last_seen", "occurrence_count")


def reputation_batch(root: str, alpha: float = I.EMA_ALPHA) -> Callable[[DataFrame, int], None]:
    """Micro-batch handler: one row of state per domain (sightings, weighted sum, first value), of which a batch reads its own."""
    keep = F.lit(1 - alpha)

    def handle(batch: DataFrame, epoch: int) -> None:
        state = KeyedTable(batch.sparkSession, f"{root}/reputation", ("domain",))
        state.maintain(before=epoch)
        back = ranked(batch, ["domain"], ["ts", "seq"], "distance", descending=True)
        delta = cut_lineage(back.groupBy("domain").agg(
            F.count(F.lit(1)).alias("n"), F.sum(alpha * F.pow(keep, F.col("distance") - 1) * F.col("lexical_score")).alias("s"),
            F.min_by("lexical_score", F.struct("ts", "seq")).alias("first_value")))
        known = state.read(delta, before=epoch, like=delta.schema).select("domain", F.col("n").alias("n0"), F.col("s").alias("s0"), F.col("first_value").alias("x0"))
        merged = delta.join(known, "domain", "left").select(
            "domain", (F.col("n") + F.coalesce("n0", F.lit(0))).alias("n"), (F.col("s") + F.coalesce("s0", F.lit(0.0)) * F.pow(keep, F.col("n"))).alias("s"),
            F.coalesce("x0", "first_value").alias("first_value"))
        state.replace(merged, epoch)

    return handle


def current_reputation(spark: SparkSession, root: str, alpha: float = I.EMA_ALPHA) -> DataFrame:
    """Today's reputation of every domain."""
    keep = F.lit(1 - alpha)
    state = KeyedTable(spark, f"{root}/reputation", ("domain",)).read()
    return state.select("domain", (F.col("s") + keep * F.pow(keep, F.col("n") - 1) * F.col("first_value")).alias("reputation_score"), F.col("n").alias("sightings"))


# -- investigations and feeds ------------------------------------------------------

def failing_parts(df: DataFrame, job: Callable[[DataFrame], DataFrame], key: str, tries: int = MAX_TRIES, ways: int = 4) -> list[tuple[int, int, str]]:
    """(bits, rest, reason): hash classes of ``key`` on which ``job`` fails, split until a class holds one key.

    The classes of a round run side by side, each a job over its share of ``df``; a failing one splits ``2 ** ways`` ways in the
    next round. A class of one key is tried ``tries`` times.
    """
    def attempt(part: tuple[int, int]) -> tuple[str | None, bool]:
        rows = df.filter(F.pmod(F.xxhash64(key), F.lit(1 << part[0])) == part[1])
        single, reason = None, None
        for _ in range(tries):
            try:
                job(rows).write.format("noop").mode("overwrite").save()
                return None, False
            except Exception as exc:  # noqa: BLE001 - whatever the job raises ends in the dead letters
                reason = str(exc)[:500]
                single = part[0] >= 60 or rows.select(key).distinct().limit(2).count() < 2 if single is None else single
                if not single:
                    break
        return reason, bool(single)

    todo, failed = [(0, 0)], []
    with ThreadPool(8) as pool:
        while todo:
            results = list(zip(todo, pool.map(attempt, todo), strict=True))
            failed += [(bits, rest, reason) for (bits, rest), (reason, single) in results if reason is not None and single]
            todo = [(bits + ways, rest + (i << bits)) for (bits, rest), (reason, single) in results if reason is not None and not single for i in range(1 << ways)]
    return failed


def investigation_batch(root: str, investigate: Callable[[DataFrame], DataFrame], valid: Column) -> Callable[[DataFrame, int], None]:
    """Micro-batch handler: skip reported ids; ids that fail ``valid`` or three tries become dead letters, the rest reports.

    Needs ``investigation_id``. If the batch fails as a whole, the failing ids are found by splitting it.
    """
    def handle(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        ids = batch.select("investigation_id")
        todo = M.unreported(batch.dropDuplicates(["investigation_id"]), _earlier(spark, root, "reports", epoch, ids)).persist()
        dead, good = M.audit_rows(todo.filter(~valid).select("investigation_id"), "worker", "job_failed", "request has no content"), todo.filter(valid)
        try:
            _log(investigate(good), root, "reports", epoch)
        except Exception:  # noqa: BLE001 - which ids are to blame is found out below
            for bits, rest, reason in failing_parts(good, investigate, "investigation_id"):
                bad = F.pmod(F.xxhash64("investigation_id"), F.lit(1 << bits)) == rest
                dead = dead.unionByName(M.audit_rows(good.filter(bad).select("investigation_id"), "worker", "job_failed", reason))
                good = good.filter(~bad)
            _log(investigate(good), root, "reports", epoch)
        _log(dead, root, "dead_letters", epoch)
        todo.unpersist()

    return handle


def feed_batch(root: str, fresh_seconds: int = FEED_FRESH) -> Callable[[DataFrame, int], None]:
    """Micro-batch handler of polls (polled_at in seconds, payload): which are taken over as the feed.

    While the feed is fresh, polls change nothing; an unreadable poll leaves the last good one in place.
    """
    def handle(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        known = _earlier(spark, root, "polls", epoch, batch.select("polled_at", "payload")).agg(F.max("polled_at").alias("polled_at")).filter("polled_at IS NOT NULL")
        at = lambda df: df.select(F.lit("feed").alias("feed"), F.timestamp_seconds("polled_at").alias("ts"))
        readable = batch.filter(F.from_json("payload", schemas.FEED)["urls"].isNotNull())
        readable = readable.groupBy("polled_at").agg(F.min("payload").alias("payload")).join(known.withColumnRenamed("polled_at", "kept"), F.col("polled_at") <= F.col("kept"), "left_anti")
        taken = first_deliveries(at(readable).unionByName(at(known)), ["feed"], fresh_seconds).select(F.unix_seconds("ts").alias("polled_at"))
        _log(readable.join(taken, "polled_at", "left_semi").select("polled_at", "payload"), root, "polls", epoch)

    return handle


def current_feed(polls: DataFrame) -> DataFrame:
    """Entries of the latest readable poll; none if that poll was empty."""
    return feed_entries(polls.agg(F.max_by("payload", "polled_at").alias("payload")))


def score_messages(stream: DataFrame) -> DataFrame:
    """Stateless scoring: the batch column expressions on a stream."""
    return P.pattern_verdict(stream)
