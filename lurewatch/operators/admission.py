"""Decisions that depend on earlier decisions of the same key, without replaying a key in one task.

``first_deliveries``: a delivery is let through if none of its key was within the TTL before it. Let-through stamps form a
chain: from each the next is the first stamp at least one TTL later. A gap of a TTL starts the chain anew, so only
stretches longer than a TTL need it; there every stamp gets a pointer to the one that would follow it, and the chain from
the stretch's first stamp is marked by pointer doubling in as many rounds as the stretch's TTLs have binary digits.

``admitted``: a call is allowed if fewer than ``limit`` allowed calls lie in the window before it. Where all calls of two
windows number no more than the limit, every call is allowed and what counts later is known without history. Only the busy
stretches between such places are replayed, side by side; long ones in pieces, each after the one before it.

Both first reduce a key to counts per span of time, so that what one task sees of a key grows with its time only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lurewatch.session import cut_lineage

TTL = 900
LIMIT, WINDOW = 60, 60
#: Parts of a window whose calls are counted together, and calls of a busy stretch that one task replays.
PARTS, PIECE_CALLS = 4, 500_000


def _micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def _stretches(stamps: DataFrame, keys: list[str], ttl: int) -> DataFrame:
    """Per key and span of one TTL: its first and last stamp, the stretch, and the first stamps of the next two spans of it."""
    spans = stamps.groupBy(*keys, "span").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    by = Window.partitionBy(*keys).orderBy("span")
    fresh = F.lag("hi").over(by).isNull() | (F.col("lo") - F.lag("hi").over(by) >= ttl)
    spans = spans.withColumn("root", fresh).withColumn("stretch", F.max(F.when(F.col("root"), F.col("lo"))).over(by))
    inside = Window.partitionBy(*keys, "stretch").orderBy("span")
    whole = Window.partitionBy(*keys, "stretch")
    adjoining = F.lead("span").over(inside) == F.col("span") + 1
    return spans.withColumns({
        "after": F.when(adjoining, F.lead("lo", 2).over(inside)).otherwise(F.lead("lo").over(inside)),  # first stamp past the next TTL span
        "next_hi": F.when(adjoining, F.lead("hi").over(inside)),
        "spans": F.count("*").over(whole), "long": F.max("hi").over(whole) - F.min("lo").over(whole) >= ttl,
    })


def _pointers(stamps: DataFrame, spans: DataFrame, keys: list[str], ttl: int) -> DataFrame:
    """(keys, t, jump): the first stamp at least one TTL after t within its stretch."""
    known = stamps.join(spans.filter("long").select(*keys, "span", "after", "next_hi"), [*keys, "span"])
    asks = known.filter(F.col("next_hi") >= F.col("t") + ttl).select(*keys, (F.col("span") + 1).alias("span"), (F.col("t") + ttl).alias("at"), F.lit(1).alias("asks"), "t")
    told = known.select(*keys, "span", F.col("t").alias("at"), F.lit(0).alias("asks"), "t")
    # stamps of a span against the questions of the span before it: at most two TTLs of one key
    later = Window.partitionBy(*keys, "span").orderBy(F.desc("at"), "asks").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = asks.unionByName(told).withColumn("jump", F.min(F.when(F.col("asks") == 0, F.col("t"))).over(later)).filter("asks = 1").select(*keys, "t", "jump")
    beyond = known.filter(F.col("next_hi").isNull() | (F.col("next_hi") < F.col("t") + ttl)).select(*keys, "t", F.col("after").alias("jump"))
    return found.unionByName(beyond).filter("jump IS NOT NULL")


def first_deliveries(df: DataFrame, keys: list[str], ttl_seconds: int = TTL) -> DataFrame:
    """(keys, ts) of the deliveries that are let through, each once; a repeat does not extend the TTL.

    Equal stamps of a key are one delivery. Rows without ts are ignored; null keys are keys like any other.
    """
    ttl = ttl_seconds * 1_000_000
    packed = [f"key_{i}" for i in range(len(keys))]  # null-safe keys
    tagged = df.select(*[F.to_json(F.struct(F.col(k).alias("k")), {"ignoreNullFields": "false"}).alias(p) for k, p in zip(keys, packed, strict=True)], *keys, _micros(F.col("ts")).alias("t")).filter("t IS NOT NULL")
    stamps = tagged.groupBy(*packed, "t").agg(*[F.first(k).alias(k) for k in keys])
    stamps = cut_lineage(stamps.withColumn("span", F.expr(f"t div {ttl} - if(t % {ttl} < 0, 1, 0)")))
    spans = cut_lineage(_stretches(stamps.drop(*keys), packed, ttl))
    accepted = spans.filter("root").select(*packed, F.col("lo").alias("t"))
    longest = spans.filter("long").agg(F.max("spans")).first()[0]
    if longest:
        jumps = cut_lineage(_pointers(stamps.drop(*keys), spans, packed, ttl))
        chain = cut_lineage(spans.filter("root AND long").select(*packed, F.col("lo").alias("t")))
        done = accepted.join(spans.filter("long AND root").select(*packed, F.col("lo").alias("t")), [*packed, "t"], "left_anti")
        for round_ in range(int(longest).bit_length()):
            chain = cut_lineage(chain.unionByName(chain.join(jumps, [*packed, "t"]).select(*packed, F.col("jump").alias("t"))).distinct())
            if round_ + 1 < int(longest).bit_length():
                ahead = jumps.select(*packed, F.col("t").alias("jump"), F.col("jump").alias("beyond"))
                jumps = cut_lineage(jumps.join(ahead, [*packed, "jump"]).select(*packed, "t", F.col("beyond").alias("jump")))
        accepted = done.unionByName(chain)
    out = stamps.join(accepted, [*packed, "t"])
    return out.select(*keys, F.timestamp_micros("t").alias("ts"))


def _replay(limit: int, window: int):
    """Decisions of one piece: ``fixed`` rows are allowed and come first."""
    def run(rows):
        import numpy as np

        rows = rows.sort_values(["fixed", "t", "seq"], ascending=[False, True, True])
        stamps, fixed = rows["t"].to_numpy(), rows["fixed"].to_numpy()
        given = int(fixed.sum())
        kept, allowed, i = list(stamps[:given][-limit:]), fixed.copy(), given
        while i < len(stamps):
            if len(kept) < limit or stamps[i] - kept[-limit] >= window:
                kept.append(stamps[i])
                allowed[i] = True
                i += 1
            else:  # none is allowed before the oldest of the last ``limit`` leaves the window
                i = max(i + 1, int(np.searchsorted(stamps[given:], kept[-limit] + window)) + given)
            if len(kept) > 4 * limit:
                kept = kept[-limit:]
        return rows[~fixed].assign(allowed=allowed[~fixed])[["caller", "t", "tick", "seq", "allowed"]]

    return run


def admitted(calls: DataFrame, limit: int = LIMIT, window_seconds: int = WINDOW, parts: int = PARTS, piece_calls: int = PIECE_CALLS) -> DataFrame:
    """(caller, ts, seq, allowed) of every call: at most ``limit`` allowed ones in any ``window_seconds``; refused ones don't count.

    ``calls``: caller, ts, seq (unique within a caller) and optionally ``fixed``: allowed before, decides but is not returned.
    Calls of the same time follow each other by seq. A null caller is a caller of its own. Rows without ts are ignored.
    """
    if limit < 1:
        raise ValueError("a limit of one call or more")
    window = window_seconds * 1_000_000
    width = -(-window // parts)
    fixed = F.coalesce("fixed", F.lit(False)) if "fixed" in calls.columns else F.lit(False)
    named = F.coalesce(F.concat(F.lit("="), F.col("caller").cast("string")), F.lit(""))
    rows = calls.select(named.alias("caller"), _micros(F.col("ts")).alias("t"), "seq", fixed.alias("fixed")).filter("t IS NOT NULL")
    rows = cut_lineage(rows.withColumn("tick", F.expr(f"t div {width} - if(t % {width} < 0, 1, 0)")))
    by = Window.partitionBy("caller").orderBy("tick")
    ticks = rows.groupBy("caller", "tick").agg(F.count("*").alias("n"))
    ticks = ticks.withColumn("busy", F.sum("n").over(by.rangeBetween(-2 * parts - 1, 0)) > limit)
    # a stretch begins after a span, with calls or without, of which the same is not true
    ticks = ticks.withColumn("begins", F.col("busy") & (F.coalesce(F.sum("n").over(by.rangeBetween(-2 * parts - 2, -1)), F.lit(0)) <= limit))
    ticks = ticks.withColumn("run", F.when(F.col("busy"), F.max(F.when(F.col("begins"), F.col("tick"))).over(by)))
    in_run = Window.partitionBy("caller", "run").orderBy("tick").rowsBetween(Window.unboundedPreceding, -1)
    ticks = ticks.withColumn("piece", F.when(F.col("busy"), F.coalesce(F.sum("n").over(in_run), F.lit(0)).cast("long") / piece_calls).cast("int"))
    # calls of the window before a busy stretch are all allowed: they are its history
    ticks = ticks.withColumn("history_of", F.min(F.when(F.col("begins"), F.col("tick"))).over(by.rangeBetween(1, parts)))
    placed = cut_lineage(rows.join(ticks.select("caller", "tick", "busy", "run", "piece", "history_of"), ["caller", "tick"]))
    free = placed.filter("NOT busy AND NOT fixed").select("caller", "t", "seq", F.lit(True).alias("allowed"))
    shape = "caller string, t long, tick long, seq long, allowed boolean"
    history = placed.filter("history_of IS NOT NULL").select("caller", F.col("history_of").alias("run"), "t", "tick", "seq", F.lit(True).alias("fixed"))
    busy = placed.filter("busy").select("caller", "run", "piece", "t", "tick", "seq", "fixed")
    last = busy.agg(F.max("piece")).first()[0]
    decided, judge = [free], _replay(limit, window)
    for piece in range(0 if last is None else last + 1):
        now = busy.filter(F.col("piece") == piece).drop("piece")
        held = history if piece == 0 else history.join(now.select("caller", "run").distinct(), ["caller", "run"], "left_semi")
        made = now.unionByName(held).groupBy("caller", "run").applyInPandas(lambda rows: judge(rows).assign(run=rows["run"].iloc[0]), shape + ", run long")
        made = cut_lineage(made)
        decided.append(made.select("caller", "t", "seq", "allowed"))
        ends = made.groupBy("caller", "run").agg(F.max("t").alias("end"))
        recent = made.filter("allowed").unionByName(held.select("caller", "run", "t", "tick", "seq", F.lit(True).alias("allowed")))
        history = recent.join(ends, ["caller", "run"]).filter(F.col("t") > F.col("end") - window).select("caller", "run", "t", "tick", "seq", F.lit(True).alias("fixed"))
    out = decided[0]
    for part in decided[1:]:
        out = out.unionByName(part)
    kind = dict(calls.dtypes)["caller"]
    return out.select(F.when(F.col("caller") != "", F.substring("caller", 2, 2147483647)).cast(kind).alias("caller"), F.timestamp_micros("t").alias("ts"), "seq", "allowed")
