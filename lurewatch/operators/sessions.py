"""Conversation analytics: roll-ups, running state, reply memory, context.

Input rows are turns: ``session_id, turn, sender, text, ts`` with ``turn``
unique inside a session.  A session may be huge, so nothing collects one: sets
stay in long form, order-dependent values come from ``ordering``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lurewatch import lexicon as L
from lurewatch.functions import replies as R
from lurewatch.functions import similarity as S
from lurewatch.functions.text import wrap_untrusted
from lurewatch.operators.ordering import lagged, ranked, running
from lurewatch.operators.reports import entity_list
from lurewatch.operators.detection import with_intel

SCORED_KINDS = {"upi_id": 30, "phone": 20, "bank_account": 25, "url": 15}


def turn_entities(turns: DataFrame) -> DataFrame:
    """Entities read from every turn, long form."""
    out = with_intel(turns).select("session_id", "turn", F.inline_outer(entity_list(F.col("intel"))))
    return out.filter("kind IS NOT NULL").select("session_id", "turn", "kind", "value")


def session_values(entities: DataFrame) -> DataFrame:
    """Distinct values per session with the turn that first revealed them."""
    return entities.groupBy("session_id", "kind", "value").agg(F.min("turn").alias("first_turn"))


def intel_scores(values: DataFrame) -> DataFrame:
    """Count-based score per session."""
    counts = values.groupBy("session_id").agg(*[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in [*SCORED_KINDS, "keyword"]])
    return counts.withColumn("intel_score", sum((F.col(f"n_{k}") * w for k, w in SCORED_KINDS.items()), F.lit(0)))


def complete(turns: Column, score: Column, disengaged: Column) -> Column:
    """Is the conversation over?"""
    return (
        F.when(turns < 8, disengaged).when(turns >= 25, True).when((score < 50) & (turns < 15), False)
        .when(score >= 80, True).when((score >= 50) & (turns >= 12), True).otherwise(disengaged)
    )


def rollup(turns: DataFrame, values: DataFrame | None = None) -> DataFrame:
    """One row per session: counters, duration, last message, score, and when it was first complete."""
    values = session_values(turn_entities(turns)) if values is None else values
    at = F.struct("ts", "turn")
    base = turns.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("message_count"), F.min("ts").alias("started_at"), F.max("ts").alias("last_at"),
        F.max_by(F.struct("sender", "text"), at).alias("last"),
    )
    joined = base.join(intel_scores(values), "session_id", "left").fillna(0).join(completion_points(turns, values), "session_id", "left")
    n = F.floor(F.col("message_count") / 2)
    gone = R.is_disengaged(F.col("last")["sender"], F.col("last")["text"])
    return joined.select(
        "session_id", "message_count", n.alias("turns"),
        (F.unix_seconds("last_at") - F.unix_seconds("started_at")).alias("engagement_seconds"),
        F.col("last")["sender"].alias("last_sender"), F.col("last")["text"].alias("last_text"), gone.alias("disengaged"),
        *[f"n_{k}" for k in [*SCORED_KINDS, "keyword"]], "intel_score", F.col("completed_at").isNotNull().alias("is_complete"),
        "completed_turn", "completed_at", "completed_score", "started_at",
    )


def conversation_state(turns: Column) -> Column:
    out = F.lit(L.FINAL_CONVERSATION_STATE)
    for limit, name in reversed(L.CONVERSATION_STATES):
        out = F.when(turns <= limit, name).otherwise(out)
    return out


def with_states(turns: DataFrame) -> DataFrame:
    """Turn number and conversation state after every message."""
    pos = ranked(turns, ["session_id"], ["turn"], "position")
    n = F.floor(F.col("position") / 2)
    return pos.withColumn("turn_no", n).withColumn("state", conversation_state(n))


def progressive_intel(turns: DataFrame, values: DataFrame | None = None) -> DataFrame:
    """Running number of distinct values per kind, and the turns since the last new one."""
    values = session_values(turn_entities(turns)) if values is None else values
    fresh = values.groupBy("session_id", F.col("first_turn").alias("turn")).agg(
        *[F.count_if(F.col("kind") == k).alias(f"new_{k}") for k in SCORED_KINDS], F.count(F.lit(1)).alias("new_any")
    )
    joined = turns.select("session_id", "turn").join(fresh, ["session_id", "turn"], "left").fillna(0)
    run = running(
        joined, ["session_id"], ["turn"], position=("count", F.lit(1)),
        **{f"n_{k}": ("sum", F.col(f"new_{k}")) for k in SCORED_KINDS},
    )
    hit = F.when(F.col("new_any") > 0, F.col("position"))
    run = running(run, ["session_id"], ["turn"], __last=("max", hit))
    gap = F.col("position") - F.coalesce("__last", F.lit(0))
    score = sum((F.col(f"n_{k}") * w for k, w in SCORED_KINDS.items()), F.lit(0))
    return run.select("session_id", "turn", "position", *[f"n_{k}" for k in SCORED_KINDS], score.alias("intel_score"), gap.alias("gap"))


def tactic(turn_no: Column, gap: Column) -> Column:
    rotate = F.try_element_at(F.lit(L.STALLING_TACTICS), (turn_no % len(L.STALLING_TACTICS) + 1).cast("int"))
    return F.when(gap > 3, "TECHNICAL_DIFFICULTY").otherwise(rotate)


def repeated_replies(turns: DataFrame, threshold: float = 0.75, memory: int = 5) -> DataFrame:
    """Is an agent reply too close to one of the five before it?"""
    replies = turns.filter(F.col("sender") == "agent").select("session_id", "turn", S.clean(F.col("text")).alias("reply"))
    pos = ranked(replies, ["session_id"], ["turn"], "position")
    near = lagged(pos, ["session_id"], "position", {"recent": "reply"}, memory)
    near = near.withColumn("candidates", S.reachable(F.col("reply"), F.col("recent"), threshold))
    ratio = S.max_ratio(F.when(F.size("candidates") > 0, F.col("reply")), F.col("candidates"))
    return near.select(
        "session_id", "turn", F.size("recent").alias("n_recent"), F.coalesce(ratio >= threshold, F.lit(False)).alias("too_similar")
    )


def least_similar(turns: DataFrame, candidates: list[str], memory: int = 5) -> DataFrame:
    """Per session the candidate furthest from the last five replies."""
    replies = turns.filter(F.col("sender") == "agent").select("session_id", "turn", S.clean(F.col("text")).alias("reply"))
    last = ranked(replies, ["session_id"], ["turn"], "back", descending=True).filter(F.col("back") <= memory)
    memory_rows = last.groupBy("session_id").agg(F.collect_list("reply").alias("recent"))  # at most ``memory`` values
    options = memory_rows.select("session_id", "recent", F.posexplode(F.lit(candidates)).alias("pos", "candidate"))
    scored = options.withColumn("similarity", S.max_ratio(S.clean(F.col("candidate")), F.col("recent")))
    return scored.groupBy("session_id").agg(
        F.min_by("candidate", F.struct("similarity", "pos")).alias("candidate"), F.min("similarity").alias("similarity")
    )


def context(turns: DataFrame, chunk: int = 500) -> DataFrame:
    """One text per session: ``sender: text`` lines in order, neutralised.

    Lines are joined in pieces of ``chunk`` first, so only the finished text of a session meets in one place.
    """
    pos = ranked(turns, ["session_id"], ["turn"], "position")
    line = F.concat(F.col("sender"), F.lit(": "), wrap_untrusted(F.col("text")))
    cut = pos.select("session_id", F.floor((F.col("position") - 1) / chunk).alias("piece"), F.struct("position", line.alias("line")).alias("l"))
    joined = lambda df, name: F.array_join(F.sort_array(F.collect_list(df))[name], "\n")
    pieces = cut.groupBy("session_id", "piece").agg(joined(F.col("l"), "line").alias("text"))
    return pieces.groupBy("session_id").agg(joined(F.struct("piece", "text"), "text").alias("context"))


def completion_points(turns: DataFrame, values: DataFrame | None = None) -> DataFrame:
    """Sessions whose completion rule fires, asked after every message: when it first did.

    ``completed_turn``, ``completed_at`` (messages so far) and ``completed_score``.
    """
    quits = turns.select("session_id", "turn", R.is_disengaged(F.col("sender"), F.col("text")).alias("quits"))
    asked = progressive_intel(turns, values).join(quits, ["session_id", "turn"])
    fired = asked.filter(complete(F.floor(F.col("position") / 2), F.col("intel_score"), F.col("quits")))
    first = fired.groupBy("session_id").agg(F.min(F.struct("turn", "position", "intel_score")).alias("f"))
    return first.select("session_id", F.col("f.turn").alias("completed_turn"), F.col("f.position").alias("completed_at"), F.col("f.intel_score").alias("completed_score"))
