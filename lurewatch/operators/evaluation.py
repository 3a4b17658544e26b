"""Detector quality: confusion, calibration, latency, sweeps and selection.

Inputs are long tables of labelled predictions; every result is an aggregate
that combines before the shuffle, so group sizes do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lurewatch.operators.ordering import cumulated

SWEEP = [round(0.10 + 0.05 * i, 2) for i in range(17)]


def confusion_cells(pred: Column, actual: Column) -> list[Column]:
    return [
        F.count_if(pred & actual).alias("tp"), F.count_if(pred & ~actual).alias("fp"),
        F.count_if(~pred & ~actual).alias("tn"), F.count_if(~pred & actual).alias("fn"),
        F.count_if(pred.isNull()).alias("no_prediction"),
    ]


def with_rates(df: DataFrame, digits: int | None = 3) -> DataFrame:
    """Precision, recall, F1, FPR and FNR from the cells; 0 where undefined."""
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))

    def ratio(a: Column, b: Column) -> Column:
        value = F.coalesce(F.try_divide(a, b), F.lit(0.0))
        return value if digits is None else F.round(value, digits)

    return df.select(
        "*", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        ratio(fp, fp + tn).alias("false_positive_rate"), ratio(fn, fn + tp).alias("false_negative_rate"),
    )


def confusion(df: DataFrame, by: list[str] | None = None, digits: int | None = 3) -> DataFrame:
    """Needs ``predicted`` (nullable) and ``is_scam``."""
    return with_rates(df.groupBy(*(by or [])).agg(*confusion_cells(F.col("predicted"), F.col("is_scam"))), digits)


def calibration_bins(df: DataFrame, n_bins: int = 10) -> DataFrame:
    """Per equal-width bin: rows, mean confidence and actual rate."""
    bin_no = F.least(F.floor(F.col("confidence") * n_bins), F.lit(n_bins - 1)).alias("bin")
    hit = F.col("is_scam").cast("int")
    return df.groupBy(bin_no).agg(
        F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("avg_confidence"), F.avg(hit).alias("actual_rate"),
        F.sum(F.pow(F.col("confidence") - hit, F.lit(2))).alias("sq_error"),
    )


def calibration(df: DataFrame, n_bins: int = 10) -> DataFrame:
    """Brier score and expected calibration error from the (few) bins."""
    b = calibration_bins(df, n_bins)
    return b.agg(
        (F.sum("sq_error") / F.sum("n")).alias("brier"),
        (F.sum(F.col("n") * F.abs(F.col("avg_confidence") - F.col("actual_rate"))) / F.sum("n")).alias("ece"),
    )


def latency(df: DataFrame, value: str = "latency_ms") -> DataFrame:
    """Mean and the values at sorted index n//2 and floor(0.95 n)."""
    counts = df.groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    # One row per distinct value; its last sorted index is the running count.
    upto = running_total(counts, value)
    stats = df.agg(F.count(F.lit(1)).alias("total"), F.avg(value).alias("mean"))
    at = lambda q: F.min(F.when(F.col("upto") > F.floor(F.col("total") * q), F.col(value)))
    joined = upto.join(F.broadcast(stats))  # one row
    return joined.agg(at(0.5).alias("p50"), at(0.95).alias("p95"), F.first("mean").alias("mean"), F.first("total").alias("n"))


def running_total(counts: DataFrame, value: str) -> DataFrame:
    """Adds ``upto``: rows up to and with each distinct value."""
    return cumulated(counts, [value], F.col("n"), "upto")


def category_report(df: DataFrame, candidates: dict[str, str]) -> DataFrame:
    """Correct and total per category, a pair of columns per candidate."""
    return df.groupBy("category").agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col(col) == F.col("is_scam")).alias(f"{name}_correct") for name, col in candidates.items()],
    )


def type_match(df: DataFrame) -> DataFrame:
    """Share of true scams whose predicted label is exactly right."""
    hit = F.col("is_scam") & (F.col("predicted_label") == F.col("label"))
    return df.agg(F.count_if(hit).alias("correct"), F.count_if("is_scam").alias("total")).withColumn(
        "exact_match", F.coalesce(F.try_divide(F.col("correct").cast("double"), F.col("total")), F.lit(0.0))
    )


def phrasing_recall(df: DataFrame) -> DataFrame:
    """Recall on known and on paraphrased wording per category."""
    hit = F.coalesce("predicted", F.lit(False))

    def share(kept: Column) -> Column:
        return F.coalesce(F.try_divide(F.count_if(kept & hit).cast("double"), F.count_if(kept)), F.lit(0.0))

    known = F.coalesce("known_phrasing", F.lit(False))
    return df.groupBy("category").agg(
        F.count_if(known).alias("n_known"), F.count_if(~known).alias("n_paraphrased"),
        share(known).alias("known_recall"), share(~known).alias("paraphrase_recall"),
    )


def pair_status(pairs: DataFrame) -> DataFrame:
    """OK, PARTIAL or FAIL from both halves of a paraphrase pair."""
    ok = F.count_if(F.col("predicted") == F.col("is_scam"))
    g = pairs.groupBy("pair_id").agg(ok.alias("n_ok"))
    return g.select("pair_id", F.when(F.col("n_ok") == 2, "OK").when(F.col("n_ok") == 1, "PARTIAL").otherwise("FAIL").alias("status"))


def regression_floor(df: DataFrame) -> Column | DataFrame:
    """Largest confidence with which a benign text is called something else."""
    bad = df.filter(~F.col("is_scam") & (F.col("predicted_label") != "benign"))
    return bad.agg(F.coalesce(F.max("confidence"), F.lit(0.0)).alias("floor"), F.count(F.lit(1)).alias("n_flagged"))


def sweep(df: DataFrame, framing: Column, gate: Column | None = None, thresholds: list[float] = SWEEP, digits: int | None = 3) -> DataFrame:
    """Confusion at every threshold.

    The grid is a short literal exploded per row *after* rows were reduced to
    counts per (cell above which threshold, truth), so no row is multiplied.
    """
    above = F.size(F.filter(F.lit(thresholds), lambda t: framing > t))
    level = above if gate is None else F.when(gate, above).otherwise(0)
    counts = df.groupBy(level.alias("level"), "is_scam").agg(F.count(F.lit(1)).alias("n"))
    grid = counts.select("*", F.posexplode(F.lit(thresholds)).alias("i", "threshold"))
    pred = F.col("level") > F.col("i")
    cell = lambda c, name: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).alias(name)
    out = grid.groupBy("threshold").agg(
        cell(pred & F.col("is_scam"), "tp"), cell(pred & ~F.col("is_scam"), "fp"), cell(~pred & ~F.col("is_scam"), "tn"), cell(~pred & F.col("is_scam"), "fn")
    )
    return with_rates(out, digits)


def select_threshold(swept: DataFrame, floor: DataFrame, max_fpr: float = 0.10) -> DataFrame:
    """Best F1 above the floor within the FPR limit; ties go to the higher threshold.

    Without a threshold in the limit the limit is dropped; without any above
    the floor the answer is just above the floor.
    """
    joined = swept.join(F.broadcast(floor.select("floor")))  # one row
    safe = F.col("threshold") > F.col("floor")
    good = safe & (F.col("false_positive_rate") <= max_fpr)
    rank = F.struct("f1", "threshold")
    picked = joined.agg(
        F.max_by("threshold", F.when(good, rank)).alias("a"), F.max_by("threshold", F.when(safe, rank)).alias("b"),
        F.round(F.least(F.lit(0.95), F.max("floor") + 0.05), 2).alias("c"),
    )
    return picked.select(F.coalesce("a", "b", "c").alias("threshold"), F.when(F.col("a").isNotNull(), "within_limit").when(F.col("b").isNotNull(), "above_floor").otherwise("fallback").alias("rule"))


#: Ways to read a classifier's scores as one number: name -> (score, whether rows called benign are out).
FRAMINGS = {"top1": ("confidence", True), "not_benign": ("not_benign", False), "margin": ("margin", True)}


def _called(gated: bool) -> Column:
    return F.col("predicted_label") != "benign" if gated else F.lit(True)


def sweep_framings(scored: DataFrame, framings: dict[str, tuple[str, bool]] | None = None, thresholds: list[float] = SWEEP, digits: int | None = 3) -> DataFrame:
    """Confusion at every threshold in every framing, from one pass over the rows.

    Each row falls into one step of the grid per framing; the counts per step, cumulated from above, are what lies over each
    threshold. ``scored``: is_scam, predicted_label and the framings' scores.
    """
    framings = framings or FRAMINGS
    step = lambda score, gated: F.when(_called(gated), F.size(F.filter(F.lit(thresholds), lambda t: F.col(score) > t))).otherwise(0)
    steps = F.array(*[F.struct(F.lit(n).alias("framing"), step(*how).alias("step")) for n, how in framings.items()])
    counts = scored.select("is_scam", F.explode(steps).alias("s")).groupBy("s.framing", "s.step").agg(F.count_if("is_scam").alias("scams"), F.count_if(~F.col("is_scam")).alias("fine"))
    grid = counts.select("*", F.posexplode(F.lit(thresholds)).alias("i", "threshold"))  # a step per threshold at most
    over = F.col("step") > F.col("i")
    cell = lambda c, n, name: F.coalesce(F.sum(F.when(c, F.col(n))), F.lit(0)).alias(name)
    out = grid.groupBy("framing", "threshold").agg(cell(over, "scams", "tp"), cell(over, "fine", "fp"), cell(~over, "fine", "tn"), cell(~over, "scams", "fn"))
    return with_rates(out, digits)


def framing_floors(bank: DataFrame, framings: dict[str, tuple[str, bool]] | None = None) -> DataFrame:
    """Per framing, the largest score at which a text of the permanent benign bank would be flagged; 0 if none would."""
    framings = framings or FRAMINGS
    highest = bank.agg(*[F.coalesce(F.max(F.when(_called(gated), F.col(score))), F.lit(0.0)).alias(n) for n, (score, gated) in framings.items()])
    return highest.select(F.explode(F.create_map(*[x for n in framings for x in (F.lit(n), F.col(n))])).alias("framing", "floor"))


def choose_thresholds(scored: DataFrame, bank: DataFrame, framings: dict[str, tuple[str, bool]] | None = None, max_fpr: float = 0.10) -> DataFrame:
    """The threshold of every framing, by the rule of ``select_threshold``, with the floor it had to clear and its F1."""
    swept = sweep_framings(scored, framings, digits=3).join(framing_floors(bank, framings), "framing")  # as many rows as framings and thresholds
    safe = F.col("threshold") > F.col("floor")
    rank = F.struct("f1", "threshold")
    chosen = swept.groupBy("framing").agg(
        F.max(F.when(safe & (F.col("false_positive_rate") <= max_fpr), rank)).alias("a"), F.max(F.when(safe, rank)).alias("b"), F.max("floor").alias("floor"))
    return chosen.select(
        "framing", F.coalesce("a.threshold", "b.threshold", F.round(F.least(F.lit(0.95), F.col("floor") + 0.05), 2)).alias("threshold"),
        F.when(F.col("a").isNotNull(), "within_limit").when(F.col("b").isNotNull(), "above_floor").otherwise("fallback").alias("rule"), "floor", F.coalesce("a.f1", "b.f1").alias("f1"))


def error_slices(df: DataFrame, rules: str = "rules_predicted") -> DataFrame:
    """False positives, false negatives and rule misses nobody recovered."""
    pred, actual = F.coalesce("predicted", F.lit(False)), F.col("is_scam")
    kinds = F.array_compact(F.array(
        F.when(pred & ~actual, "false_positive"), F.when(~pred & actual, "false_negative"),
        F.when(~F.col(rules) & actual & ~pred, "rule_miss"),
    ))
    out = df.withColumn("slice", F.explode_outer(kinds)).filter("slice IS NOT NULL")
    return out


def class_counts(df: DataFrame, label: str = "label") -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def margin(probabilities: Column) -> Column:
    """Best minus second-best class probability."""
    top = F.sort_array(probabilities, asc=False)
    return F.try_element_at(top, F.lit(1)) - F.coalesce(F.try_element_at(top, F.lit(2)), F.lit(0.0))


def nth_value(df: DataFrame, order: list, n: int) -> DataFrame:
    """The row at 1-based place ``n`` of a unique order."""
    return cumulated(df, order, F.lit(1).cast("long"), "position").filter(F.col("position") == n)
