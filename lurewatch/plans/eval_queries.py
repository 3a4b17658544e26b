"""Evaluation queries over labelled predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from lurewatch.operators import evaluation as E
from lurewatch.plans.inputs import PREDICTIONS_SQL, predictions, with_
from lurewatch.plans.registry import query, table

CELLS = """count(*) FILTER (predicted AND is_scam) AS tp, count(*) FILTER (predicted AND NOT is_scam) AS fp, count(*) FILTER (NOT predicted AND NOT is_scam) AS tn,
  count(*) FILTER (NOT predicted AND is_scam) AS fn"""
RATES = """round(coalesce(tp / nullif(tp + fp, 0), 0), 6)::DOUBLE AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6)::DOUBLE AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6)::DOUBLE AS f1,
  round(coalesce(fp / nullif(fp + tn, 0), 0), 6)::DOUBLE AS false_positive_rate, round(coalesce(fn / nullif(fn + tp, 0), 0), 6)::DOUBLE AS false_negative_rate"""


@query("a7_j10_confusion_matrix", with_(PREDICTIONS_SQL, f"c AS (SELECT {CELLS}, count(*) FILTER (predicted IS NULL) AS no_prediction FROM predictions)") + f"SELECT *, {RATES} FROM c")
def confusion(spark, sf):
    return E.confusion(predictions(spark, sf), digits=6)


@query("a7_confusion_by_category", with_(PREDICTIONS_SQL, f"c AS (SELECT category, {CELLS}, count(*) FILTER (predicted IS NULL) AS no_prediction FROM predictions GROUP BY category)") + f"SELECT *, {RATES} FROM c")
def confusion_by_category(spark, sf):
    return E.confusion(predictions(spark, sf), by=["category"], digits=6)


BINS_SQL = """bins AS (SELECT least(floor(confidence * 10), 9)::BIGINT AS bin, count(*) AS n, avg(confidence) AS avg_confidence, avg(is_scam::INT) AS actual_rate, sum((confidence - is_scam::INT) ** 2) AS sq FROM predictions GROUP BY 1)"""


@query("a8_calibration_bins", with_(PREDICTIONS_SQL, BINS_SQL) + "SELECT bin, n, round(avg_confidence, 6) AS avg_confidence, round(actual_rate, 6) AS actual_rate FROM bins")
def bins(spark, sf):
    return E.calibration_bins(predictions(spark, sf)).select("bin", "n", F.round("avg_confidence", 6).alias("avg_confidence"), F.round("actual_rate", 6).alias("actual_rate"))


@query("a8_brier_and_ece", with_(PREDICTIONS_SQL, BINS_SQL) + "SELECT round(sum(sq) / sum(n), 6) AS brier, round(sum(n * abs(avg_confidence - actual_rate)) / sum(n), 6) AS ece FROM bins")
def brier(spark, sf):
    return E.calibration(predictions(spark, sf)).select(F.round("brier", 6).alias("brier"), F.round("ece", 6).alias("ece"))


@query("a9_latency_percentiles", with_(PREDICTIONS_SQL, "s AS (SELECT list(latency_ms ORDER BY latency_ms) AS l, avg(latency_ms) AS mean, count(*) AS n FROM predictions)") + """
SELECT l[(n // 2 + 1)::INT] AS p50, l[(floor(n * 0.95) + 1)::INT] AS p95, round(mean, 6) AS mean, n FROM s""")
def latency(spark, sf):
    return E.latency(predictions(spark, sf)).select("p50", "p95", F.round("mean", 6).alias("mean"), "n")


@query("a10_category_correct", with_(PREDICTIONS_SQL) + """
SELECT category, count(*) AS total, count(*) FILTER (predicted = is_scam) AS combined_correct, count(*) FILTER ((confidence > 0.65) = is_scam) AS strict_correct FROM predictions GROUP BY category""")
def category_correct(spark, sf):
    p = predictions(spark, sf).withColumn("strict", F.col("confidence") > 0.65)
    return E.category_report(p, {"combined": "predicted", "strict": "strict"})


@query("a11_type_exact_match", with_(PREDICTIONS_SQL) + """
SELECT count(*) FILTER (is_scam AND predicted_label = label) AS correct, count(*) FILTER (is_scam) AS total,
  round(count(*) FILTER (is_scam AND predicted_label = label) / count(*) FILTER (is_scam), 6)::DOUBLE AS exact_match FROM predictions""")
def type_match(spark, sf):
    return E.type_match(predictions(spark, sf)).withColumn("exact_match", F.round("exact_match", 6))


@query("a12_phrasing_recall", with_(PREDICTIONS_SQL) + """
SELECT category, count(*) FILTER (known_phrasing) AS n_known, count(*) FILTER (NOT known_phrasing) AS n_paraphrased,
  round(coalesce(count(*) FILTER (known_phrasing AND coalesce(predicted, false)) / nullif(count(*) FILTER (known_phrasing), 0), 0), 6)::DOUBLE AS known_recall,
  round(coalesce(count(*) FILTER (NOT known_phrasing AND coalesce(predicted, false)) / nullif(count(*) FILTER (NOT known_phrasing), 0), 0), 6)::DOUBLE AS paraphrase_recall FROM predictions GROUP BY category""")
def phrasing(spark, sf):
    r = E.phrasing_recall(predictions(spark, sf))
    return r.select("category", "n_known", "n_paraphrased", F.round("known_recall", 6).alias("known_recall"), F.round("paraphrase_recall", 6).alias("paraphrase_recall"))


@query("a12_pair_status", with_(PREDICTIONS_SQL, "h AS (SELECT example_id // 8 AS pair_id, sum(CASE WHEN predicted = is_scam THEN 1 ELSE 0 END) AS ok, count(*) AS n FROM predictions GROUP BY 1)") + """
SELECT pair_id, CASE WHEN ok = 2 THEN 'OK' WHEN ok = 1 THEN 'PARTIAL' ELSE 'FAIL' END AS status FROM h""")
def pair_status(spark, sf):
    return E.pair_status(predictions(spark, sf).withColumn("pair_id", F.floor(F.col("example_id") / 8)))


@query("a13_class_counts", with_(PREDICTIONS_SQL) + "SELECT label, count(*) AS n FROM predictions GROUP BY label")
def class_counts(spark, sf):
    return E.class_counts(predictions(spark, sf))


@query("a14_regression_floor", with_(PREDICTIONS_SQL) + "SELECT coalesce(max(confidence), 0) AS floor, count(*) AS n_flagged FROM predictions WHERE NOT is_scam AND predicted_label <> 'benign'")
def floor(spark, sf):
    return E.regression_floor(predictions(spark, sf))


_GRID = f"grid AS (SELECT unnest({E.SWEEP}::DOUBLE[]) AS threshold)"
_SWEPT = """swept AS (SELECT threshold, count(*) FILTER (p AND is_scam) AS tp, count(*) FILTER (p AND NOT is_scam) AS fp, count(*) FILTER (NOT p AND NOT is_scam) AS tn, count(*) FILTER (NOT p AND is_scam) AS fn
  FROM (SELECT threshold, is_scam, predicted_label <> 'benign' AND confidence > threshold AS p FROM predictions, grid) GROUP BY threshold)"""


def _top1(df):
    return E.sweep(df, F.col("confidence"), F.col("predicted_label") != "benign", digits=6)


@query("j9_threshold_sweep", with_(PREDICTIONS_SQL, _GRID, _SWEPT) + f"SELECT *, {RATES} FROM swept")
def threshold_sweep(spark, sf):
    return _top1(predictions(spark, sf))


@query("o5_select_threshold", with_(PREDICTIONS_SQL, _GRID, _SWEPT, f"r AS (SELECT *, {RATES} FROM swept)",
       "f AS (SELECT coalesce(max(confidence), 0) AS floor FROM predictions WHERE NOT is_scam AND predicted_label <> 'benign')") + """
SELECT coalesce(a, b, c)::DOUBLE AS threshold, CASE WHEN a IS NOT NULL THEN 'within_limit' WHEN b IS NOT NULL THEN 'above_floor' ELSE 'fallback' END AS rule FROM (SELECT
  arg_max(threshold, (f1, threshold)) FILTER (threshold > floor AND false_positive_rate <= 0.10) AS a, arg_max(threshold, (f1, threshold)) FILTER (threshold > floor) AS b,
  round(least(0.95, max(floor) + 0.05), 2) AS c FROM r, f)""")
def select_threshold(spark, sf):
    p = predictions(spark, sf)
    return E.select_threshold(_top1(p), E.regression_floor(p))


@query("p25_error_slices", with_(PREDICTIONS_SQL, "t AS (SELECT p.*, d.text, coalesce(predicted, false) AS pr, confidence > 0.8 AS rules FROM predictions p JOIN documents d ON d.doc_id = example_id)") + """
SELECT slice, example_id, category, left(text, 100) AS excerpt FROM (SELECT 'false_positive' AS slice, * FROM t WHERE pr AND NOT is_scam UNION ALL SELECT 'false_negative', * FROM t WHERE NOT pr AND is_scam
  UNION ALL SELECT 'rule_miss', * FROM t WHERE NOT rules AND is_scam AND NOT pr)""")
def error_slices(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("example_id"), "text")
    p = predictions(spark, sf).withColumn("rules_predicted", F.col("confidence") > 0.8)
    return E.error_slices(p).join(docs, "example_id").select("slice", "example_id", "category", F.left("text", F.lit(100)).alias("excerpt"))


@query("w4_fc9_margin_gate", "WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: abs(x)::DOUBLE) AS p FROM embeddings), s AS (SELECT vec_id, list_reverse_sort(p) AS s FROM e)" + """
SELECT vec_id, round(s[1] - s[2], 6) AS margin, s[1] - s[2] >= 0.15 AS trusted FROM s""")
def margin_gate(spark, sf):
    p = F.transform("embedding", lambda x: F.abs(x).cast("double"))
    m = table(spark, sf, "embeddings").select("vec_id", E.margin(p).alias("m"))
    return m.select("vec_id", F.round("m", 6).alias("margin"), (F.col("m") >= 0.15).alias("trusted"))


@query("o6_argmax_class", "SELECT vec_id, list_position(embedding, list_max(embedding))::INT AS best, round(list_max(embedding)::DOUBLE, 6) AS p FROM embeddings")
def argmax_class(spark, sf):
    best = F.array_max("embedding")
    return table(spark, sf, "embeddings").select("vec_id", F.array_position("embedding", best).cast("int").alias("best"), F.round(best.cast("double"), 6).alias("p"))
