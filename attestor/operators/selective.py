"""Calibration reports, risk and coverage, discrimination: on scored cells (score, n, p)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.scalar import safe_divide


def bin_index(score, bins: int = 10):
    """The bin of a score by comparing with k / bins; the last bin is closed."""
    out = F.lit(0)
    for k in range(1, bins):
        out = F.when(score >= F.lit(k / bins), F.lit(k)).otherwise(out)
    return out


def reliability_bins(scored: DataFrame, by: list[str], bins: int = 10) -> DataFrame:
    """Decisions, mean score, positive rate and gap of each bin; empty bins are rows of zeros."""
    with_bin = scored.withColumn("bin_index", bin_index(F.col("score"), bins))
    found = with_bin.groupBy(*by, "bin_index").agg(F.sum("n").cast("long").alias("decisions"), F.sum(F.col("score") * F.col("n")).alias("_s"), F.sum("p").alias("_p"))
    groups = scored.select(*by).distinct() if by else None
    frame = scored.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin_index"))
    if groups is not None:
        frame = groups.crossJoin(F.broadcast(frame))  # ten rows a group
    joined = frame.join(found, [*by, "bin_index"], "left")
    n = F.coalesce("decisions", F.lit(0)).cast("long")
    mean, rate = safe_divide(F.col("_s"), F.col("decisions")), safe_divide(F.col("_p"), F.col("decisions"))
    return joined.select(*by, "bin_index", (F.col("bin_index") / float(bins)).alias("lower"), ((F.col("bin_index") + 1) / float(bins)).alias("upper"), n.alias("decisions"), F.round(mean, 9).alias("mean_posterior"), F.round(rate, 9).alias("empirical_positive_rate"), F.round(F.abs(mean - rate), 9).alias("absolute_gap"))


def calibration_summary(scored: DataFrame, by: list[str], bins: int = 10) -> DataFrame:
    """Brier score and expected calibration error by group."""
    squared = F.col("p") * (1 - F.col("score")) ** 2 + (F.col("n") - F.col("p")) * F.col("score") ** 2
    per_bin = scored.withColumn("bin_index", bin_index(F.col("score"), bins)).groupBy(*by, "bin_index").agg(F.sum("n").alias("n"), F.sum("p").alias("p"), F.sum(F.col("score") * F.col("n")).alias("s"), F.sum(squared).alias("q"))
    return per_bin.groupBy(*by).agg(
        F.round(F.sum("q") / F.sum("n"), 9).alias("brier_score"),
        F.round(F.sum(F.abs(F.col("s") - F.col("p"))) / F.sum("n"), 9).alias("ece"),
        F.sum("n").cast("long").alias("class_decisions"),
        safe_divide(F.sum("p"), F.sum("n")).alias("prevalence"),
        F.count_if(F.col("n") > 0).alias("nonempty_bins"),
    )


def selective_curve(scored: DataFrame, confidences: list[float], by: list[str]) -> DataFrame:
    """Accepted decisions, their errors and alerts at each confidence: positive from q on, negative up to 1 - q."""
    each = scored.select("*", F.explode(F.array(*[F.lit(q) for q in confidences])).alias("confidence"))
    up, down = F.col("score") >= F.col("confidence"), F.col("score") <= F.lit(1.0) - F.col("confidence")
    down = down & ~up
    n, p = F.col("n"), F.col("p")

    def total(condition, value):
        return F.sum(F.when(condition, value).otherwise(0)).cast("long")

    g = each.groupBy(*by, "confidence").agg(F.sum(n).cast("long").alias("total"), total(up | down, n).alias("accepted"), total(up, n).alias("alerts"), total(up, p).alias("alert_tp"), total(down, n).alias("negatives"), total(down, p).alias("negative_fn"), F.sum(p).cast("long").alias("positives"), total(F.col("score") >= 0.5, n).alias("candidates"))
    return g.select(
        *by,
        "confidence",
        F.col("total").alias("class_decisions_total"),
        F.col("accepted").alias("accepted_decisions"),
        (F.col("total") - F.col("accepted")).alias("abstained_decisions"),
        safe_divide(F.col("accepted"), F.col("total")).alias("decision_coverage"),
        safe_divide(F.col("alerts") - F.col("alert_tp") + F.col("negative_fn"), F.col("accepted")).alias("accepted_decision_risk"),
        F.col("alerts").alias("accepted_positive_alerts"),
        safe_divide(F.col("alert_tp"), F.col("alerts")).alias("accepted_positive_precision"),
        safe_divide(F.col("alerts"), F.col("candidates")).alias("accepted_positive_alert_coverage"),
        safe_divide(F.col("alert_tp"), F.col("positives")).alias("ground_truth_positive_recall"),
        F.col("negatives").alias("accepted_negative_decisions"),
        safe_divide(F.col("negative_fn"), F.col("negatives")).alias("accepted_negative_error_risk"),
    )


def auc(scored: DataFrame, by: list[str]) -> DataFrame:
    """Midrank AUC by group, null where one class is missing.

    Equal scores are one row first; the running count of negatives below is a window over distinct scores, which for
    cell scores are few.
    """
    ties = scored.groupBy(*by, "score").agg(F.sum("n").alias("n"), F.sum("p").alias("p"))
    below = F.coalesce(F.sum(F.col("n") - F.col("p")).over(Window.partitionBy(*by).orderBy("score").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = ties.withColumn("twice", F.col("p") * (2 * below + F.col("n") - F.col("p")))
    g = ranked.groupBy(*by).agg(F.sum("twice").alias("twice"), F.sum("p").alias("pos"), F.sum(F.col("n") - F.col("p")).alias("neg"))
    area = F.when((F.col("pos") > 0) & (F.col("neg") > 0), F.col("twice") / (2.0 * F.col("pos") * F.col("neg")))
    return g.select(*by, F.round(area, 12).alias("auc"), F.col("pos").cast("long").alias("positives"), F.col("neg").cast("long").alias("negatives"))


def discrimination(scored: DataFrame, by: list[str]) -> DataFrame:
    """Mean AUC over the groups that have both classes, how many those are, and how many there are: one row."""
    areas = auc(scored, by)
    return areas.agg(F.avg("auc").alias("mean_auc"), F.count("auc").alias("finite_labels"), F.count("*").alias("labels"))
