"""Confusion counts and the metrics that follow from them, as grouped aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import safe_divide


def confusion(decisions: DataFrame, by: list[str], truth: str = "truth", pred: str = "pred") -> DataFrame:
    """tp, fp, fn, tn, support and n for each group of decision rows."""
    t, p = F.col(truth) == 1, F.col(pred) == 1
    return decisions.groupBy(*by).agg(
        F.count_if(t & p).alias("tp"),
        F.count_if(~t & p).alias("fp"),
        F.count_if(t & ~p).alias("fn"),
        F.count_if(~t & ~p).alias("tn"),
        F.count_if(t).alias("support"),
        F.count("*").alias("n"),
    )


def _c(name: str) -> Column:
    return F.col(name)


def precision() -> Column:
    return safe_divide(_c("tp"), _c("tp") + _c("fp"))


def recall() -> Column:
    return safe_divide(_c("tp"), _c("tp") + _c("fn"))


def f1() -> Column:
    return safe_divide(2 * _c("tp"), 2 * _c("tp") + _c("fp") + _c("fn"))


def specificity() -> Column:
    return safe_divide(_c("tn"), _c("tn") + _c("fp"))


def false_positive_rate() -> Column:
    return safe_divide(_c("fp"), _c("fp") + _c("tn"))


def accuracy() -> Column:
    return safe_divide(_c("tp") + _c("tn"), _c("tp") + _c("tn") + _c("fp") + _c("fn"))


def balanced_accuracy() -> Column:
    return (recall() + specificity()) / 2.0


def mcc() -> Column:
    """Matthews correlation; the margins are multiplied as doubles, 0 where one of them is empty."""
    tp, fp, fn, tn = (_c(x).cast("double") for x in ("tp", "fp", "fn", "tn"))
    return safe_divide(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)))


ALL = {"precision": precision, "recall": recall, "f1": f1, "specificity": specificity, "false_positive_rate": false_positive_rate, "accuracy": accuracy, "balanced_accuracy": balanced_accuracy, "mcc": mcc}


def with_metrics(counts: DataFrame, *names: str) -> DataFrame:
    return counts.select("*", *[ALL[n]().alias(n) for n in names])


def macro(per_class: DataFrame, by: list[str], metric: str = "f1", supported_only: bool = False) -> DataFrame:
    """The mean over declared classes, or over those with support; 0 if there are none."""
    value = F.when(F.col("support") > 0, F.col(metric)) if supported_only else F.col(metric)
    # Doubles add up in the order of the values, so that the sum does not depend on the partitioning.
    return per_class.groupBy(*by).agg(F.coalesce(F.round(F.avg(value), 12), F.lit(0.0)).alias(f"macro_{metric}"), F.count_if(F.col("support") > 0).alias("supported_classes"))


def record_counts(decisions: DataFrame, by: list[str], pred: str = "pred") -> DataFrame:
    """tp, fp, fn of each record."""
    return confusion(decisions, [*by, "record_key"], pred=pred)


def sample_scores(records: DataFrame, by: list[str], both_empty: float = 1.0, weight: str | None = None) -> DataFrame:
    """Mean F1 by record and exact-match ratio; ``both_empty`` is the F1 of two empty sets. A row counts once, or as many
    times as its column ``weight`` says."""
    empty = (F.col("tp") + F.col("fp") + F.col("fn")) == 0
    score = F.when(empty, F.lit(both_empty)).otherwise(f1())
    n = F.col(weight) if weight else F.lit(1).cast("long")
    # Equal scores are counted first: few sums of doubles, whatever the number of records.
    per_score = records.select(*by, score.alias("score"), n.alias("n"), F.when((F.col("fp") + F.col("fn")) == 0, n).otherwise(0).alias("exact")).groupBy(*by, "score").agg(F.sum("n").alias("n"), F.sum("exact").alias("exact"))
    total = F.sum("n")
    return per_score.groupBy(*by).agg(F.round(F.sum(F.col("score") * F.col("n")) / total, 9).alias("sample_f1"), safe_divide(F.sum("exact"), total).alias("exact_match_ratio"), total.alias("records"))


def long_systems(decisions: DataFrame, systems: dict[str, Column]) -> DataFrame:
    """One row a decision and system, with the system's prediction as ``pred``."""
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("system"), c.cast("int").alias("pred")) for name, c in systems.items()]))
    keep = [c for c in ("dataset", "record_key", "records", "label", "truth") if c in decisions.columns]
    return decisions.select(*keep, each.alias("s")).select(*keep, "s.system", "s.pred")


def vote_systems(votes: list[str]) -> dict[str, Column]:
    """Each model, and the votes of at least one, a majority and all of them."""
    total = sum((F.col(v) for v in votes[1:]), F.col(votes[0]))
    n = len(votes)
    return {**{f"model_{k + 1}": F.col(v) for k, v in enumerate(votes)}, "or": total >= 1, "majority": total * 2 > n, "and": total == n}


def system_counts(decisions: DataFrame, votes: list[str]) -> DataFrame:
    """Confusion counts by dataset, system and label.

    The decisions collapse to their distinct (truth, votes) cells first, so that the systems multiply cells, not rows.
    """
    cells = decisions.groupBy("dataset", "label", "truth", *votes).agg(F.count("*").alias("m"))
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("system"), c.cast("int").alias("pred")) for name, c in vote_systems(votes).items()]))
    long = cells.select("dataset", "label", "truth", "m", each.alias("s")).select("dataset", "label", "truth", "m", "s.system", "s.pred")
    t, p = F.col("truth") == 1, F.col("pred") == 1

    def total(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("m")).otherwise(0)).cast("long")

    return long.groupBy("dataset", "system", "label").agg(total(t & p).alias("tp"), total(~t & p).alias("fp"), total(t & ~p).alias("fn"), total(~t & ~p).alias("tn"), total(t).alias("support"), F.sum("m").cast("long").alias("n"))


def pooled(counts: DataFrame, by: list[str]) -> DataFrame:
    return counts.groupBy(*by).agg(*[F.sum(c).cast("long").alias(c) for c in ("tp", "fp", "fn", "tn", "support", "n")])


def system_summary(counts: DataFrame, by: list[str]) -> DataFrame:
    """Micro metrics with the macro F1 of supported classes, from counts by class."""
    micro = with_metrics(pooled(counts, by), "precision", "recall", "f1", "specificity", "false_positive_rate", "accuracy", "balanced_accuracy", "mcc")
    return micro.join(macro(with_metrics(counts, "f1"), by, "f1", True), by)


def support_report(counts: DataFrame) -> DataFrame:
    """Per-class F1 that is null without support, and the false positives of such classes."""
    out = with_metrics(counts, "precision", "recall", "f1")
    defined = F.col("support") > 0
    return out.select(*counts.columns, defined.alias("metric_defined"), *[F.when(defined, F.col(m)).alias(f"{m}_report") for m in ("precision", "recall", "f1")], F.when(defined, 0).otherwise(F.col("fp")).cast("long").alias("zero_support_false_positives"))
