"""Agreement-pattern calibration, cross-fitting and threshold selection, on compressed cells.

A decision enters these only by its label, vote pattern, truth and folds, so everything runs on counts by cell; the
records are read once for the counts and once more only where rows for each record are asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import safe_divide
from .metrics import f1

THRESHOLDS = [k / 20 for k in range(1, 20)]


def cells(decisions: DataFrame, by: list[str], weight: str | None = None) -> DataFrame:
    """n decisions and p positives by group, label and pattern; a row counts once, or as often as ``weight`` says."""
    n = F.col(weight) if weight else F.lit(1)
    return decisions.groupBy(*by, "label", "pattern").agg(F.sum(n).cast("long").alias("n"), F.sum(F.col("truth") * n).cast("long").alias("p"))


def calibration_table(cell_counts: DataFrame, by: list[str]) -> DataFrame:
    """Prior (p + 1) / (n + 2) of each label beside the counts of its patterns."""
    prior = cell_counts.groupBy(*by, "label").agg(F.sum("n").alias("label_n"), F.sum("p").alias("label_p"))
    prior = prior.select(*by, "label", ((F.col("label_p") + 1.0) / (F.col("label_n") + 2.0)).alias("prior"))
    return cell_counts.join(prior, [*by, "label"])


def calibrated(n: Column, p: Column, prior: Column, shrinkage: Column) -> Column:
    """(p + lambda prior) / (n + lambda); the prior where a pattern was not seen."""
    n, p = F.coalesce(n, F.lit(0)), F.coalesce(p, F.lit(0))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (p + shrinkage * prior) / (n + shrinkage)))


def held_out_scores(cell_counts: DataFrame, shrinkage: list[float], fold: str = "fold", by: list[str] | None = None) -> DataFrame:
    """Scores of each fold's cells from the counts of all other folds, one row for each shrinkage.

    ``cell_counts`` has n and p by ``by``, fold, label and pattern. Training counts are totals less the fold's own.
    """
    by = by or []

    def total(value: str, *columns: str) -> Column:  # windows over cells: folds times patterns, never records
        return F.sum(value).over(Window.partitionBy(*by, *columns))

    others_p, others_n = (total(v, "label") - total(v, fold, "label") for v in ("p", "n"))
    joined = cell_counts.select("*", (total("n", "label", "pattern") - F.col("n")).alias("train_n"), (total("p", "label", "pattern") - F.col("p")).alias("train_p"), ((others_p + 1.0) / (others_n + 2.0)).alias("prior"))
    lam = F.explode(F.array(*[F.lit(float(x)) for x in shrinkage]))
    out = joined.select(*by, fold, "label", "pattern", "n", "p", "train_n", "train_p", "prior", lam.alias("shrinkage"))
    return out.withColumn("score", calibrated(F.col("train_n"), F.col("train_p"), F.col("prior"), F.col("shrinkage")))


def threshold_grid(scored: DataFrame, by: list[str], thresholds: list[float] = THRESHOLDS) -> DataFrame:
    """tp, fp, fn, tn of scored cells at each threshold."""
    each = scored.select("*", F.explode(F.array(*[F.lit(t) for t in thresholds])).alias("threshold"))
    positive = F.col("score") >= F.col("threshold")

    def total(condition: Column, value: Column) -> Column:
        return F.sum(F.when(condition, value).otherwise(0)).cast("long")

    negatives = F.col("n") - F.col("p")
    return each.groupBy(*by, "threshold").agg(total(positive, F.col("p")).alias("tp"), total(positive, negatives).alias("fp"), total(~positive, F.col("p")).alias("fn"), total(~positive, negatives).alias("tn"))


def primary_metric(task: str) -> str:
    """The metric that a task is judged by: balanced accuracy where it is binary, else micro F1."""
    return "balanced_accuracy" if task == "binary" else "micro_f1"


def objective(name: str) -> Column:
    """The value a threshold is chosen by, on columns tp, fp, fn, tn of all labels together."""
    if name == "micro_f1":
        return f1()
    if name == "balanced_accuracy":
        recall, specificity = safe_divide(F.col("tp"), F.col("tp") + F.col("fn")), safe_divide(F.col("tn"), F.col("tn") + F.col("fp"))
        return (recall + specificity) / 2.0
    raise ValueError(f"no such objective: {name}")


def objective_grid(scored: DataFrame, by: list[str], name: str, thresholds: list[float] = THRESHOLDS) -> DataFrame:
    """The objective of scored cells at each threshold, as column ``value``. ``macro_f1_supported`` is the mean F1 of the
    labels that have positives; the other objectives are of all labels together."""
    if name != "macro_f1_supported":
        return threshold_grid(scored, by, thresholds).withColumn("value", objective(name))
    per_label = threshold_grid(scored, [*by, "label"], thresholds)
    supported = F.when(F.col("tp") + F.col("fn") > 0, f1())
    return per_label.groupBy(*by, "threshold").agg(F.coalesce(F.round(F.avg(supported), 12), F.lit(0.0)).alias("value"))


def select_threshold(grid: DataFrame, by: list[str], value: Column) -> DataFrame:
    """The threshold of the best value (to 12 digits); of equal ones the highest."""
    ranked = F.struct(F.round(value, 12).alias("value"), F.col("threshold").alias("threshold"))
    best = grid.groupBy(*by).agg(F.max(ranked).alias("best"))
    return best.select(*by, F.col("best.threshold").alias("threshold"), F.col("best.value").alias("objective"))


def inner_frames(decisions: DataFrame, folds: int, inner_folds: int, seed: int, inner: DataFrame | None = None) -> DataFrame:
    """Counts by outer fold, inner fold, label and pattern: each record once for each outer fold it trains in.

    The inner fold of a record depends on the outer fold: it is the one of ``inner`` (outer_fold and inner_fold beside
    the columns to join by, such as the record's key or its family), or else by a hash of seed, outer fold and key.
    Counting comes right after the expansion, with map-side combine; by hash, the expanded rows are never shuffled.
    """
    if inner is not None:
        dealt = decisions.join(inner, [c for c in inner.columns if c not in ("outer_fold", "inner_fold")])
        return cells(dealt.select("outer_fold", F.col("inner_fold").alias("fold"), "label", "pattern", "truth"), ["outer_fold", "fold"])
    outer = F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("outer_fold")
    expanded = decisions.select("record_key", "label", "pattern", "truth", "fold", outer).where("outer_fold <> fold")
    inner = F.pmod(F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col("outer_fold").cast("string"), F.col("record_key").cast("string")), 256), 1, 8), 16, 10).cast("long"), F.lit(inner_folds)).cast("int")
    return cells(expanded.withColumn("fold", inner), ["outer_fold", "fold"])


def dense(cell_counts: DataFrame, sizes: dict[str, int]) -> DataFrame:
    """``cell_counts`` with a row for every value (0 up to its size) of the fold columns in ``sizes``, zeros where a
    label-pattern pair has no count. A pair's few cells are gathered once and looked up; nothing is joined.
    """
    by = list(sizes)
    frame = cell_counts.groupBy("label", "pattern").agg(F.collect_list(F.struct(*by, "n", "p")).alias("found"))
    for c, size in sizes.items():
        frame = frame.select("*", F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias(c))

    def here(cell: Column) -> Column:
        out = F.lit(True)
        for c in by:
            out = out & (cell[c] == F.col(c))
        return out

    hit = F.try_element_at(F.filter("found", here), F.lit(1))
    return frame.select(*by, "label", "pattern", F.coalesce(hit["n"], F.lit(0)).alias("n"), F.coalesce(hit["p"], F.lit(0)).alias("p"))


def predicted_cells(decisions: DataFrame, folds: int = 5, inner_folds: int = 3, shrinkage: float | list[float] = 8.0, seed: int = 20260811, objective_name: str = "micro_f1", inner: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(threshold by outer fold, cells of the outer folds with score, threshold and prediction), nested and without a
    loop over folds.

    ``decisions`` has record_key, label, pattern, truth and fold; ``inner`` is that of ``inner_frames``. With a list of
    shrinkage values the whole protocol runs for each of them, and both tables have a column ``shrinkage``.
    """
    each = ["shrinkage"] if isinstance(shrinkage, list) else []
    values = shrinkage if each else [shrinkage]
    inner = dense(inner_frames(decisions, folds, inner_folds, seed, inner), {"outer_fold": folds, "fold": inner_folds})
    by = [*each, "outer_fold"]
    grid = objective_grid(held_out_scores(inner, values, by=["outer_fold"]), by, objective_name)
    chosen = select_threshold(grid, by, F.col("value"))
    outer = held_out_scores(dense(cells(decisions, ["fold"]), {"fold": folds}), values)
    at = outer.join(F.broadcast(chosen.select(*each, F.col("outer_fold").alias("fold"), "threshold")), [*each, "fold"])  # a row a fold and value
    return chosen, at.withColumn("predicted", (F.col("score") >= F.col("threshold")).cast("int"))


def crossfit(decisions: DataFrame, folds: int = 5, inner_folds: int = 3, shrinkage: float | list[float] = 8.0, seed: int = 20260811, objective_name: str = "micro_f1", inner: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(threshold by outer fold, counts by outer fold at its threshold); the parameters are those of ``predicted_cells``."""
    each = ["shrinkage"] if isinstance(shrinkage, list) else []
    chosen, at = predicted_cells(decisions, folds, inner_folds, shrinkage, seed, objective_name, inner)
    positive = F.col("predicted") == 1
    counts = at.groupBy(*each, "fold", "threshold").agg(
        F.sum(F.when(positive, F.col("p")).otherwise(0)).cast("long").alias("tp"),
        F.sum(F.when(positive, F.col("n") - F.col("p")).otherwise(0)).cast("long").alias("fp"),
        F.sum(F.when(~positive, F.col("p")).otherwise(0)).cast("long").alias("fn"),
        F.sum(F.when(~positive, F.col("n") - F.col("p")).otherwise(0)).cast("long").alias("tn"),
    )
    return chosen, counts


def crossfit_predictions(decisions: DataFrame, name: str = "candidate", **parameters) -> DataFrame:
    """``decisions`` with the cross-fitted prediction as a column. The cells are folds times labels times patterns, so
    they are broadcast; records are neither shuffled nor scored one by one."""
    _, at = predicted_cells(decisions, **parameters)
    return decisions.join(F.broadcast(at.select("fold", "label", "pattern", F.col("predicted").alias(name))), ["fold", "label", "pattern"])


def merge_scores(*tables: DataFrame, keys: tuple[str, ...] = ("record_key", "label")) -> DataFrame:
    """The union of the scores of several folds; a cell that two of them score is an error."""
    from .validate import duplicate_keys, require_empty

    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    require_empty(duplicate_keys(out, list(keys)), "cells scored twice")
    return out
