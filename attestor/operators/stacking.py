"""Baselines beside calibration: prevalence scores and a penalised logistic stacker on vote patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import calibrate

PENALTIES = (0.01, 0.1, 1.0, 10.0)


def prevalence_scores(train_cells: DataFrame, by: list[str]) -> DataFrame:
    """(p + 1) / (n + 2) of each label."""
    g = train_cells.groupBy(*by, "label").agg(F.sum("n").alias("n"), F.sum("p").alias("p"))
    return g.select(*by, "label", ((F.col("p") + 1.0) / (F.col("n") + 2.0)).alias("score"))


def logistic_scores(train_cells: DataFrame, by: list[str], penalties=PENALTIES) -> DataFrame:
    """Scores of all eight patterns by group, label and C: intercept and three votes, L2 penalty 1/C on the votes.

    ``train_cells`` has train_n and train_p by group, label and pattern: at most eight rows a fit, one pandas group
    each. A label of one class only gets its prior.
    """
    schema = ", ".join(f"{c} {t}" for c, t in train_cells.select(*by).dtypes) + ", label string, c double, pattern string, score double"

    def fit(pdf):
        import numpy as np
        import pandas as pd

        key = tuple(pdf.iloc[0][c] for c in by)
        x = np.array([[1.0, *map(int, z)] for z in pdf.pattern])
        n, p = pdf.train_n.to_numpy(float), pdf.train_p.to_numpy(float)
        total, positive = n.sum(), p.sum()
        prior = (positive + 1) / (total + 2)
        every = [f"{k:03b}" for k in range(8)]
        grid = np.array([[1.0, *map(int, z)] for z in every])
        rows = []
        for c in penalties:
            beta = np.array([np.log(prior / (1 - prior)), 0.0, 0.0, 0.0])
            if 0 < positive < total:
                ridge = np.diag([0.0, 1 / c, 1 / c, 1 / c])
                for _ in range(100):
                    s = 1 / (1 + np.exp(-np.clip(x @ beta, -700, 700)))
                    gradient = x.T @ (n * s - p) + ridge @ beta
                    weight = n * np.maximum(s * (1 - s), 1e-9)
                    move = np.linalg.lstsq(x.T @ (x * weight[:, None]) + ridge, gradient, rcond=None)[0]
                    beta = beta - move
                    if np.abs(move).max() < 1e-9:
                        break
            s = 1 / (1 + np.exp(-np.clip(grid @ beta, -700, 700)))
            rows += [(*key, pdf.label.iloc[0], float(c), z, float(v)) for z, v in zip(every, s, strict=True)]
        return pd.DataFrame(rows)

    return train_cells.groupBy(*by, "label").applyInPandas(fit, schema)


def select_joint(grid: DataFrame, by: list[str], value) -> DataFrame:
    """(C, threshold) of the best value; of equal ones the higher threshold, then the smaller C."""
    best = grid.groupBy(*by).agg(F.max(F.struct(F.round(value, 12).alias("value"), F.col("threshold").alias("threshold"), (-F.col("c")).alias("minus_c"))).alias("b"))
    return best.select(*by, (-F.col("b.minus_c")).alias("c"), F.col("b.threshold").alias("threshold"), F.col("b.value").alias("objective"))


def prevalence_crossfit(inner_cells: DataFrame, outer_cells: DataFrame, value) -> DataFrame:
    """Each outer fold's cells with their prevalence score and prediction.

    Both tables are of ``calibrate.held_out_scores``. The threshold is the best one for the scores of the inner folds,
    each from the records of the other inner folds; the outer fold's score is from all of its training records.
    """
    grid = calibrate.threshold_grid(inner_cells.withColumn("score", F.col("prior")), ["outer_fold"])
    chosen = calibrate.select_threshold(grid, ["outer_fold"], value).withColumnRenamed("outer_fold", "fold")
    return _predicted(outer_cells.select("fold", "label", "pattern", "n", "p", F.col("prior").alias("score")).join(F.broadcast(chosen), "fold"))


def logistic_crossfit(inner_cells: DataFrame, outer_cells: DataFrame, value, penalties=PENALTIES) -> DataFrame:
    """Each outer fold's cells with the stacker's score and prediction, at the C and threshold chosen inside the fold.

    A stacker is fitted for each outer fold, inner fold, label and C on the records of the other inner folds and scores
    the inner fold; C and threshold are chosen jointly on these held-out scores. With them the stacker fitted on all
    training records scores the outer fold. Both tables are of ``calibrate.held_out_scores``.
    """
    inner = logistic_scores(inner_cells.select("outer_fold", "fold", "label", "pattern", "train_n", "train_p"), ["outer_fold", "fold"], penalties)
    held_out = inner.join(inner_cells.select("outer_fold", "fold", "label", "pattern", "n", "p"), ["outer_fold", "fold", "label", "pattern"])
    chosen = select_joint(calibrate.threshold_grid(held_out, ["outer_fold", "c"]), ["outer_fold"], value).withColumnRenamed("outer_fold", "fold")
    outer = logistic_scores(outer_cells.select("fold", "label", "pattern", "train_n", "train_p"), ["fold"], penalties)
    at = outer.join(F.broadcast(chosen), ["fold", "c"])  # one row a fold
    return _predicted(at.join(outer_cells.select("fold", "label", "pattern", "n", "p"), ["fold", "label", "pattern"]))


def _predicted(scored: DataFrame) -> DataFrame:
    return scored.where("n > 0").withColumn("predicted", (F.col("score") >= F.col("threshold")).cast("int"))
