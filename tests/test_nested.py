"""Cross-fitting with inner folds, against loops over single records."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from attestor.operators import calibrate, folds, stacking


def _nested(spark, n=400, folds_n=3, inner_n=3, seed=11):
    """Decisions with outer folds and inner folds, as a frame each and as Python rows."""
    rng = random.Random(4)
    rows = []
    for k in range(n):
        for label in ("x", "y"):
            truth = int(rng.random() < (0.3 if label == "x" else 0.2))
            votes = [truth ^ (rng.random() < e) for e in (0.2, 0.3, 0.45)]
            rows.append((k, label, "".join(str(int(v)) for v in votes), truth, k % folds_n))
    decisions = spark.createDataFrame(rows, "record_key long, label string, pattern string, truth int, fold int")
    records = decisions.groupBy("record_key", "fold").agg(F.max(F.concat("label", F.col("truth").cast("string"))).alias("stratum"))
    inner = folds.inner_stratified_folds(records, folds_n, inner_n, seed)
    return rows, decisions, records, inner


def test_inner_folds_are_stratified_and_of_training_records(spark):
    rows, _, records, inner = _nested(spark)
    found = inner.join(records, "record_key").collect()
    assert len(found) == 400 * 2 and all(r.outer_fold != r.fold for r in found)
    sizes = {}
    for r in found:
        sizes.setdefault((r.outer_fold, r.stratum), [0, 0, 0])[r.inner_fold] += 1
    assert all(max(v) - min(v) <= 1 for v in sizes.values())


def _newton(rows, c):
    """Penalised logistic regression on single records by plain gradient steps of Newton's method."""
    x = np.array([[1.0, *map(int, r[2])] for r in rows])
    y = np.array([r[3] for r in rows], float)
    prior = (y.sum() + 1) / (len(y) + 2)
    beta = np.array([np.log(prior / (1 - prior)), 0, 0, 0])
    if 0 < y.sum() < len(y):
        ridge = np.diag([0, 1 / c, 1 / c, 1 / c])
        for _ in range(60):
            s = 1 / (1 + np.exp(-x @ beta))
            beta = beta - np.linalg.solve((x * (s * (1 - s))[:, None]).T @ x + ridge, x.T @ (s - y) + ridge @ beta)
    return lambda pattern: 1 / (1 + np.exp(-np.array([1.0, *map(int, pattern)]) @ beta))


def _selected(scored):
    """(micro F1, threshold) of (score, truth) pairs; of equal ones the highest threshold."""
    s, t = np.array([x for x, _ in scored]), np.array([y for _, y in scored])
    out = []
    for k in range(1, 20):
        up = s >= k / 20
        tp, wrong = (up & (t == 1)).sum(), (up != (t == 1)).sum()
        out.append((round(2 * tp / (2 * tp + wrong), 12) if tp + wrong else 0.0, k / 20))
    return max(out)


def test_stacker_and_prevalence_select_on_inner_folds(spark):
    """Against loops over records, outer and inner folds, labels and C."""
    rows, decisions, _, inner = _nested(spark)
    held = {(r.record_key, r.outer_fold): r.inner_fold for r in inner.collect()}
    cells = calibrate.held_out_scores(calibrate.dense(calibrate.inner_frames(decisions, 3, 3, 11, inner), {"outer_fold": 3, "fold": 3}), [8.0], by=["outer_fold"])
    outer_cells = calibrate.held_out_scores(calibrate.dense(calibrate.cells(decisions, ["fold"]), {"fold": 3}), [8.0])
    stacked = stacking.logistic_crossfit(cells, outer_cells, calibrate.objective("micro_f1")).collect()
    prevalence = stacking.prevalence_crossfit(cells, outer_cells, calibrate.objective("micro_f1")).collect()
    assert sum(r.n for r in stacked) == sum(r.n for r in prevalence) == len(rows)
    for fold in range(3):
        training = [r for r in rows if r[4] != fold]

        def scored(fit):
            out = []
            for label in ("x", "y"):
                for k in range(3):
                    model = fit([r for r in training if r[1] == label and held[r[0], fold] != k])
                    out += [(model(r[2]), r[3]) for r in training if r[1] == label and held[r[0], fold] == k]
            return out

        def prior(part):
            return lambda _: (sum(r[3] for r in part) + 1) / (len(part) + 2)

        value, threshold, minus_c = max((*_selected(scored(lambda part: _newton(part, c))), -c) for c in stacking.PENALTIES)
        for found, fit, at in ((stacked, lambda part: _newton(part, -minus_c), (value, threshold)), (prevalence, prior, _selected(scored(prior)))):
            for label in ("x", "y"):
                model = fit([r for r in training if r[1] == label])
                for r in (r for r in found if r.fold == fold and r.label == label):
                    assert r.score == pytest.approx(model(r.pattern), abs=1e-7)
                    assert (r.objective, r.threshold) == (pytest.approx(at[0]), at[1]) and r.predicted == (r.score >= r.threshold)
        assert {r.c for r in stacked if r.fold == fold} == {-minus_c}


def test_families_stay_whole_in_inner_folds(spark):
    rng = random.Random(9)
    families = [(d, f"f{k}", rng.choice([1, 1, 2, 30])) for d in ("p", "q") for k in range(40)]
    summary = spark.createDataFrame([(d, f, str(rng.randrange(2)), n) for d, f, n in families], "dataset string, family string, stratum string, n long")
    dealt = folds.grouped_folds(summary, 5, 7)
    outer = {(r.dataset, r.family): r.fold for r in dealt.collect()}
    inner = folds.inner_grouped_folds(summary, dealt, 5, 3, 7)
    found = inner.collect()
    assert len({(r.dataset, r.family, r.outer_fold) for r in found}) == len(found) == 4 * len(families)
    assert all(outer[r.dataset, r.family] != r.outer_fold for r in found)
    for d in ("p", "q"):
        for k in range(5):
            assert {r.inner_fold for r in found if (r.dataset, r.outer_fold) == (d, k)} == {0, 1, 2}
    # Every copy is a record of its own; the cells of a family's label show the inner folds that it is in.
    records = [(i, d, f, f"{d}|{f}", "111", 1, outer[d, f]) for i, (d, f, n) in enumerate((d, f, n) for d, f, n in families for _ in range(n))]
    decisions = spark.createDataFrame(records, "record_key long, dataset string, family string, label string, pattern string, truth int, fold int")
    seen = calibrate.inner_frames(decisions, 5, 3, 7, inner).groupBy("outer_fold", "label").agg(F.count("*").alias("folds"), F.sum("n").alias("n")).collect()
    assert all(r.folds == 1 for r in seen) and sum(r.n for r in seen) == 4 * len(records)
