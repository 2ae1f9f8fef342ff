"""Paired tests and cross-fitted predictions against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from attestor.operators import calibrate, resample, validate
from attestor.plans import catalogue

SF = "/root/testdata/sf0.001"


def value(metric, tp, fp, fn, tn):
    if metric == "micro_f1":
        return 2 * tp / (2 * tp + fp + fn) if 2 * tp + fp + fn else 0.0
    if metric == "balanced_accuracy":
        return ((tp / (tp + fn) if tp + fn else 0) + (tn / (tn + fp) if tn + fp else 0)) / 2
    below = ((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) ** 0.5
    return (tp * tn - fp * fn) / below if below else 0.0


@pytest.mark.parametrize("metric", sorted(resample.COUNTS))
def test_tests_against_record_loops(spark, metric):
    rng = random.Random(3)
    rows = [(k, label, t, t ^ (rng.random() < 0.2), t ^ (rng.random() < 0.35)) for k in range(80) for label in "xy" for t in [int(rng.random() < 0.4)]]
    df = spark.createDataFrame([(k, x, t, int(a), int(b)) for k, x, t, a, b in rows], "record_key long, label string, truth int, one int, two int")
    got = resample.against_baselines(df, "one", ["two"], metric, 2000).first()

    def counts(pick, which):
        out = [0, 0, 0, 0]
        for k in pick:
            for r in rows[2 * k : 2 * k + 2]:
                out[(0 if r[which] else 2) if r[2] else (1 if r[which] else 3)] += 1
        return out

    observed = value(metric, *counts(range(80), 3)) - value(metric, *counts(range(80), 4))
    assert got.observed_difference == pytest.approx(observed, abs=1e-12) and got.records == 80
    draws = [value(metric, *counts(pick, 3)) - value(metric, *counts(pick, 4)) for pick in ([rng.randrange(80) for _ in range(80)] for _ in range(2000))]
    low, high = np.quantile(draws, [0.025, 0.975])
    assert got.ci_low == pytest.approx(low, abs=0.03) and got.ci_high == pytest.approx(high, abs=0.03)
    assert got.probability_a_greater == pytest.approx(np.mean(np.array(draws) > 0), abs=0.05)
    extreme = 0
    for _ in range(2000):
        swap = [rng.random() < 0.5 for _ in range(80)]
        a, b = ([sum(x) for x in zip(counts([k for k in range(80) if swap[k]], 7 - c), counts([k for k in range(80) if not swap[k]], c), strict=True)] for c in (3, 4))
        extreme += abs(value(metric, *a) - value(metric, *b)) >= abs(observed) - 1e-15
    assert got.permutation_p == pytest.approx((extreme + 1) / 2001, abs=0.05)


def test_equal_systems_are_never_extreme(spark):
    df = spark.createDataFrame([(k, "x", k % 2, k % 2, k % 2) for k in range(40)], "record_key long, label string, truth int, one int, two int")
    r = resample.against_baselines(df, "one", ["two"], "mcc", 200).first()
    assert (r.observed_difference, r.permutation_p, r.probability_a_greater) == (0.0, 1.0, 0.5)


def test_crossfit_predictions_agree_with_counts(spark):
    decisions = catalogue._folded(spark, SF)
    rows = calibrate.crossfit_predictions(decisions, seed=catalogue.SEED)
    assert rows.count() == decisions.count()
    t, p = F.col("truth") == 1, F.col("candidate") == 1
    found = {r.fold: (r.tp, r.fp, r.fn, r.tn) for r in rows.groupBy("fold").agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn")).collect()}
    counts = calibrate.crossfit(decisions, seed=catalogue.SEED)[1]
    assert found == {r.fold: (r.tp, r.fp, r.fn, r.tn) for r in counts.collect()}


def test_query_rows(spark):
    found = {r.baseline: r for r in catalogue.queries()["crossfit_against_baselines"](spark, SF).collect()}
    assert set(found) == {"qwen", "codellama", "mistral", "or", "majority", "and"}
    assert all(r.ci_low <= r.observed_difference <= r.ci_high and 1 / 10_001 <= r.permutation_p <= 1 for r in found.values())
    pairs = catalogue.queries()["paired_binary"](spark, SF).collect()
    assert len(pairs) == 6 and all(r.holm_p >= r.permutation_p for r in pairs)


def test_objectives():
    with pytest.raises(ValueError):
        calibrate.objective("macro")
    assert calibrate.primary_metric("binary") == "balanced_accuracy" and calibrate.primary_metric("multilabel") == "micro_f1"


def test_scores_merge_once(spark):
    a = spark.createDataFrame([(1, "x", 0.5)], "record_key long, label string, score double")
    assert calibrate.merge_scores(a, a.withColumn("record_key", F.lit(2).cast("long"))).count() == 2
    with pytest.raises(ValueError):
        calibrate.merge_scores(a, a)
    assert validate.duplicate_keys(a, ["record_key"]).isEmpty()


def test_interval_of_plain_draws(spark):
    rng = random.Random(6)
    rows = [("g", rng.randrange(3), rng.randrange(2), rng.randrange(3)) for _ in range(60)] + [("h", 1, 0, 0)] * 5
    found = {r.g: r for r in resample.bootstrap_intervals(spark.createDataFrame(rows, "g string, tp long, fp long, fn long"), ["g"]).collect()}
    mine = [r[1:] for r in rows if r[0] == "g"]
    draws = []
    for _ in range(2000):
        tp, fp, fn = (sum(x) for x in zip(*(rng.choice(mine) for _ in mine), strict=True))
        draws.append(value("micro_f1", tp, fp, fn, 0))
    low, high = np.quantile(draws, [0.025, 0.975])
    assert found["g"].ci_low == pytest.approx(low, abs=0.03) and found["g"].ci_high == pytest.approx(high, abs=0.03)
    assert found["g"].value == pytest.approx(value("micro_f1", *(sum(x) for x in zip(*mine, strict=True)), 0)) and found["g"].repetitions == 1000
    assert (found["h"].ci_low, found["h"].ci_high, found["h"].records) == (1.0, 1.0, 5)
