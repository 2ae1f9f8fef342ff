import math
import random

import pytest
from pyspark.sql import functions as F

from attestor.operators import audit, calibrate, folds, metrics, resample, selective, stacking, validate


def test_calibration_by_hand(spark):
    rows = spark.createDataFrame([("x", "111", 2, 2), ("x", "000", 1, 0)], "label string, pattern string, n long, p long")
    table = calibrate.calibration_table(rows, [])
    scores = {r.pattern: r.s for r in table.select("pattern", calibrate.calibrated(F.col("n"), F.col("p"), F.col("prior"), F.lit(8.0)).alias("s")).collect()}
    assert table.first().prior == pytest.approx(0.6)
    assert scores == {"111": pytest.approx(0.68), "000": pytest.approx(4.8 / 9)}


def test_auc_ties_and_one_class(spark):
    rows = [("a", 0.1, 1, 0), ("a", 0.4, 2, 1), ("a", 0.8, 1, 1), ("b", 0.5, 3, 0)]
    found = {r.g: r.auc for r in selective.auc(spark.createDataFrame(rows, "g string, score double, n long, p long"), ["g"]).collect()}
    assert found == {"a": 0.875, "b": None}


def test_holm(spark):
    rows = spark.createDataFrame([("f", 1, 0.01), ("f", 2, 0.04), ("f", 3, 0.03)], "family string, k int, p_value double")
    found = {r.k: r.holm_p for r in resample.holm(rows, ["family"]).collect()}
    assert found == {1: pytest.approx(0.03), 2: pytest.approx(0.06), 3: pytest.approx(0.06)}


def test_bins_and_selective_edges(spark):
    scores = spark.createDataFrame([(1.0, 1, 1), (0.1, 1, 0), (0.3, 1, 0), (0.2, 1, 0)], "score double, n long, p long")
    bins = [r.b for r in scores.select(selective.bin_index(F.col("score")).alias("b")).collect()]
    assert bins == [9, 1, 3, 2]
    row = selective.selective_curve(scores.where("score = 0.2"), [0.8], []).first()
    assert row.accepted_decisions == 0  # 0.2 is above 1 - 0.8 in doubles
    two = spark.createDataFrame([(0.9, 1, 1), (0.8, 1, 0)], "score double, n long, p long")
    row = selective.selective_curve(two, [0.8], []).first()
    assert (row.accepted_positive_alerts, row.ground_truth_positive_recall, row.accepted_positive_precision) == (2, 1.0, 0.5)


def test_threshold_tie_takes_the_higher(spark):
    grid = spark.createDataFrame([(0.30, 2, 1, 1, 0), (0.35, 2, 1, 1, 0), (0.4, 1, 1, 2, 0)], "threshold double, tp long, fp long, fn long, tn long")
    assert calibrate.select_threshold(grid, [], calibrate.objective("micro_f1")).first().threshold == 0.35


def test_families_stay_whole(spark):
    rows = [("d", f"f{i // 2}", str(i % 2), 1) for i in range(12)]
    found = folds.grouped_folds(spark.createDataFrame(rows, "dataset string, family string, stratum string, n long"), 3, 7).collect()
    assert len(found) == 6 and {r.fold for r in found} == {0, 1, 2}


def test_folds_partition_and_balance(spark):
    rows = [(k, "clean" if k % 3 else "x") for k in range(300)]
    found = folds.stratified_folds(spark.createDataFrame(rows, "record_key long, stratum string"), 5, 1)
    assert found.count() == 300
    sizes = found.groupBy("stratum", "fold").count().collect()
    for s in ("clean", "x"):
        n = [r["count"] for r in sizes if r.stratum == s]
        assert len(n) == 5 and max(n) - min(n) <= 1


def test_single_records_level_the_strata(spark):
    """Families of one record fill what the large ones leave uneven, without a task that holds them all."""
    rows = [("d", "big", "x", 40), ("d", "mixed", "x", 2), ("d", "mixed", "y", 3)] + [("d", f"s{k}", "xy"[k % 2], 1) for k in range(400)] + [("e", f"t{k}", "z", 1) for k in range(7)]
    found = folds.grouped_folds(spark.createDataFrame(rows, "dataset string, family string, stratum string, n long"), 5, 3)
    held = {(r.dataset, r.family): r.fold for r in found.collect()}
    assert len(held) == found.count() == 409
    sizes = {}
    for d, f, s, n in rows:
        sizes.setdefault((d, s), [0] * 5)[held[d, f]] += n
    assert all(max(v) - min(v) <= 1 for v in sizes.values()), sizes


def test_targets():
    assert folds.balanced_targets(10, 10, 5) == {1: 3, 0: 2}
    assert folds.balanced_targets(2, 1, 5, secure=1) == {1: 2, 0: 1}
    assert folds.balanced_targets(1, 10, 6) == {1: 1, 0: 5}


def test_own_truth_does_not_leak(spark):
    """A record's held-out score stays when its own truth flips."""
    rows = [(k, "x", f"{k % 8:03b}", k % 2, k % 5) for k in range(200)]
    schema = "record_key long, label string, pattern string, truth int, fold int"

    def score(data):
        cells = calibrate.cells(spark.createDataFrame(data, schema), ["fold"])
        return {(r.fold, r.pattern): r.score for r in calibrate.held_out_scores(cells, [8.0]).collect()}

    flipped = [(k, l, p, 1 - t if k == 17 else t, f) for k, l, p, t, f in rows]
    assert score(rows)[17 % 5, f"{17 % 8:03b}"] == score(flipped)[17 % 5, f"{17 % 8:03b}"]


def test_coverage_falls_with_confidence(spark):
    rng = random.Random(1)
    rows = [(rng.random(), 3, rng.randint(0, 3)) for _ in range(200)]
    curve = selective.selective_curve(spark.createDataFrame(rows, "score double, n long, p long"), [0.5, 0.6, 0.7, 0.8, 0.9, 1.0], []).orderBy("confidence").collect()
    accepted = [r.accepted_decisions for r in curve]
    assert accepted == sorted(accepted, reverse=True)
    assert all(r.accepted_decisions + r.abstained_decisions == r.class_decisions_total for r in curve)


def test_metrics_of_large_counts(spark):
    big = 60_000
    row = metrics.with_metrics(spark.createDataFrame([(big, big, big, big, 2 * big)], "tp long, fp long, fn long, tn long, support long"), *metrics.ALL).first()
    assert row.mcc == 0.0 and row.f1 == 0.5 and row.balanced_accuracy == 0.5


def test_empty_pairs_count_as_asked(spark):
    rows = spark.createDataFrame([("s", 0, 0, 0), ("s", 1, 0, 0)], "system string, tp long, fp long, fn long")
    assert metrics.sample_scores(rows, ["system"], 1.0).first().sample_f1 == 1.0
    assert metrics.sample_scores(rows, ["system"], 0.0).first().sample_f1 == 0.5


def test_early_retry_is_exposure(spark):
    rows = spark.createDataFrame([(1, 0, "json_syntax_or_missing_result"), (1, 1, "valid")], "r int, k int, outcome string")
    row = audit.recovery_path(rows, "r", "k").first()
    assert (row.native_valid, row.recovered, row.exposed, row.retries) == (False, True, True, 1)


def test_resampling_agrees_with_records(spark):
    """The histogram's interval equals a record-level bootstrap's within Monte Carlo error."""
    import numpy as np

    rng = np.random.default_rng(3)
    a, b, t = (rng.random(400) < q for q in (0.5, 0.45, 0.5))
    rows = [("m", int(x & y), int(x & ~y), int(~x & y), int(z & y), int(z & ~y), int(~z & y)) for x, z, y in zip(a, b, t)]
    pairs = spark.createDataFrame(rows, "g string, tp_a int, fp_a int, fn_a int, tp_b int, fp_b int, fn_b int")
    got = resample.paired_tests(resample.contribution_histogram(pairs, ["g"]), ["g"], repetitions=4000).first()
    c = np.array([r[1:] for r in rows], float)

    def f1(s):
        return 2 * s[0] / (2 * s[0] + s[1] + s[2]) - 2 * s[3] / (2 * s[3] + s[4] + s[5])

    draws = [f1(c[rng.integers(0, 400, 400)].sum(0)) for _ in range(2000)]
    assert got.observed_difference == pytest.approx(f1(c.sum(0)))
    assert got.ci_low == pytest.approx(np.quantile(draws, 0.025), abs=0.02)
    assert got.ci_high == pytest.approx(np.quantile(draws, 0.975), abs=0.02)


def test_stacker_single_class_and_order(spark):
    rows = [(0, "x", f"{k:03b}", 20, 2 * bin(k).count("1") + 1) for k in range(8)] + [(0, "y", "000", 5, 0)]
    found = stacking.logistic_scores(spark.createDataFrame(rows, "fold int, label string, pattern string, train_n long, train_p long"), ["fold"]).where("c = 1.0").collect()
    x = {r.pattern: r.score for r in found if r.label == "x"}
    assert x["000"] < x["001"] < x["111"]
    assert {round(r.score, 9) for r in found if r.label == "y"} == {round(1 / 7, 9)}


def test_validation(spark):
    rows = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (3, 5)], "g int, k int")
    assert [r.g for r in validate.complete_index(rows, "k", ["g"]).collect()] == [3]
    with pytest.raises(ValueError, match="twice"):
        validate.require_empty(validate.duplicate_keys(rows, ["g"]), "twice")
    assert validate.progress(rows.where("g = 9"), ["g"], F.lit(0), "k").count() == 0
    zero = validate.progress(rows.where("g = 3"), ["g"], F.lit(0), "k").first()
    assert zero.percent == 100.0
    with pytest.raises(ValueError, match="margin"):
        validate.EvaluationConfig(margin=1.0)


def test_no_shuffle_of_records_for_systems(spark):
    """Votes collapse to cells before systems multiply them: the first aggregation reads the records."""
    rows = spark.createDataFrame([("d", 1, "x", 1, 1, 0, 1)], "dataset string, record_key long, label string, truth int, v1 int, v2 int, v3 int")
    plan = metrics.system_counts(rows, ["v1", "v2", "v3"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.rindex("Aggregate")
    assert math.isclose(metrics.system_counts(rows, ["v1", "v2", "v3"]).where("system = 'or'").first().tp, 1)


def test_differences_and_alignment(spark):
    a = spark.createDataFrame([("x", 1.0), ("y", 2.0)], "k string, v double")
    b = spark.createDataFrame([("x", 1.0 + 1e-13), ("z", 2.0)], "k string, v double")
    assert sorted(r.k for r in validate.differences(a, b, ["k"], "v").collect()) == ["y", "z"]
    runs = spark.createDataFrame([("m1", 1, "t"), ("m2", 1, "u"), ("m1", 2, "t"), ("m9", 3, "t")], "model string, r int, truth string")
    found = {(r.problem, r.item) for r in validate.model_alignment(runs, ["m1", "m2"], "r", "truth").collect()}
    assert found == {("model", "m9"), ("record", "2"), ("record", "3"), ("truth", "1")}


def test_published_identities(spark):
    """Ratios from counts: a published line of each task."""
    row = metrics.with_metrics(spark.createDataFrame([(138, 8, 8, 1276)], "tp long, fp long, fn long, tn long"), "f1", "balanced_accuracy").first()
    assert row.f1 == pytest.approx(2 * 138 / (2 * 138 + 16))
    assert row.balanced_accuracy == pytest.approx((138 / 146 + 1276 / 1284) / 2)
