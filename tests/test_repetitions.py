"""The registered queries draw as many resamples as the reference."""

import hashlib

import numpy as np
import pytest

from attestor.operators import resample
from attestor.plans import catalogue

SF = "/root/testdata/sf0.001"


def test_paired_bootstrap_draws_ten_thousand(spark):
    found = catalogue.queries()["paired_bootstrap"](spark, SF).collect()
    assert len(found) == 3
    for r in found:
        assert r.permutation_p >= 1 / 10_001 and r.permutation_p * 10_001 == pytest.approx(round(r.permutation_p * 10_001), abs=1e-6)
    assert min(r.permutation_p for r in found) == pytest.approx(1 / 10_001)


def test_bootstrap_ci_draws_a_thousand(spark):
    assert catalogue.queries()["bootstrap_ci"](spark, SF).first().repetitions == 1000


def test_a_thousand_hashed_draws_by_hand(spark):
    rows = [(k, k % 3, k % 2, (k + 1) % 4) for k in range(25)]
    got = resample.hashed_bootstrap(spark.createDataFrame(rows, "record_key long, tp long, fp long, fn long"), [], 1000, 2026).first()
    steps, values = resample.poisson_steps(), []
    for repetition in range(1000):
        tp = fp = fn = 0
        for k, *c in rows:
            h = int(hashlib.sha256(f"2026|{repetition}|{k}".encode()).hexdigest()[:8], 16)
            w = sum(h >= s for s in steps)
            tp, fp, fn = tp + w * c[0], fp + w * c[1], fn + w * c[2]
        values.append(2 * tp / (2 * tp + fp + fn))
    assert (got.ci_low, got.ci_high) == (pytest.approx(np.quantile(values, 0.025), abs=1e-8), pytest.approx(np.quantile(values, 0.975), abs=1e-8))
