"""Paired resampling of metric differences, Holm's correction and percentiles.

Metrics depend on records only through summed contributions, so records with equal contributions are one weighted row.
A bootstrap sample of n records is then a multinomial draw over those rows, and a random swap of two systems is a
binomial draw in each: the cost follows the number of distinct contributions, not of records.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.scalar import hash32, safe_divide


#: Counts that a metric is made of.
COUNTS = {"micro_f1": ("tp", "fp", "fn"), "balanced_accuracy": ("tp", "fp", "fn", "tn"), "mcc": ("tp", "fp", "fn", "tn")}


def contribution_histogram(pairs: DataFrame, by: list[str], metric: str = "micro_f1") -> DataFrame:
    """Records by joint contribution: the metric's counts of system a and of system b, with their number m."""
    return pairs.groupBy(*by, *[f"{c}_{s}" for s in "ab" for c in COUNTS[metric]]).agg(F.count("*").alias("m"))


def metric_of(metric: str):
    """The metric as a function of arrays whose last axis holds its counts; 0 where it is not defined."""
    import numpy as np

    def ratio(a, b):
        return np.divide(a, b, out=np.zeros(np.shape(b)), where=b > 0)

    def value(c):
        tp, fp, fn = c[..., 0], c[..., 1], c[..., 2]
        if metric == "micro_f1":
            return ratio(2 * tp, 2 * tp + fp + fn)
        tn = c[..., 3]
        if metric == "balanced_accuracy":
            return (ratio(tp, tp + fn) + ratio(tn, tn + fp)) / 2
        return ratio(tp * tn - fp * fn, np.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)))

    return value


def paired_tests(histogram: DataFrame, by: list[str], repetitions: int = 10_000, seed: int = 2026, batch: int = 256, slack: float = 1e-15, metric: str = "micro_f1") -> DataFrame:
    """Observed difference of the metric, bootstrap interval, P(a > b) with half ties, and swap-permutation p.

    Each comparison's histogram (distinct contributions only) is one pandas group; draws come in batches of bounded
    memory from a seed that depends on the comparison alone. A permuted difference counts as extreme from the observed
    one less ``slack`` on.
    """
    schema = ", ".join(f"{c} {t}" for c, t in histogram.select(*by).dtypes) + ", records long, observed_difference double, ci_low double, ci_high double, probability_a_greater double, permutation_p double"
    columns = [[f"{c}_{s}" for c in COUNTS[metric]] for s in "ab"]

    def test(key, pdf):
        import hashlib

        import numpy as np
        import pandas as pd

        value = metric_of(metric)
        pdf = pdf.sort_values([*columns[0], *columns[1]])
        a, b = (pdf[c].to_numpy(float) for c in columns)
        m = pdf.m.to_numpy()
        n = int(m.sum())
        rng = np.random.default_rng((seed + int(hashlib.sha256("|".join(map(str, key)).encode()).hexdigest()[:8], 16)) % 2**32)
        observed = float(value(m @ a) - value(m @ b))
        draws, extreme = [], 0
        for start in range(0, repetitions, batch):
            size = min(batch, repetitions - start)
            w = rng.multinomial(n, m / n, size=size)
            draws.append(value(w @ a) - value(w @ b))
            swapped = rng.binomial(m, 0.5, size=(size, len(m)))
            moved = swapped @ (b - a)
            d = value(m @ a + moved) - value(m @ b - moved)
            extreme += int((np.abs(d) >= abs(observed) - slack).sum())
        d = np.concatenate(draws)
        low, high = np.quantile(d, [0.025, 0.975])
        return pd.DataFrame([(*key, n, observed, low, high, float((d > 0).mean() + 0.5 * (d == 0).mean()), (extreme + 1) / (repetitions + 1))])

    return histogram.groupBy(*by).applyInPandas(test, schema)


def bootstrap_intervals(contributions: DataFrame, by: list[str], repetitions: int = 1000, seed: int = 2026, batch: int = 256, metric: str = "micro_f1") -> DataFrame:
    """Value and percentile interval of a metric by group, from records with their counts; a draw is a multinomial over
    the distinct contributions, so that records are read once whatever the repetitions."""
    columns = list(COUNTS[metric])
    histogram = contributions.groupBy(*by, *columns).agg(F.count("*").alias("m"))
    schema = ", ".join([f"{c} {t}" for c, t in histogram.select(*by).dtypes] + ["records long", "value double", "ci_low double", "ci_high double", "repetitions long"])

    def draw(key, pdf):
        import hashlib

        import numpy as np
        import pandas as pd

        value = metric_of(metric)
        pdf = pdf.sort_values(columns)
        c, m = pdf[columns].to_numpy(float), pdf.m.to_numpy()
        n = int(m.sum())
        rng = np.random.default_rng((seed + int(hashlib.sha256("|".join(map(str, key)).encode()).hexdigest()[:8], 16)) % 2**32)
        draws = [value(rng.multinomial(n, m / n, size=min(batch, repetitions - k)) @ c) for k in range(0, repetitions, batch)]
        low, high = np.quantile(np.concatenate(draws), [0.025, 0.975])
        return pd.DataFrame([(*key, n, float(value(m @ c)), low, high, repetitions)])

    return histogram.groupBy(*by).applyInPandas(draw, schema)


def against_baselines(decisions: DataFrame, candidate: str, baselines: list[str], metric: str = "micro_f1", repetitions: int = 10_000, seed: int = 2026) -> DataFrame:
    """Paired tests of a candidate's predictions against each baseline's; all are 0/1 columns beside record_key and truth.

    Contributions of a record are sums over its labels; a record is one row whatever the number of systems.
    """
    t = F.col("truth") == 1
    cases = {"tp": (t, 1), "fp": (~t, 1), "fn": (t, 0), "tn": (~t, 0)}
    counts = COUNTS[metric]
    sums = [F.sum((cases[c][0] & (F.col(s) == cases[c][1])).cast("int")).alias(f"{c}__{s}") for s in (candidate, *baselines) for c in counts]
    records = decisions.groupBy("record_key").agg(*sums)
    pairs = [F.struct(F.lit(b).alias("baseline"), *[F.col(f"{c}__{s}").alias(f"{c}_{x}") for s, x in ((candidate, "a"), (b, "b")) for c in counts]) for b in baselines]
    long = records.select(F.explode(F.array(*pairs)).alias("x")).select("x.*")
    return paired_tests(contribution_histogram(long, ["baseline"], metric), ["baseline"], repetitions, seed, metric=metric)


def hashed_bootstrap(records: DataFrame, by: list[str], repetitions: int, seed: int) -> DataFrame:
    """Bootstrap intervals of micro F1 from Poisson(1) record weights that are hashes, for engines to agree on.

    Each record draws a weight for each repetition by comparing a 32-bit hash with the Poisson distribution's steps;
    weights are aggregated with map-side combine, so the records times repetitions are never shuffled.
    """
    from math import exp, factorial

    steps, total = [], 0.0
    for k in range(8):
        total += exp(-1) / factorial(k)
        steps.append(int(total * 2**32))
    each = records.select("*", F.explode(F.sequence(F.lit(0), F.lit(repetitions - 1))).alias("repetition"))
    h = hash32(F.concat_ws("|", F.lit(str(seed)), F.col("repetition").cast("string"), F.col("record_key").cast("string")))
    weight = sum(((h >= s).cast("int") for s in steps[1:]), (h >= steps[0]).cast("int"))
    sums = each.groupBy(*by, "repetition").agg(*[F.sum(F.col(c) * weight).alias(c) for c in ("tp", "fp", "fn")])
    value = safe_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    return sums.groupBy(*by).agg(F.round(F.percentile(value, F.lit(0.025)), 9).alias("ci_low"), F.round(F.percentile(value, F.lit(0.975)), 9).alias("ci_high"), F.count("*").alias("repetitions"))


def poisson_steps() -> list[int]:
    """The bounds that ``hashed_bootstrap`` compares with."""
    from math import exp, factorial

    return [int(sum(exp(-1) / factorial(j) for j in range(k + 1)) * 2**32) for k in range(8)]


def holm(tests: DataFrame, family: list[str], p: str = "p_value", order: str | None = None) -> DataFrame:
    """Holm-adjusted p values by family (a family is a set of comparisons, not of records)."""
    ordered = [F.col(p)] + ([F.col(order)] if order else [])
    rank = F.row_number().over(Window.partitionBy(*family).orderBy(*ordered))
    size = F.count("*").over(Window.partitionBy(*family))
    step = F.least(F.lit(1.0), (size - rank + 1) * F.col(p))
    running = F.max("_step").over(Window.partitionBy(*family).orderBy("_rank").rowsBetween(Window.unboundedPreceding, 0))
    out = tests.withColumn("_rank", rank).withColumn("_step", step).withColumn("holm_p", running)
    return out.withColumn("significant", F.col("holm_p") < 0.05).drop("_rank", "_step")
