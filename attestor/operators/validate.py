"""Integrity checks as data: each check is a DataFrame of violations; ``require_empty`` turns them into errors."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import format_duration, safe_divide


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).where("rows > 1")


def conflicting_values(df: DataFrame, keys: list[str], value: Column | str) -> DataFrame:
    """Keys with more than one value (nulls aside)."""
    return df.groupBy(*keys).agg(F.count_distinct(value).alias("values")).where("values > 1")


def missing(expected: DataFrame, observed: DataFrame, keys: list[str]) -> DataFrame:
    return expected.select(*keys).distinct().join(observed.select(*keys), keys, "left_anti")


def key_set_difference(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of one side only, with the side."""
    left = missing(a, b, keys).withColumn("side", F.lit("a"))
    return left.unionByName(missing(b, a, keys).withColumn("side", F.lit("b")))


def consistent_duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row a key; violations are keys whose rows differ (``conflicts``)."""
    rest = [c for c in df.columns if c not in keys]
    packed = F.to_json(F.struct(*rest))
    return df.groupBy(*keys).agg(F.count("*").alias("rows"), F.count_distinct(packed).alias("versions"))


def manifest_join(manifest: DataFrame, rows: DataFrame, key: str, prediction: str) -> DataFrame:
    """Every manifest entry with its prediction; a missing one counts as an empty prediction."""
    found = rows.select(key, F.col(prediction), F.lit(True).alias("_written"))
    joined = manifest.join(found, key, "left")
    return joined.select(*manifest.columns, F.coalesce(prediction, F.array().cast("array<string>")).alias(prediction), F.coalesce("_written", F.lit(False)).alias("written"))


def coverage(joined: DataFrame, by: list[str], findings: Column, written: str = "written") -> DataFrame:
    """Expected, written and missing records, those with findings, and findings in all."""
    return joined.groupBy(*by).agg(
        F.count("*").alias("records_expected"),
        F.count_if(written).alias("records_written"),
        F.count_if(~F.col(written)).alias("records_missing"),
        F.count_if(findings > 0).alias("records_with_findings"),
        F.sum(findings).cast("long").alias("total_findings"),
    )


def status_counts(df: DataFrame, by: list[str], status: str, known: tuple[str, ...] = ("ok", "partial", "failed")) -> DataFrame:
    return df.groupBy(*by).agg(*[F.count_if(F.col(status) == s).alias(s) for s in known], F.count_if(~F.col(status).isin(*known) | F.col(status).isNull()).alias("other"))


def progress(df: DataFrame, by: list[str], expected: Column, runtime: str) -> DataFrame:
    """Completed records, percent (100 where none is expected), mean runtime and time left."""
    g = df.groupBy(*by).agg(F.count("*").alias("completed"), F.max(expected).alias("expected"), F.round(F.avg(runtime), 6).alias("mean_runtime"))
    left = F.greatest(F.lit(0), F.col("expected") - F.col("completed"))
    return g.select(*by, "completed", "expected", F.when(F.col("expected") == 0, 100.0).otherwise(100.0 * safe_divide(F.col("completed"), F.col("expected"))).alias("percent"), "mean_runtime", F.round(F.col("mean_runtime") * left, 3).alias("eta_seconds")).withColumn("eta", format_duration(F.col("eta_seconds")))


def modal_count(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """The most frequent value; of equally frequent ones the largest."""
    g = df.groupBy(*by, value).agg(F.count("*").alias("_n"))
    return g.groupBy(*by).agg(F.max(F.struct("_n", F.col(value).alias("value"))).alias("m")).select(*by, F.col("m.value").alias("modal_value"), F.col("m._n").alias("frequency"))


def complete_index(df: DataFrame, index: str, by: list[str]) -> DataFrame:
    """Groups whose indices are not exactly 0..n-1."""
    g = df.groupBy(*by).agg(F.count("*").alias("n"), F.count_distinct(index).alias("distinct"), F.min(index).alias("lo"), F.max(index).alias("hi"))
    return g.where("n <> distinct or lo <> 0 or hi <> n - 1")


def require_empty(violations: DataFrame, message: str, shown: int = 20) -> None:
    """An error that shows the first violations, if there are any."""
    found = violations.limit(shown).collect()
    if found:
        raise ValueError(f"{message}: {[r.asDict() for r in found]}")


@dataclass(frozen=True)
class EvaluationConfig:
    """Parameters of the analyses, checked when made."""

    outer_folds: int = 5
    inner_folds: int = 3
    shrinkage: float = 8.0
    thresholds: tuple[float, ...] = tuple(k / 20 for k in range(1, 20))
    confidences: tuple[float, ...] = (0.80, 0.90, 0.95)
    repetitions: int = 10_000
    margin: float = 0.01
    penalties: tuple[float, ...] = (0.01, 0.1, 1.0, 10.0)
    seed: int = 20260811

    def __post_init__(self):
        checks = {
            "folds": self.outer_folds >= 2 and self.inner_folds >= 2,
            "shrinkage": self.shrinkage > 0,
            "thresholds": bool(self.thresholds) and all(0 <= t <= 1 for t in self.thresholds),
            "confidences": all(0.5 <= q <= 1 for q in self.confidences),
            "repetitions": self.repetitions >= 100,
            "margin": 0 < self.margin < 1,
            "penalties": bool(self.penalties) and all(c > 0 for c in self.penalties),
        }
        wrong = [k for k, ok in checks.items() if not ok]
        if wrong:
            raise ValueError(f"out of range: {', '.join(wrong)}")


def differences(a: DataFrame, b: DataFrame, keys: list[str], value: str, tolerance: float = 1e-12) -> DataFrame:
    """Keys whose values differ by more than the tolerance, or that one side lacks."""
    joined = a.select(*keys, F.col(value).alias("value_a")).join(b.select(*keys, F.col(value).alias("value_b")), keys, "full_outer")
    return joined.where(F.col("value_a").isNull() | F.col("value_b").isNull() | (F.abs(F.col("value_a") - F.col("value_b")) > tolerance))


def model_alignment(runs: DataFrame, models: list[str], key: str, truth: str) -> DataFrame:
    """Problems of runs to be compared: models missing or unknown, records that not all models have, unequal truths."""
    observed = runs.select("model").distinct()
    expected = runs.sparkSession.createDataFrame([(m,) for m in models], "model string")
    model = key_set_difference(observed, expected, ["model"]).select(F.lit("model").alias("problem"), F.col("model").alias("item"))
    g = runs.groupBy(key).agg(F.count_distinct("model").alias("models"), F.count_distinct(truth).alias("truths"))
    records = g.where(F.col("models") != len(models)).select(F.lit("record").alias("problem"), F.col(key).cast("string").alias("item"))
    truths = g.where("truths > 1").select(F.lit("truth").alias("problem"), F.col(key).cast("string").alias("item"))
    return model.unionByName(records).unionByName(truths)
