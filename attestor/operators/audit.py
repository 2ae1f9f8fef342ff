"""Audit of attempts: first-attempt validity, recovery exposure, sensitivity policies and their rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.scalar import safe_divide
from .calibrate import objective

OUTCOMES = ("valid", "runtime_failure", "taxonomy_violation", "schema_violation", "json_syntax_or_missing_result", "other_validation_failure", "other_failure")
FLAGS = ("native", "exposed", "touched")


def recovery_path(attempts: DataFrame, record: str, order: str, outcome: str = "outcome") -> DataFrame:
    """One row a record: outcome of the first attempt, attempts, retries, whether a retry recovered, exposure."""
    first = F.min_by(outcome, order)
    g = attempts.groupBy(record).agg(F.count("*").alias("attempts"), first.alias("first_outcome"), F.max((F.col(outcome) == "valid").cast("int")).alias("any_valid"))
    native = F.col("first_outcome") == "valid"
    return g.select(record, "attempts", "first_outcome", (F.col("attempts") - 1).alias("retries"), native.alias("native_valid"), (~native & (F.col("any_valid") == 1)).alias("recovered"), (~native | (F.col("attempts") > 1)).alias("exposed"))


def exposure_summary(paths: DataFrame) -> DataFrame:
    """Records, rates and the histogram of first outcomes over all records."""
    n = F.count("*")
    return paths.agg(
        n.alias("records"),
        F.count_if("native_valid").alias("native_valid"),
        F.count_if("recovered").alias("recovered"),
        F.count_if("exposed").alias("exposed"),
        F.sum("retries").cast("long").alias("retries"),
        safe_divide(F.count_if("native_valid"), n).alias("native_valid_rate"),
        safe_divide(F.count_if("exposed"), n).alias("exposure_rate"),
        *[F.count_if(F.col("first_outcome") == o).alias(f"first_{o}") for o in OUTCOMES],
    )


def sensitivity(decisions: DataFrame, models: list[str], metric: str = "micro_f1") -> DataFrame:
    """The primary metric of each model under six policies, its difference from final_all, and the models' ranking.

    ``decisions`` has record_key, label, truth, a final vote column a model, and for each model three booleans of the
    record: ``{model}_native`` (first attempt valid), ``{model}_exposed`` (any recovery) and ``{model}_touched``
    (selective repair); ``{model}_first``, if there, is the vote of the first attempt, else that is the final one. A
    policy keeps predictions, counts some as empty, or keeps only records that all models share. The metric is micro_f1,
    or balanced_accuracy for binary data. Rows collapse to distinct cells before policies multiply them.
    """
    flags = [f"{m}_{f}" for m in models for f in (*FLAGS, "first") if f"{m}_{f}" in decisions.columns]
    cells = decisions.groupBy("truth", *models, *flags).agg(F.count("*").alias("m"))

    def every(flag: str, value: bool):
        out = F.lit(True)
        for m in models:
            out = out & (F.col(f"{m}_{flag}") == value)
        return out

    rows = []
    for k, m in enumerate(models):
        final = F.col(m)
        policies = (
            ("final_all", final, F.lit(True)),
            ("first_attempt_strict_all", F.when(F.col(f"{m}_native"), F.col(f"{m}_first") if f"{m}_first" in flags else final).otherwise(0), F.lit(True)),
            ("all_recovery_as_empty", F.when(~F.col(f"{m}_exposed"), final).otherwise(0), F.lit(True)),
            ("common_native_valid", final, every("native", True)),
            ("selective_repair_as_empty_legacy", F.when(~F.col(f"{m}_touched"), final).otherwise(0), F.lit(True)),
            ("common_selective_untouched_legacy", final, every("touched", False)),
        )
        for policy, pred, kept in policies:
            rows.append(F.struct(F.lit(m).alias("model"), F.lit(k).alias("model_order"), F.lit(policy).alias("policy"), pred.cast("int").alias("pred"), kept.alias("kept")))
    long = cells.select("truth", "m", F.explode(F.array(*rows)).alias("r")).select("truth", "m", "r.*").where("kept")

    def total(condition):
        return F.sum(F.when(condition, F.col("m")).otherwise(0)).cast("long")

    t, p = F.col("truth") == 1, F.col("pred") == 1
    g = long.groupBy("model", "model_order", "policy").agg(F.sum("m").cast("long").alias("n"), total(t & p).alias("tp"), total(~t & p).alias("fp"), total(t & ~p).alias("fn"), total(~t & ~p).alias("tn"))
    g = g.withColumn("primary_value", objective(metric))
    final = F.max(F.when(F.col("policy") == "final_all", F.col("primary_value"))).over(Window.partitionBy("model"))
    rank = F.row_number().over(Window.partitionBy("policy").orderBy(F.desc("primary_value"), "model_order"))  # a row a model
    return g.select("model", "policy", "n", "tp", "fp", "fn", "primary_value", (F.col("primary_value") - final).alias("delta_primary_vs_final_all"), rank.alias("ranking"))


def sensitivity_assessment(rows: DataFrame, margin: float = 0.01) -> DataFrame:
    """Whether the ranking stays over final_all and the three main policies, and the full-record differences stay
    within the margin."""
    rows = rows.where(~F.endswith(F.col("policy"), F.lit("_legacy")))
    full = F.col("policy").isin("first_attempt_strict_all", "all_recovery_as_empty")
    by_model = rows.groupBy("model").agg(F.count_distinct("ranking").alias("ranks"), F.max(F.when(full, F.abs("delta_primary_vs_final_all"))).alias("delta"))
    g = by_model.agg(F.max("ranks").alias("ranks"), F.max("delta").alias("delta"))
    return g.select(F.round("delta", 12).alias("max_absolute_primary_delta"), (F.col("ranks") == 1).alias("ranking_stable"), ((F.col("ranks") == 1) & (F.col("delta") <= margin)).alias("passed"))


def mechanism(decisions: DataFrame, systems: list[str], reference: str) -> tuple[DataFrame, DataFrame]:
    """(pattern diagnostics, summary): positives and true positives of each system by label and pattern, the share of
    the reference's positives that no model voted for, and its disagreement with the other systems.
    """
    cells = decisions.groupBy("label", "pattern", "truth", *systems).agg(F.count("*").alias("m"))

    def total(condition):
        return F.sum(F.when(condition, F.col("m")).otherwise(0)).cast("long")

    t = F.col("truth") == 1
    diagnostics = cells.groupBy("label", "pattern").agg(
        F.sum("m").cast("long").alias("decisions"),
        total(t).alias("truth_positive"),
        *[total(F.col(s) == 1).alias(f"{s}_positive") for s in systems],
        *[total((F.col(s) == 1) & t).alias(f"{s}_tp") for s in systems],
    )
    r, none = F.col(reference) == 1, ~F.contains(F.col("pattern"), F.lit("1"))
    summary = cells.agg(
        F.sum("m").cast("long").alias("class_decisions"),
        total(r).alias("positive_decisions"),
        total(r & none).alias("positive_from_all_zero"),
        safe_divide(total(r & none), total(r)).alias("fraction_from_all_zero"),
        *[total(F.col(reference) != F.col(s)).alias(f"disagreement_{s}") for s in systems if s != reference],
    )
    return diagnostics, summary


def zero_support(report: DataFrame, by: list[str]) -> DataFrame:
    """The classes without support of each system, and what they were predicted for, from ``metrics.support_report``."""
    none = ~F.col("metric_defined")
    return report.groupBy(*by).agg(F.array_join(F.array_sort(F.collect_list(F.when(none, F.col("label")))), ";").alias("zero_support_classes"), F.sum("zero_support_false_positives").cast("long").alias("zero_support_false_positives"))
