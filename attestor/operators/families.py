"""Source families: records with equal normalised sources, their conflicts and their overlap across datasets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def family_table(records: DataFrame, family: Column) -> DataFrame:
    """Records of each dataset and family, and how many different truths they have (unlabelled ones aside)."""
    return records.groupBy("dataset", family.alias("family")).agg(F.count("*").alias("records"), F.size(F.collect_set("truth")).cast("long").alias("truths"))


def family_audit(table: DataFrame) -> DataFrame:
    multi = F.col("records") > 1
    return table.groupBy("dataset").agg(
        F.sum("records").cast("long").alias("records"),
        F.count("*").alias("families"),
        F.count_if(multi).alias("multi_record_families"),
        F.sum(F.when(multi, F.col("records")).otherwise(0)).cast("long").alias("records_in_multi"),
        F.max("records").cast("long").alias("largest_family"),
        F.count_if(F.col("truths") > 1).alias("conflicting_families"),
    )


def cross_overlap(table: DataFrame) -> DataFrame:
    """Families and records that two datasets share, each pair of datasets once.

    A family has a row a dataset in ``table``, so what is gathered for it, and its pairs, follow the number of datasets.
    """
    held = table.groupBy("family").agg(F.array_sort(F.collect_list(F.struct("dataset", "records"))).alias("d")).where(F.size("d") > 1)
    pairs = F.flatten(F.transform("d", lambda a, k: F.transform(F.slice("d", k + 2, F.size("d")), lambda b: F.struct(a["dataset"].alias("dataset_a"), b["dataset"].alias("dataset_b"), a["records"].alias("a"), b["records"].alias("b")))))
    each = held.select(F.explode(pairs).alias("p")).select("p.*")
    return each.groupBy("dataset_a", "dataset_b").agg(F.count("*").alias("shared_families"), F.sum("a").cast("long").alias("records_a"), F.sum("b").cast("long").alias("records_b"))
