"""Sinks: CSV and JSON bundles, Markdown reports, verified replacement of a table."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, refuse_empty: bool = False, columns: list[str] | None = None) -> None:
    """One CSV file with a header. ``columns`` is the exact schema expected, if given."""
    if columns is not None and df.columns != columns:
        raise ValueError(f"columns are {df.columns}, expected {columns}")
    if refuse_empty and df.isEmpty():
        raise ValueError(f"nothing to write to {path}")
    df.coalesce(1).write.mode("overwrite").csv(path, header=True, escape='"')


def json_bundle(tables: dict[str, DataFrame], most: int = 10_000) -> str:
    """Small result tables as one JSON text; a table over ``most`` rows is an error."""
    out = {}
    for name, df in tables.items():
        rows = df.limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"{name} has over {most} rows")
        out[name] = [r.asDict(True) for r in rows]
    return json.dumps(out, indent=2, sort_keys=True, default=str)


def markdown_table(df: DataFrame, most: int = 10_000) -> str:
    """A small result table; one over ``most`` rows is an error."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"the table has over {most} rows")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    for r in rows:
        lines.append("| " + " | ".join("" if v is None else f"{v:.6f}" if isinstance(v, float) else str(v) for v in r) + " |")
    return "\n".join(lines)


def report(sections: dict[str, DataFrame], title: str) -> str:
    return "\n\n".join([f"# {title}", *(f"## {name}\n\n{markdown_table(df)}" for name, df in sections.items())]) + "\n"


def replace_verified(df: DataFrame, path: str) -> int:
    """Write beside ``path``, check the count that was observed while writing, then swap by renames; returns the count.

    The old table moves aside first and goes last, so a crash at any point leaves one of the two whole; a next call
    finishes the swap.
    """
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    target, beside, old = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path}.part", f"{path}.old"))
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(old) and not fs.exists(target):
        fs.rename(old, target)
    fs.delete(old, True)
    rows = Observation()
    df.observe(rows, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{path}.part")
    written, expected = spark.read.parquet(f"{path}.part").count(), rows.get["n"]
    if written != expected:
        raise ValueError(f"{written} rows written, {expected} expected")
    if fs.exists(target) and not fs.rename(target, old):
        raise OSError(f"{path} could not be moved aside")
    if not fs.rename(beside, target):
        raise OSError(f"{path}.part could not be renamed")
    fs.delete(old, True)
    return written


def verified_text(spark, path: str, text: str) -> None:
    """Write a small text (such as a run's metadata), read it back and compare; an error if they differ."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(target, True)
    out.write(bytearray(text.encode()))
    out.close()
    held = spark.read.text(path, wholetext=True).first()
    if (held.value if held else "") != text:
        raise OSError(f"{path} does not hold what was written")


def union_rows(frames: list[DataFrame]) -> DataFrame:
    """All rows with the union of the columns, nulls where a frame lacks one; columns in first-seen order."""
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out
