"""Incremental ingestion of append-only prediction logs, resumable by checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def stream_of(spark: SparkSession, path: str, schema, files_per_batch: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def append_new(stream: DataFrame, target: str, checkpoint: str, keys: list[str]) -> StreamingQuery:
    """Append rows whose keys the target does not hold yet; a batch that runs again adds nothing.

    The target's keys, not streaming state, are what rows are compared with, so state does not grow with the log.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        row = F.struct(*batch.columns)  # of the rows of one key the same one stays in any order
        new = batch.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.min_by(row, F.to_json(row)).alias("row")).select("row.*")
        try:
            held = spark.read.parquet(target).select(*keys)
            new = new.join(held, keys, "left_anti")
        except Exception as e:  # the first batch finds no target
            if "PATH_NOT_FOUND" not in str(e):
                raise
        new.write.mode("append").parquet(target)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_progress(stream: DataFrame, time: str, window: str, late: str, by: list[str]) -> DataFrame:
    """Rows and mean runtime by event-time window, late rows up to ``late``."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window), *by).agg(F.count("*").alias("rows"), F.avg("value").alias("mean_value"))


def pending(manifest: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Manifest entries without a written row."""
    return manifest.join(done.select(*keys), keys, "left_anti")
