"""Tables written in between, for steps that read one several times."""

from __future__ import annotations

from pyspark.sql import DataFrame


class Workspace:
    """Written tables in the cluster's shared checkpoint folder; they cut lineage and survive lost executors."""

    def __init__(self, spark):
        self.spark = spark
        set_in = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
        import uuid

        if not set_in:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            set_in = "/tmp/checkpoints"
        self.root = f"{set_in.rstrip('/')}/attestor-{uuid.uuid4().hex}"
        self.n = 0
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        self.fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.fs.deleteOnExit(path)
        self.path = jvm.org.apache.hadoop.fs.Path

    def keep(self, df: DataFrame) -> DataFrame:
        """Write ``df`` as Parquet and return the written table."""
        at = f"{self.root}/{self.n}"
        self.n += 1
        df.write.parquet(at)
        out = self.spark.read.schema(df.schema).parquet(at)
        out._attestor_path = at
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Delete written tables that nothing reads any longer."""
        for df in frames:
            self.fs.delete(self.path(df._attestor_path), True)
