"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a temporary folder where it is unset and Spark runs in one process."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="vitrine-")
    context.setCheckpointDir(folder)
    return folder


class Workspace:
    """Writes tables under one folder of its own and reads them back, which cuts lineage and survives lost executors.

    ``drop`` removes a table as soon as nothing reads it any more; what is left goes when the driver ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/vitrine-{uuid.uuid4().hex}"
        atexit.register(self.close)

    def store(self, df: DataFrame, name: str, partition_by: list[str] | None = None, **options: str) -> DataFrame:
        writer = df.write.mode("overwrite").option("compression", "zstd").options(**options)
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(f"{self.path}/{name}")
        return self.read(name, df)

    def read(self, name: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(f"{self.path}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(f"{self.path}/{name}")

    def release(self) -> None:
        """Lets Spark delete the shuffle files of finished steps, which it does once the driver's collector finds them unused: the
        first round finds the plans, the second what they held.
        """
        for _ in range(2):
            gc.collect()
            self.spark.sparkContext._jvm.System.gc()
            time.sleep(0.3)

    def close(self) -> None:
        try:
            self._delete(self.path)
        except Exception:  # noqa: BLE001 - at interpreter exit the JVM may be gone already
            pass

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
