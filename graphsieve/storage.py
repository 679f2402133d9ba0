"""Tables that cut the lineage of loops, in the folder that all executors share."""

from __future__ import annotations

import atexit
import gc
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="gs-"), "graphsieve_src.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.join("graphsieve", os.path.relpath(path, root)))
    sc.addPyFile(target)
    _SHIPPED.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a local one where it is unset and all runs on this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="gs-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", folder)
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


class Scratch:
    """Tables written below the shared folder.

    ``save`` writes a DataFrame and reads it back, which cuts the lineage; a lost
    executor costs nothing that is already written.  ``drop`` removes a table as
    soon as later ones no longer need it, the rest goes when the driver ends.
    ``LIVE`` holds those that still have tables.
    """

    LIVE: set[Scratch] = set()

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        Scratch.LIVE.add(self)
        atexit.register(self.drop)

    def path(self, table: str) -> str:
        return f"{self.base}/{table}"

    def save(self, df: DataFrame, table: str, *partition: str) -> DataFrame:
        writer = df.write.mode("overwrite").option("compression", "zstd")
        (writer.partitionBy(*partition) if partition else writer).parquet(self.path(table))
        return self.spark.read.schema(df.schema).parquet(self.path(table))

    def settle(self) -> None:
        """Let Spark remove shuffle files that no plan refers to any more; they count as disk."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, table: str | None = None) -> None:
        if table is None:
            Scratch.LIVE.discard(self)
        try:
            jvm = self.spark.sparkContext._jvm
            path = jvm.org.apache.hadoop.fs.Path(self.path(table) if table else self.base)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # the session has ended: nothing to remove with
            pass


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
