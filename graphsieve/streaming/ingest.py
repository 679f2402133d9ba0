"""Incremental import: new source files of a folder are parsed as they arrive.

Files are independent, so the stream appends nodes and unlinked edges; ``linked`` reads
them back and links calls across all files seen so far.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..graph import Graph
from ..sources.python_frontend import _NODE_NAMES, _OUT, _rows, link
from ..storage import ship

_FILES = "path string, modificationTime timestamp, length long, content binary"


def start(spark: SparkSession, folder: str, target: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Parse files that the stream has not seen; exactly once by the checkpoint."""
    ship(spark)
    files = spark.readStream.format("binaryFile").schema(_FILES).option("pathGlobFilter", "*.py").option("recursiveFileLookup", "true").load(folder)
    rows = files.select("path", F.col("content").cast("string").alias("content")).mapInArrow(_rows, _OUT)
    writer = rows.writeStream.format("parquet").partitionBy("kind").option("path", target).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()


def linked(spark: SparkSession, target: str) -> Graph:
    rows = spark.read.schema(_OUT).parquet(target)
    nodes = rows.where("kind = 'node'").select(_NODE_NAMES)
    return link(spark, nodes, rows.where("kind = 'edge'").select("src", "dst", F.col("edge").alias("label"), "idx"))
