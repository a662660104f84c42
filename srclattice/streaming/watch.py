"""Continuous indexing: a stream of changed files merged into the parsed table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..facts.build import PARSED, parsed
from ..session import ship
from ..sources.files import stream_java


def merge(index: str):
    """For foreachBatch: each path's newest version replaces what the index has; a batch that is run again changes nothing."""

    def f(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        newest = Window.partitionBy("path").orderBy(F.desc("modified"), F.desc("content"))
        files = batch.withColumn("r", F.row_number().over(newest)).where("r = 1").select("path", "content")
        path = spark._jvm.org.apache.hadoop.fs.Path(index)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        fresh = parsed(files)
        if fs.exists(path):
            fresh = spark.read.schema(PARSED).parquet(index).join(files.select("path"), "path", "left_anti").unionByName(fresh)
        staged = spark._jvm.org.apache.hadoop.fs.Path(index + ".next")
        fresh.write.mode("overwrite").parquet(index + ".next")
        fs.delete(path, True)
        fs.rename(staged, path)

    return f


def watch(spark, root: str, index: str, checkpoint: str, once: bool = True):
    """Start the stream; once: end when all files there are have been read."""
    w = stream_java(ship(spark), root).writeStream.foreachBatch(merge(index)).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime="5 seconds")).start()
