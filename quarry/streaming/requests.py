"""Structured Streaming over the request log: hourly series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import analytics
from quarry.session import scratch_path


def _is_folder(spark: SparkSession, path: str) -> bool:
    """Asked of the path's own file system, which may be one that only Spark reaches."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getFileStatus(found).isDirectory()


def read_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table, a single file or a folder of part files, as a stream."""
    path = f"{folder}/{name}"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    # A stream reads folders; the filter takes names of files, so it can pick a single file but not a table's part files.
    return reader.parquet(path) if _is_folder(spark, path) else reader.option("pathGlobFilter", name).parquet(folder)


def read_log(spark: SparkSession, folder: str, name: str = "events.parquet") -> DataFrame:
    """The events of a table as a stream of requests, with timestamps that watermarks accept."""
    log = analytics.request_log(read_stream(spark, folder, name))
    return log.withColumn("created_at", F.col("created_at").cast("timestamp"))


def hourly_stream(log: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Requests, errors, cache hits and latencies of each hour, as a stream."""
    hours = log.withWatermark("created_at", lateness).groupBy(F.window("created_at", "1 hour").alias("w"))
    return hours.agg(
        F.count(F.lit(1)).alias("requests"),
        F.count_if(F.col("status_code") >= 400).alias("errors"),
        F.count_if("cache_hit").alias("cache_hits"),
        F.round(F.max("latency_ms"), 1).alias("max_ms"),
    ).select(F.col("w.start").alias("hour"), "requests", "errors", "cache_hits", "max_ms")


def run_to_end(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Everything the stream has now, run to its end. In complete mode each batch replaces the result, so windows still open are in it."""
    spark = stream.sparkSession
    out, state = scratch_path(spark, "stream"), scratch_path(spark, "stream-state")
    save = "overwrite" if mode == "complete" else "append"

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode(save).parquet(out)

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
