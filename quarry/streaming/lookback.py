"""Look-backs of any number of hours over a request log, merged from counts that a stream keeps by hour and latency bin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions.text import answer_cost
from quarry.operators.analytics import latency_bin

HOURS = (1, 24, 168)
KEPT = (
    "hour timestamp, bin long, requests long, errors long, cache_hits long, latency_sum double, latency_n long, latency_min double, latency_max double, "
    "tokens_input long, tokens_output long"
)


def hourly_parts(log: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """What a log, a table or a stream, adds up to by hour and bin of its latency; some thousand rows an hour at most, whatever its requests."""
    timed = log.where("created_at is not null").withColumn("created_at", F.col("created_at").cast("timestamp"))
    timed = timed.withWatermark("created_at", lateness) if log.isStreaming else timed
    total = lambda name: F.coalesce(F.sum(name), F.lit(0)).alias(name)
    parts = timed.groupBy(F.window("created_at", "1 hour").alias("w"), latency_bin(F.col("latency_ms")).alias("bin")).agg(
        F.count(F.lit(1)).alias("requests"),
        F.count_if(F.col("status_code") >= 400).alias("errors"),
        F.count_if("cache_hit").alias("cache_hits"),
        F.coalesce(F.sum("latency_ms"), F.lit(0.0)).alias("latency_sum"),
        F.count("latency_ms").alias("latency_n"),
        F.min("latency_ms").alias("latency_min"),
        F.max("latency_ms").alias("latency_max"),
        total("tokens_input"),
        total("tokens_output"),
    )
    return parts.select(F.col("w.start").alias("hour"), "bin", *(c for c in parts.columns if c not in ("w", "bin")))


def keep_hourly(log: DataFrame, path: str, checkpoint: str) -> None:
    """Takes what a stream of requests has now into the table of hourly parts at `path`.

    A batch writes the parts that it changed, as they stand after it, in a folder of its number; given again after a break, it replaces that folder.
    """

    def save(batch: DataFrame, number: int) -> None:
        numbered = batch.withColumn("batch", F.lit(number))
        numbered.write.option("partitionOverwriteMode", "dynamic").partitionBy("batch").mode("overwrite").parquet(path)

    query = hourly_parts(log).writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(save).start()
    query.awaitTermination()


def read_hourly(spark: SparkSession, path: str) -> DataFrame:
    """The hourly parts as the newest batch of each left them."""
    written = spark.read.schema(f"{KEPT}, batch long").parquet(path)
    values = [c for c in written.columns if c not in ("hour", "bin", "batch")]
    newest = written.groupBy("hour", "bin").agg(F.max_by(F.struct(*values), "batch").alias("p"))
    return newest.select("hour", "bin", "p.*")


def upper_edge(of_bin: Column) -> Column:
    """The latency that a bin ends at, a hundredth above that it begins at."""
    size = F.pow(F.lit(2.0), (F.abs(of_bin) - 100_000 + F.when(of_bin > 0, 1).otherwise(0)) / 64)
    return F.round(F.when(of_bin > 0, size).when(of_bin < 0, -size).otherwise(F.lit(0.0)), 2)


def look_backs(parts: DataFrame, hours: tuple[int, ...] = HOURS, shares: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """A row for each number of hours up to and with the newest one of the parts: counts, latencies, tokens and cost. Percentiles are the ends of their bins."""
    newest = parts.agg(F.max("hour").alias("newest"))
    backs = F.explode(F.array(*(F.lit(h) for h in hours))).alias("hours")
    own = parts.crossJoin(F.broadcast(newest)).select("*", backs).where("hour > newest - make_dt_interval(0, hours)")  # one row
    totals = own.groupBy("hours").agg(
        *(F.sum(c).alias(c) for c in ("requests", "errors", "cache_hits", "latency_sum", "latency_n", "tokens_input", "tokens_output")), F.min("latency_min").alias("min"), F.max("latency_max").alias("max")
    )
    bins = own.where("bin is not null").groupBy("hours", "bin").agg(F.sum("latency_n").alias("c"))
    # A window over the bins of a look-back, a few thousand.
    ranked = bins.withColumn("upto", F.sum("c").over(Window.partitionBy("hours").orderBy("bin"))).withColumn("n", F.sum("c").over(Window.partitionBy("hours")))
    at = [F.min(F.when(F.col("upto") >= F.ceil(F.col("n") * s), F.col("bin"))).alias(f"b{i}") for i, s in enumerate(shares)]
    points = ranked.groupBy(F.col("hours").alias("of")).agg(*at)
    joined = totals.join(points, F.col("hours") == F.col("of"), "left")
    cost = answer_cost(F.col("tokens_input"), F.col("tokens_output"))
    return joined.select(
        "hours", "requests", "errors", "cache_hits", F.round(F.col("latency_sum") / F.nullif(F.col("latency_n"), F.lit(0)), 1).alias("avg_ms"), F.round("min", 1).alias("min_ms"), F.round("max", 1).alias("max_ms"),
        *(upper_edge(F.col(f"b{i}")).alias(f"p{round(100 * s)}_ms") for i, s in enumerate(shares)),
        "tokens_input", "tokens_output", F.round(cost, 6).alias("cost_usd"),
    )
