"""Analytics over a request log: totals, hourly series, stages, cache, cost. One pass each, all exact.

The window of the last N hours is anchored at a time given as a column or at the newest row, never at the clock.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import answer_cost


#: Microseconds of a slice of an asker's requests: an hour.
SLICE = 3_600_000_000


def request_log(events: DataFrame) -> DataFrame:
    """The request log that the event stream stands for."""
    k = F.get_json_object("props", "$.k").cast("long")
    return events.select(
        F.col("event_id").alias("id"),
        F.col("ts").alias("created_at"),
        F.concat(F.lit("q"), F.col("user_id")).alias("query"),
        F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status_code"),
        F.col("value").alias("latency_ms"),
        (F.col("event_type") == "view").alias("cache_hit"),
        k.alias("tokens_input"),
        (k * 2).alias("tokens_output"),
        F.col("props").alias("stages"),
    )


def last_hours(log: DataFrame, hours: int) -> DataFrame:
    """Rows of the last `hours` (1 to 720) before the newest row."""
    if not 1 <= hours <= 720:
        raise ValueError("hours must be from 1 to 720")
    newest = log.agg(F.max("created_at")).first()[0]  # one value, so that the scan can leave out files and row groups by it
    return log.where(F.col("created_at") >= F.lit(newest) - F.expr(f"INTERVAL {int(hours)} HOURS")) if newest else log


def _share(part: Column, whole: Column) -> Column:
    return F.round(F.coalesce(part.cast("double") / F.nullif(whole, F.lit(0)), F.lit(0.0)), 4)


def _tenths(ms: Column) -> Column:
    """Rounded to tenths by way of millionths, so that the last bits of an interpolation do not decide."""
    return F.round(F.round(ms, 6), 1)


def latency_bin(v: Column) -> Column:
    """The number of a value's bin: 64 for each doubling, so that a bin is about a hundredth of its values wide; signs apart, and 0 alone."""
    magnitude = F.floor(F.log2(F.abs(v.cast("double"))) * 64)
    return F.when(v > 0, magnitude + 100_000).when(v < 0, -magnitude - 100_000).when(v == 0, F.lit(0)).cast("long")


def percentiles(frame: DataFrame, keys: list[str], value: str, shares: tuple[float, ...]) -> DataFrame:
    """(*keys, p: array of the exact, interpolated percentiles of value). Keys and values that are null are left out.

    No task holds all values. They are counted in bins of a hundredth, a few thousand a key whatever the table; only the bins in which a percentile falls are
    read value by value. Those are two for each key and share; where they are few they are broadcast, so that the second pass moves nothing but its counts.
    """
    own = frame.where(" and ".join(f"{c} is not null" for c in [value, *keys])).select(*keys, F.col(value).cast("double").alias("__v"))
    own = own.withColumn("__bin", F.coalesce(latency_bin(F.col("__v")), F.lit(0)))
    # Bins in order, with their counts, as one array a key.
    bins = own.groupBy(*keys, "__bin").agg(F.count(F.lit(1)).alias("c")).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("__bin", "c"))).alias("bins"), F.sum("c").alias("n"))
    upto = F.aggregate("bins", F.array().cast("array<bigint>"), lambda acc, b: F.array_append(acc, F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + b["c"]))
    place = lambda s: F.lit(float(s)) * (F.col("n") - 1)

    def bin_of(at: Column) -> Column:
        k = F.size(F.filter("upto", lambda u: u <= at))
        return F.struct(F.get("bins", k)["__bin"].alias("__bin"), (at - F.coalesce(F.get("upto", k - 1), F.lit(0))).alias("at"))

    wanted = F.array(*(F.struct(F.lit(i).alias("i"), (place(s) - F.floor(place(s))).alias("part"), side.alias("w")) for i, s in enumerate(shares) for side in (bin_of(F.floor(place(s))), bin_of(F.ceil(place(s))))))
    asked = bins.withColumn("upto", upto).select(*keys, F.explode(wanted).alias("x")).select(*keys, "x.i", "x.part", "x.w.*").distinct()
    of_bin = [*keys, "__bin"]
    some = asked.select(*of_bin).distinct()
    values = own.join(some, of_bin, "left_semi").groupBy(*of_bin, "__v").agg(F.count(F.lit(1)).alias("c"))
    values = values.withColumn("last", F.sum("c").over(Window.partitionBy(*of_bin).orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)))
    found = asked.join(values, of_bin).where("last - c <= at and at < last")
    low, high = F.min("__v"), F.max("__v")
    each = found.groupBy(*keys, "i").agg((low + (high - low) * F.max("part")).alias("x"))
    ordered = each.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("xs"))
    return ordered.select(*keys, F.transform("xs", lambda s: s["x"]).alias("p"))


def totals(log: DataFrame) -> DataFrame:
    """One row of counts, latencies, tokens and cost; zeros for an empty log."""
    flat = log.agg(
        F.count(F.lit(1)).alias("requests"),
        *(F.round(F.coalesce(f("latency_ms"), F.lit(0.0)), 1).alias(f"{n}_ms") for n, f in (("avg", F.avg), ("min", F.min), ("max", F.max))),
        F.count_if(F.col("status_code") >= 400).alias("errors"),
        F.count_if("cache_hit").alias("cache_hits"),
        F.coalesce(F.sum("tokens_input"), F.lit(0)).alias("tokens_input"),
        F.coalesce(F.sum("tokens_output"), F.lit(0)).alias("tokens_output"),
    )
    flat = flat.join(percentiles(log.withColumn("__all", F.lit(0)), ["__all"], "latency_ms", (0.5, 0.9, 0.95, 0.99)), F.lit(True), "left")  # one row by one
    named = [_tenths(F.coalesce(F.get("p", F.lit(i)), F.lit(0.0))).alias(f"p{q}_ms") for i, q in enumerate((50, 90, 95, 99))]
    cost = answer_cost(F.col("tokens_input"), F.col("tokens_output"))
    return flat.select(
        "requests", "avg_ms", "min_ms", "max_ms", *named, "errors", "cache_hits", "tokens_input", "tokens_output",
        _share(F.col("errors"), F.col("requests")).alias("error_rate"),
        F.round(cost, 6).alias("cost_usd"),
        F.round(F.coalesce(cost / F.nullif(F.col("requests"), F.lit(0)), F.lit(0.0)), 6).alias("cost_per_request"),
    )


def hourly(log: DataFrame) -> DataFrame:
    """Hours that have rows."""
    timed = log.withColumn("hour", F.date_trunc("HOUR", "created_at"))
    counts = timed.groupBy("hour").agg(
        F.count(F.lit(1)).alias("requests"),
        _share(F.count_if(F.col("status_code") >= 400), F.count(F.lit(1))).alias("error_rate"),
        _share(F.count_if("cache_hit"), F.count(F.lit(1))).alias("cache_hit_rate"),
    )
    slow = percentiles(timed, ["hour"], "latency_ms", (0.95,))
    return counts.join(slow, "hour", "left").select("hour", "requests", _tenths(F.get("p", F.lit(0))).alias("p95_ms"), "error_rate", "cache_hit_rate")


def stages(log: DataFrame) -> DataFrame:
    """Percentiles by stage, and each stage's share of the sum of medians, slowest first."""
    one = log.where("stages is not null").select(F.explode(F.from_json("stages", "map<string,string>")).alias("stage", "ms")).withColumn("ms", F.col("ms").try_cast("double"))
    by = percentiles(one, ["stage"], "ms", (0.5, 0.95)).join(one.groupBy("stage").agg(F.count(F.lit(1)).alias("samples")), "stage")
    # A row per stage name: this window is over the few stages there are.
    share = F.col("p")[0] / F.nullif(F.sum(F.col("p")[0]).over(Window.partitionBy()), F.lit(0.0))
    return by.select("stage", _tenths(F.col("p")[0]).alias("p50_ms"), _tenths(F.col("p")[1]).alias("p95_ms"), "samples", F.round(share, 4).alias("share")).orderBy(F.desc("p50_ms"), "stage")


def cache_summary(log: DataFrame) -> DataFrame:
    done = log.where("status_code < 400").agg(F.count_if("cache_hit").alias("hits"), F.count(F.lit(1)).alias("lookups"))
    return done.select("hits", "lookups", _share(F.col("hits"), F.col("lookups")).alias("hit_rate"))


def slowest(log: DataFrame, n: int = 5) -> DataFrame:
    return log.orderBy(F.desc("latency_ms"), "id").limit(n).select("id", "query", F.round("latency_ms").alias("latency_ms"), "status_code")


def repeated_questions(log: DataFrame, least: int = 2) -> DataFrame:
    return log.groupBy("query").agg(F.count(F.lit(1)).alias("asked")).where(F.col("asked") >= least)


def rate_limited(log: DataFrame, per_minute: int = 10) -> DataFrame:
    """Every request with how many its asker made in the 60 seconds up to it, and whether that is allowed."""
    # An asker's time is cut into slices, so one with very many requests is not one task; rows of the last minute of a slice count in the next one too.
    minute = Window.partitionBy("query", "slice").orderBy("us").rangeBetween(-59_999_999, 0)
    timed = log.select("id", "query", F.unix_micros(F.col("created_at").cast("timestamp")).alias("us"))
    own = F.floor(F.col("us") / SLICE)
    both = F.when(F.pmod("us", F.lit(SLICE)) >= SLICE - 60_000_000, F.array(own, own + 1)).otherwise(F.array(own))
    dealt = timed.select("*", own.alias("own"), F.explode(both).alias("slice")).withColumn("recent", F.count(F.lit(1)).over(minute))
    return dealt.where("slice = own").select("id", "query", "recent", (F.col("recent") <= per_minute).alias("allowed"))


def outcomes(log: DataFrame) -> DataFrame:
    """Requests by outcome: ok, limited, cancelled or failed."""
    code = F.col("status_code")
    outcome = F.when(code < 400, "ok").when(code == 429, "limited").when(code == 499, "cancelled").otherwise("failed")
    return log.groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))
