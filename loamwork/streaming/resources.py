"""Resource samples: deltas of counters, statistics of stages, and the same as a stream.

The batch engine has no streaming counterpart; the stream is an extension.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def deltas(samples: DataFrame) -> DataFrame:
    """The growth of each process's counter since its sample before; a reset and the first sample count as 0."""
    before = F.lag("counter").over(Window.partitionBy("pid").orderBy("at_us", "event_id"))
    return samples.withColumn("delta", F.greatest(F.lit(0.0), F.col("counter") - before))


def stage_statistics(samples: DataFrame) -> DataFrame:
    """N, mean, min, p50, p95 (nearest rank, index int(p*(n-1)+0.5)), first and last of each stage.

    Values are ranked in one window by stage; stages are few and their samples many, so
    the ranks come from counts of distinct values.
    """
    by = samples.groupBy("stage", F.col("counter").alias("x")).agg(F.count("*").alias("k"))
    upto = Window.partitionBy("stage").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    r = by.withColumn("last", F.sum("k").over(upto)).withColumn("n", F.sum("k").over(Window.partitionBy("stage")))
    at = lambda p: F.min(F.when(F.col("last") > F.floor(F.lit(p) * (F.col("n") - 1) + 0.5), F.col("x")))
    ranks = r.groupBy("stage").agg(at(0.5).alias("p50"), at(0.95).alias("p95"))
    rest = samples.groupBy("stage").agg(F.count("*").alias("n"), F.avg("counter").alias("mean"), F.min("counter").alias("min"), F.max("counter").alias("max"), F.min_by("counter", F.struct("at_us", "event_id")).alias("first"), F.max_by("counter", F.struct("at_us", "event_id")).alias("last"))
    return rest.join(ranks, "stage")


def stage_shares(samples: DataFrame) -> DataFrame:
    """Seconds between first and last sample of each stage, its share, and whether it is the bottleneck."""
    by = samples.groupBy("stage").agg(((F.max("at_us") - F.min("at_us")) / 1e6).alias("seconds"))
    total = by.agg(F.sum("seconds").alias("all"), F.max("seconds").alias("most"))
    return by.join(F.broadcast(total)).select("stage", "seconds", (F.col("seconds") / F.col("all")).alias("share"), (F.col("seconds") == F.col("most")).alias("bottleneck"))


def stage_changes(values: DataFrame) -> DataFrame:
    """The change of each value from one stage to the next; stages are few."""
    before = F.lag("value").over(Window.partitionBy("metric").orderBy("ord"))
    return values.withColumn("change", (F.col("value") - before) / F.greatest(F.abs(before), F.lit(1e-9)))


def windowed(stream: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Extension: counts and means of each stage by window; rows later than the watermark are dropped."""
    timed = stream.withColumn("at", F.timestamp_micros("at_us")).withWatermark("at", late)
    return timed.groupBy(F.window("at", width), "stage").agg(F.count("*").alias("n"), F.avg("counter").alias("mean")).select(F.col("window.start").alias("start"), "stage", "n", "mean")


def sessions(samples: DataFrame, gap: str = "6 hours") -> DataFrame:
    """Extension: sessions of each process: bursts of samples without a longer gap."""
    timed = samples.withColumn("at", F.timestamp_micros("at_us"))
    return timed.groupBy(F.session_window("at", gap), "pid").agg(F.count("*").alias("n")).select("pid", F.unix_micros("session_window.start").alias("start_us"), "n")
