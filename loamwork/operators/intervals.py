"""Half-open intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merged_spans(rows: DataFrame, key: str = "contig_id") -> DataFrame:
    """key, spans: the sorted array of half-open intervals (lo, hi) after merging those that overlap or touch."""
    order = Window.partitionBy(key).orderBy("lo", "hi")
    before = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = rows.where("lo < hi").select(key, "lo", "hi", F.coalesce(F.col("lo") > before, F.lit(True)).cast("int").alias("opens"))
    numbered = opened.withColumn("island", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    spans = numbered.groupBy(key, "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return spans.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("spans"))
