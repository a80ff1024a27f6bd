"""Seeded samples and top-k lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hash_sample(rows: DataFrame, n: int, seed: int = 0, key: str = "contig_id") -> DataFrame:
    """N rows without replacement, those with the lowest seeded hashes; the same whatever the partitions."""
    return rows.withColumn("_h", F.xxhash64(key, F.lit(seed))).orderBy("_h", key).limit(n).drop("_h")


def top(rows: DataFrame, by: Column, n: int, key: str = "contig_id") -> DataFrame:
    """The n rows that rank first, ties by key; only n rows a task are kept and sent."""
    return rows.orderBy(by, key).limit(n)
