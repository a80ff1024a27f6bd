"""Places and running sums in the order of a whole table, without a window over all of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamwork.plans.workspace import settled


def running(rows: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """rows with the running sum of each expression of sums, in this order; F.lit(1) gives places from 1.

    Rows are dealt to ranges of the order; each range has one row of totals, and the totals
    of the ranges before it are added to the running sums inside it. No two rows may tie in
    the order (count equal rows first), and no column may be named like a sum.
    """
    named = rows.select("*", *(x.alias(name) for name, x in sums.items()))
    dealt = settled(named.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    totals = dealt.groupBy("_range").agg(*(F.sum(name).alias(f"_{name}") for name in sums))
    offsets = totals.select("_range", *(F.coalesce(F.sum(f"_{name}").over(before), F.lit(0)).alias(f"_{name}") for name in sums))
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = dealt.join(F.broadcast(offsets), "_range")  # a row a range
    return joined.select(*rows.columns, *((F.sum(name).over(inside) + F.col(f"_{name}")).alias(name) for name in sums))
