"""Places of rows in the order of a whole table, without a window over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamwork.llm.common import fresh, materialize, parts

_ROW_BITS = 33  # fixed value: monotonically_increasing_id has the partition above so many bits


def ranked(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with a long column of places from 1 in this order.

    Rows are dealt to ranges of the order and sorted there; each range's rows are counted,
    and the counts of the ranges before it (one number a range) are added to the places in it.
    Rows that tie in the whole order get a number besides, so they needn't meet in one task.
    df should be a written table: the ranges are drawn from a sample of it.
    """
    salt, place = fresh(df, "salt"), fresh(df, "place")
    keys = [*order, F.asc(salt)]
    dealt = df.withColumn(salt, F.monotonically_increasing_id()).repartitionByRange(parts(df), *keys).sortWithinPartitions(*keys)
    held = materialize(dealt.drop(salt).withColumn(place, F.monotonically_increasing_id()), "ranked", keep=True)
    part = F.shiftright(place, _ROW_BITS)
    counts = sorted(held.groupBy(part.alias("part")).count().collect())
    before, total = {}, 0
    for p, n in counts:
        before[p] = total
        total += n
    offsets = df.sparkSession.createDataFrame(sorted(before.items()), f"{place}_part long, {place}_before long")
    joined = held.withColumn(f"{place}_part", part).join(F.broadcast(offsets), f"{place}_part")
    return joined.withColumn(name, F.col(f"{place}_before") + F.col(place).bitwiseAND((1 << _ROW_BITS) - 1) + 1).select(*df.columns, name)
