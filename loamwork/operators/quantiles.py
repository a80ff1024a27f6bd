"""Exact quantiles of groups of any size, without a group's values ever meeting in one buffer.

Doubles become integers of the same order. Four passes narrow every wanted rank, sixteen
bits a pass: rows are counted by group and next sixteen bits, sums run over these counts,
and the bits at which a rank is reached stay. All groups and ranks share the passes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from loamwork.plans.workspace import settled

#: Rows of a group up to which Spark's own percentile, which holds a group's distinct values, is used.
SMALL = 100_000


def _ordered(x: np.ndarray) -> np.ndarray:
    """Bits of doubles as integers in the doubles' order; its own inverse on integers."""
    bits = x.view(np.int64)
    return bits ^ (bits >> 63 & np.int64(0x7FFFFFFFFFFFFFFF))


def _encoded(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys and bits of the rows with a value."""
    x = rows.select(*keys, F.col(value).cast("double").alias("_value")).where("_value IS NOT NULL")
    kind = StructType([*x.schema.fields[:-1], StructField("bits", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bits = _ordered(b.column(b.num_columns - 1).to_numpy() + 0.0)  # -0.0 is 0.0
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(bits)], names=[*b.schema.names[:-1], "bits"])

    return x.mapInArrow(run, kind)


def _decoded(rows: DataFrame) -> DataFrame:
    """rows with value in place of bits, their last column."""
    kind = StructType([*rows.schema.fields[:-1], StructField("value", rows.selectExpr("0D AS x").schema["x"].dataType)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bits = np.ascontiguousarray(b.column(b.num_columns - 1).to_numpy())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(_ordered(bits).view(np.float64))], names=[*b.schema.names[:-1], "value"])

    return rows.mapInArrow(run, kind)


def selected(rows: DataFrame, keys: list[str], value: str, ranks: DataFrame) -> DataFrame:
    """keys, rank, value: the value at each rank (from 0, long) of its group. ranks: keys, rank."""
    bits = settled(_encoded(rows, keys, value))
    wanted = ranks.select(*keys, "rank", F.lit(0).cast("long").alias("below"))
    at = list(keys)
    for shift in (48, 32, 16, 0):
        x = bits.withColumn("next", F.shiftright("bits", shift))
        if "prefix" in wanted.columns:
            at = [*keys, "prefix"]
            x = x.withColumn("prefix", F.shiftright("bits", shift + 16)).join(wanted.select(*at).distinct(), at, "left_semi")
        counts = x.groupBy(*at, "next").agg(F.count("*").alias("n"))
        upto = F.sum("n").over(Window.partitionBy(*at).orderBy("next"))  # 65,536 rows a window at most
        places = counts.withColumn("upto", upto)
        inside = (F.col("rank") < F.col("below") + F.col("upto")) & (F.col("rank") >= F.col("below") + F.col("upto") - F.col("n"))
        wanted = settled(wanted.join(places, at).where(inside).select(*keys, "rank", (F.col("below") + F.col("upto") - F.col("n")).alias("below"), F.col("next").alias("prefix")))
    return _decoded(wanted.select(*keys, "rank", F.col("prefix").alias("bits")))


def quantiles(rows: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Keys and a column a share: the linear quantile of value in each group; nulls are left out.

    Groups are counted: where none has more than SMALL rows, one aggregate does it.
    """
    x = rows.where(F.col(value).isNotNull())
    sizes = settled(x.groupBy(*keys).agg(F.count("*").alias("n")))
    if (sizes.agg(F.max("n")).first()[0] or 0) <= SMALL:
        return x.groupBy(*keys).agg(*(F.percentile(value, s).alias(name) for name, s in shares.items()))
    out = sizes.select(*keys, *((F.col("n") - 1).alias(f"_{name}") * s for name, s in shares.items())).toDF(*keys, *(f"_{name}" for name in shares))
    ends = F.explode(F.array_distinct(F.flatten(F.array(*(F.array(F.floor(f"_{name}"), F.ceil(f"_{name}")) for name in shares)))))
    found = settled(selected(x, keys, value, out.select(*keys, ends.alias("rank"))))
    for name in shares:
        for end, f in (("lo", F.floor), ("hi", F.ceil)):
            side = found.select(*keys, F.col("rank").alias("_rank"), F.col("value").alias(f"{end}_{name}"))
            out = out.withColumn("_rank", f(f"_{name}")).join(side, [*keys, "_rank"]).drop("_rank")
        part = F.col(f"_{name}") - F.floor(f"_{name}")
        out = out.withColumn(name, F.when(F.col(f"lo_{name}") == F.col(f"hi_{name}"), F.col(f"lo_{name}")).otherwise((1 - part) * F.col(f"lo_{name}") + part * F.col(f"hi_{name}")))
    return out.select(*keys, *shares)
