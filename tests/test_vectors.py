"""Column functions on arrays."""

import math
import random

from pyspark.sql import functions as F

from loamwork.functions import vectors as V


def test_norms_and_means_are_computed_once_a_row(spark):
    """with the norm inside the lambda over positions, work grew with the square of the width."""
    rnd = random.Random(8)
    rows = [(i, [rnd.uniform(-2, 2) for _ in range(n)]) for i, n in enumerate((1, 5, 64, 0))] + [(4, [0.0, 0.0]), (5, None)]
    df = spark.createDataFrame(rows, "i int, x array<double>")
    for made, inner in ((V.unit, V.norm), (V.shape, V.mean)):
        plan = df.select(made(F.col("x")).alias("y"))._jdf.queryExecution().analyzed().toString()
        alone = df.select(inner(F.col("x")).alias("y"))._jdf.queryExecution().analyzed().toString()
        assert plan.count("aggregate(") == alone.count("aggregate(")
        slow = df.select("i", F.col("x"), inner(F.col("x")).alias("n")).collect()
        fast = {r.i: r.y for r in df.select("i", made(F.col("x")).alias("y")).collect()}
        for r in slow:
            if r.x is None:
                assert fast[r.i] is None
            elif made is V.unit:
                assert fast[r.i] == [v / (r.n or 1.0) for v in r.x]
            else:
                assert fast[r.i] == [v - r.n for v in r.x]
    assert all(math.isclose(sum(v * v for v in fast), 1) for fast in [r.y for r in df.where("i < 3").select(V.unit(F.col("x")).alias("y")).collect()])


def test_wide_vectors_take_time_by_their_width(spark):
    x = spark.range(64, numPartitions=2).select(F.transform(F.sequence(F.lit(1), F.lit(4000)), lambda v: v.cast("double")).alias("x"))
    assert x.select(V.total(V.unit(F.col("x"))).alias("s")).where("s > 0").count() == 64
