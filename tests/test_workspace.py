"""Tables that outlive a stage."""

import os
import time

from pyspark.sql import functions as F

from loamwork.plans.workspace import settled


def _shuffles(spark):
    jvm = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get()
    return {f for top in jvm.blockManager().diskBlockManager().localDirsString() for _, _, names in os.walk(top) for f in names if f.startswith("shuffle_")}


def test_shuffle_files_go_with_their_table(spark):
    """what was shuffled for a settled table doesn't stay beside it."""
    before, d = _shuffles(spark), spark.range(20_000)
    t = settled(d.groupBy((F.col("id") % 700).alias("k")).count().repartition(3, "k"))
    for _ in range(50):
        if not _shuffles(spark) - before:
            break
        time.sleep(0.1)
    assert not _shuffles(spark) - before
    assert t.count() == 700 and t.agg(F.sum("count")).first()[0] == 20_000
