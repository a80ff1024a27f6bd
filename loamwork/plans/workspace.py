"""The folder for tables that outlive a stage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def workspace(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; only a local master without that setting gets a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="loamwork-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


#: What ends an execution's shuffle files with it.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settled(df: DataFrame) -> DataFrame:
    """df written to the workspace and read back, so that lineage ends there; its shuffle files go once the table stands."""
    spark = df.sparkSession
    path, before = workspace(spark), spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Deletes the folders of settled tables that nothing reads any more."""
    for path in {f.rsplit("/", 1)[0] for t in tables for f in t.inputFiles()}:
        spark = tables[0].sparkSession
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


#: Rows of a table that is broadcast at most.
BROADCAST_ROWS = 100_000


def few(table: DataFrame) -> bool:
    """Has the table so few rows that it may be broadcast? Counted, not guessed."""
    return table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
