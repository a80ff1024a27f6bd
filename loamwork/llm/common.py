"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows handled at once inside a worker, whatever the Arrow batch holds.
SLICE_ROWS = 512
#: Bytes of input files for each part of an explicit shuffle.
PART_BYTES = 10 << 20
#: Parts of an explicit shuffle at most; beyond it each part grows with the input.
MOST_PARTS = 200_000
#: Largest Arrow batch between the JVM and Python; rows are never split, so one long text may exceed it.
BATCH_BYTES = 4 << 20
#: Largest number of ids that is broadcast; beyond it joins shuffle.
BROADCAST_IDS = 1_000_000


def bounded(spark: SparkSession) -> None:
    """Lowers the session's Arrow batch size to BATCH_BYTES, so that memory doesn't follow the length of texts."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels table."""
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark table."""
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, with its scheme; a temporary one only for local masters without a setting."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if known:  # a path without a scheme lies in Spark's default file system, whoever writes there
        place = spark._jvm.org.apache.hadoop.fs.Path(known)
        return place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toString().rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="loamwork-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


_scopes: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that materialize() writes inside are deleted at the end, except those with keep."""
    _scopes.append([])
    try:
        yield
    finally:
        drop_tables(spark, _scopes.pop())


def materialize(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it back; later stages survive lost executors."""
    bounded(df.sparkSession)
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if scopes := _scopes[:-1] if keep else _scopes:
        scopes[-1].append(path)
    else:
        _finished.add(path)
    with _setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):  # the table stands, its shuffle files go
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def _setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """Sets a session setting for a while."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


_finished: set[str] = set()


def keep_until_cleanup(path: str) -> None:
    """Leaves a folder to cleanup()."""
    _finished.add(path)


def drop_tables(spark: SparkSession, paths: list[str]) -> None:
    """Deletes tables that materialize() wrote."""
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def cleanup(spark: SparkSession) -> None:
    """Deletes the tables that results of this session are read from (joined classes, spans, files, shards, stages).

    Call it once the results have been written or consumed; they can't be read afterwards.
    """
    drop_tables(spark, sorted(_finished))
    _finished.clear()


def parts(docs: DataFrame) -> int:
    """Into how many parts to deal what is made of docs: one for PART_BYTES of input files; the session's number where their size isn't known."""
    known = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return min(max(4, known // PART_BYTES), MOST_PARTS) if known < 1 << 56 else max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, made from name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


_KEPT: dict = {}


def kept(key: tuple, build: Callable):
    """What build() makes, kept by the worker process for later tasks that ask for the same key; there is one such thing a worker."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = build()
    return _KEPT[key]


def forget(key: tuple | None) -> None:
    """Drops what the worker keeps, unless it is of this key."""
    if key not in _KEPT:
        _KEPT.clear()


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], key: tuple | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow. A task starts without what other work left in its reused worker, and gives its memory back at its end."""

    def tidied(batches):
        forget(key)
        yield from run(batches)
        trim()

    return tidied


def trim() -> None:
    """Gives memory that a finished task held back to the system; a reused worker starts the next one small."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches into slices of a bounded number of rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def map_slices(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict]], schema: str, rows: int = SLICE_ROWS, key: tuple | None = None) -> DataFrame:
    """Applies make()'s function to slices of df. It returns a dict of columns, and make runs once per task; key is of what it keeps."""
    bounded(df.sparkSession)
    arrow = arrow_schema(schema)

    def run(batches):
        apply = make()
        for part in slices(batches, rows):
            yield pa.RecordBatch.from_pydict(apply(part), schema=arrow)

    return df.mapInArrow(tidy(run, key), schema)


def append_columns(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict]], added: str, replaced: tuple[str, ...] = ()) -> DataFrame:
    """df with the columns that make()'s function returns added at its end; all other columns pass through.

    An added column takes the place of one of df with the same name. replaced names columns of df that the function returns anew in their place.
    """
    bounded(df.sparkSession)
    extra = arrow_schema(added) if added else pa.schema([])
    df = df.drop(*(n for n in extra.names if n not in replaced))

    def run(batches):
        apply = make()
        for part in slices(batches):
            new = apply(part)
            columns = [pa.array(new[c], part.schema.field(c).type) if c in replaced else part.column(i) for i, c in enumerate(part.schema.names)]
            columns += [pa.array(new[f.name], f.type) for f in extra]
            yield pa.RecordBatch.from_arrays(columns, names=[*part.schema.names, *extra.names])

    fields = [*df.schema.fields, *(StructType.fromDDL(added).fields if added else [])]
    return df.mapInArrow(tidy(run), StructType(fields))


def few(ids: DataFrame) -> bool:
    """Are there so few rows that they may be broadcast? Counted, not guessed."""
    return ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS


def with_flag(df: DataFrame, ids: DataFrame, key: str, flag: str) -> DataFrame:
    """df with a boolean column: is its key among ids? Ids are broadcast only below BROADCAST_IDS rows."""
    marked = ids.select(F.col(key)).where(F.col(key).isNotNull()).distinct().withColumn(flag, F.lit(True))
    joined = df.join(F.broadcast(marked) if few(marked) else marked, key, "left")
    return joined.withColumn(flag, F.coalesce(flag, F.lit(False)))


_ARROW = {"long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "float": pa.float32(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow schema of a flat DDL string; array<x> is allowed."""

    def kind(name: str) -> pa.DataType:
        return pa.list_(kind(name[6:-1])) if name.startswith("array<") else _ARROW[name]

    return pa.schema([(c.split()[0], kind(c.split()[1])) for c in ddl.split(",")])


def texts_of(part: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a slice; null becomes the empty text."""
    return [t or "" for t in part.column(column).to_pylist()]


def check_columns(df: DataFrame, *names: str) -> None:
    """Fails early, with a clear message, when a needed column is missing or doc_id holds no whole numbers."""
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")
    if "doc_id" in names and (kind := dict(df.dtypes)["doc_id"]) not in ("tinyint", "smallint", "int", "bigint", "void"):
        raise ValueError(f"doc_id has to hold whole numbers; it is {kind}")
