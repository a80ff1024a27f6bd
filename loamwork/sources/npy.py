"""NumPy matrices as a data source: tasks read ranges of rows, and write files that appear on commit."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, WriterCommitMessage
from pyspark.sql.types import StructType

from loamwork.sources.ranges import RANGE_BYTES, Range, cut, listed, located, qualified

_BATCH_ROWS = 4096


def _header(raw) -> tuple[tuple[int, ...], bool, np.dtype]:
    """Shape, column order and type from the first bytes of a file; the stream then stands at its values."""
    version = np.lib.format.read_magic(raw)
    read = {(1, 0): np.lib.format.read_array_header_1_0, (2, 0): np.lib.format.read_array_header_2_0}.get(version)
    if not read:
        raise ValueError(f"NumPy format {version} can't be read")
    shape, by_columns, kind = read(raw)
    if kind.hasobject or not shape:
        raise ValueError("only arrays of numbers with rows can be read")
    return shape, by_columns and len(shape) > 1, kind


class NpyReader(DataSourceReader):
    """Cuts matrices into ranges of rows by their headers; one that is stored by columns is a single task's work."""

    def __init__(self, options: dict):
        self.path, self.most = options["path"], int(options.get("partitionBytes", RANGE_BYTES))

    def partitions(self) -> list[Range]:
        out = []
        for path, _ in listed(self.path):
            system, place = located(path)
            with system.open_input_file(place) as raw:
                shape, by_columns, kind = _header(raw)
            row = max(1, int(np.prod(shape[1:])) * kind.itemsize)
            out += cut(path, shape[0], shape[0] if by_columns else max(1, self.most // row))
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        system, place = located(partition.path)
        with system.open_input_file(place) as raw:
            shape, by_columns, kind = _header(raw)
            width = int(np.prod(shape[1:]))
            whole = np.frombuffer(raw.read(), kind).reshape(shape, order="F").reshape(shape[0], width) if by_columns else None
            if whole is None:
                raw.seek(raw.tell() + partition.start * width * kind.itemsize)
            for at in range(partition.start, partition.end, _BATCH_ROWS):
                n = min(_BATCH_ROWS, partition.end - at)
                some = whole[at : at + n] if whole is not None else np.frombuffer(raw.read(n * width * kind.itemsize), kind).reshape(n, width)
                flat = pa.array(np.ascontiguousarray(some, np.float64).ravel())
                rows = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), flat)
                yield pa.RecordBatch.from_arrays([pa.array([partition.path] * n), pa.array(np.arange(at, at + n)), rows], names=["file", "ord", "vec"])


@dataclass
class Written(WriterCommitMessage):
    """Files that a task wrote."""

    names: list[str]


class NpyWriter(DataSourceArrowWriter):
    """Writes matrices of at most fileBytes below a hidden folder; the commit moves them to their place.

    Files from before go on commit only (where the mode is overwrite). A write that fails
    leaves them as they are, and a repeated task's files never meet those of its other attempts.
    """

    def __init__(self, schema: StructType, options: dict, overwrite: bool):
        if schema.names != ["vec"]:
            raise ValueError("a matrix is written from one column vec of equally long arrays")
        self.path, self.overwrite, self.most = options["path"].rstrip("/"), overwrite, int(options.get("fileBytes", RANGE_BYTES))
        self.batch = f"_writing-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, place = located(self.path)
        system.create_dir(f"{place}/{self.batch}", recursive=True)
        task, names, held, size, width = TaskContext.get(), [], [], 0, None

        def flush() -> None:
            name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{len(names):05d}.npy"
            with system.open_output_stream(f"{place}/{self.batch}/{name}") as out:
                np.lib.format.write_array_header_1_0(out, {"descr": "<f8", "fortran_order": False, "shape": (sum(map(len, held)), width)})
                for x in held:
                    out.write(np.ascontiguousarray(x, "<f8").tobytes())
            names.append(name)

        for batch in iterator:
            if not batch.num_rows:
                continue
            column = batch.column("vec")
            lengths = set(column.value_lengths().to_pylist())
            width = width if width is not None else next(iter(lengths))
            if lengths != {width} or column.flatten().null_count:
                raise ValueError("a matrix needs equally long rows without nulls")
            values = column.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)
            most = max(1, self.most // max(8, 8 * width))  # rows of a file
            while len(values):
                some, values = values[: most - size], values[most - size :]
                held.append(some)
                size += len(some)
                if size == most:
                    flush()
                    held, size = [], 0
        if held:
            flush()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        system, place = located(self.path)
        earlier = [located(p)[1] for p, _ in listed(self.path) if p.endswith(".npy")] if self.overwrite else []
        for message in messages:
            for name in message.names if message else []:
                system.move(f"{place}/{self.batch}/{name}", f"{place}/{self.batch[1:]}-{name}")
        for old in earlier:
            system.delete_file(old)
        system.delete_dir(f"{place}/{self.batch}")

    def abort(self, messages: list[Written | None]) -> None:
        system, place = located(self.path)
        system.delete_dir_contents(f"{place}/{self.batch}", missing_dir_ok=True)


class NpySource(DataSource):
    """file, ord and vec of .npy matrices, ord being a row's place in its file; written from a column vec."""

    @classmethod
    def name(cls) -> str:
        return "loamwork_npy"

    def schema(self) -> str:
        return "file string, ord long, vec array<double>"

    def reader(self, schema: StructType) -> NpyReader:
        return NpyReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> NpyWriter:
        return NpyWriter(schema, self.options, overwrite)


def read_npy(spark: SparkSession, path: str, partition_bytes: int = RANGE_BYTES) -> DataFrame:
    """File, ord, vec of a .npy matrix or a folder of them, read by ranges of rows; a manifest maps ord to an id."""
    spark.dataSource.register(NpySource)
    return spark.read.format("loamwork_npy").option("partitionBytes", partition_bytes).load(qualified(spark, path))


def write_npy(rows: DataFrame, path: str, overwrite: bool = True, file_bytes: int = RANGE_BYTES) -> None:
    """Rows' vec (array<double>, equally long) as .npy files of a folder."""
    rows.sparkSession.dataSource.register(NpySource)
    rows.select("vec").write.format("loamwork_npy").option("fileBytes", file_bytes).mode("overwrite" if overwrite else "append").save(qualified(rows.sparkSession, path))
