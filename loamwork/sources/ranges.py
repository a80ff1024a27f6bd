"""Files of any file system that Arrow knows, and the ranges of them that tasks read."""

from __future__ import annotations

from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import InputPartition

#: Bytes of a file that one task reads, unless an option says otherwise.
RANGE_BYTES = 64 << 20


@dataclass
class Range(InputPartition):
    """Items of a file from start up to end: bytes or rows, as the source counts."""

    path: str
    start: int
    end: int


def qualified(spark: SparkSession, path: str) -> str:
    """path with the scheme that Spark itself would use, so that tasks open it in the same file system."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toString()


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a URI (file, hdfs, s3, ...) or a plain path."""
    if path.startswith("file:/"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def listed(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file, or of a folder's files in order of their names; hidden ones and folders are left out."""
    system, place = located(path)
    info = system.get_file_info(place)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    files = [info] if info.type == fs.FileType.File else [f for f in system.get_file_info(fs.FileSelector(place)) if f.type == fs.FileType.File and f.base_name[0] not in "._"]
    root = path.rstrip("/")
    return sorted((path if info.type == fs.FileType.File else f"{root}/{f.base_name}", f.size) for f in files)


def cut(path: str, items: int, most: int) -> list[Range]:
    """Ranges of at most so many items that make up 0 to items."""
    return [Range(path, at, min(at + most, items)) for at in range(0, items, max(1, most))]
