"""FASTQ as a data source: tasks read byte ranges of a file, each from the first record that starts in its range."""

from __future__ import annotations

import gzip
import hashlib
import io
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader
from pyspark.sql.types import StructType

from loamwork.sources.ranges import RANGE_BYTES, Range, cut, listed, located, qualified

FIELDS = "read_id string, seq string, quality string, file string"
BATCH_BYTES = 4 << 20


def chosen(files: list[tuple[str, int]], most: int, seed: int) -> list[tuple[str, int]]:
    """At most so many files (0: all), those with the lowest seeded hashes; the same wherever the list is made."""
    if not most:
        return files
    return sorted(files, key=lambda f: hashlib.sha256(f"{seed}:{f[0].rsplit('/', 1)[-1]}".encode()).digest())[:most]


def records(stream: io.BufferedIOBase, start: int, end: int, name: str) -> Iterator[tuple[str, str, str]]:
    """(id, sequence, quality) of the records whose '@' lies in [start, end) of a stream.

    A range that doesn't begin the file looks for a line with '@' and '+' two lines on. A
    quality line may begin with '@', but then two lines on stands a sequence, so this is exact.
    Blank lines between records are skipped; reads may be empty.
    """
    held: deque[tuple[int, bytes]] = deque()
    at = start
    if start:
        stream.seek(start - 1)
        at += len(stream.readline()) - 1

    def line(i: int) -> bytes:
        nonlocal at
        while len(held) <= i:
            got = stream.readline()
            held.append((at, got))
            at += len(got)
        return held[i][1].rstrip(b"\r\n")

    found = not start
    while True:
        head, (offset, raw) = line(0), held[0]
        if not raw or offset >= end:
            return
        if not head or not (found or head.startswith(b"@") and line(2).startswith(b"+")):
            held.popleft()
            continue
        seq, plus, quality = line(1), line(2), line(3)
        if not head.startswith(b"@") or not plus.startswith(b"+") or len(seq) != len(quality):
            raise ValueError(f"{name} holds no whole FASTQ record at byte {offset}")
        found = True
        held.clear()
        yield (head[1:].split() or [b""])[0].decode("utf-8", "replace"), seq.decode("utf-8", "replace"), quality.decode("utf-8", "replace")


class FastqReader(DataSourceReader):
    """Cuts files into ranges of partitionBytes; files, seed and reads make it a sniff of some files' first reads."""

    def __init__(self, schema: StructType, options: dict):
        self.names, self.path = schema.names, options["path"]
        self.most = int(options.get("partitionBytes", RANGE_BYTES))
        self.files, self.seed, self.reads = (int(options.get(k, 0)) for k in ("files", "seed", "reads"))

    def partitions(self) -> list[Range]:
        out = []
        for path, size in chosen(listed(self.path), self.files, self.seed):
            whole = path.endswith(".gz") or self.reads  # neither can start in the middle
            out += [Range(path, 0, 1 << 62)] if whole else cut(path, size, self.most)
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        system, place = located(partition.path)
        with system.open_input_file(place) as raw:
            stream = gzip.GzipFile(fileobj=raw) if partition.path.endswith(".gz") else io.BufferedReader(raw, 1 << 20)
            rows, size = [], 0
            for k, row in enumerate(records(stream, partition.start, partition.end, partition.path)):
                if self.reads and k == self.reads:
                    break
                rows.append((*row, partition.path))
                size += len(row[1])
                if size >= BATCH_BYTES or len(rows) >= 10_000:
                    yield self._batch(rows)
                    rows, size = [], 0
            if rows:
                yield self._batch(rows)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        columns = dict(zip(("read_id", "seq", "quality", "file"), zip(*rows, strict=True), strict=True))
        return pa.RecordBatch.from_arrays([pa.array(columns[n], pa.string()) for n in self.names], names=self.names)


class FastqSource(DataSource):
    """read_id, seq, quality, file of a FASTQ file or a folder of them; a schema of fewer columns builds only those."""

    @classmethod
    def name(cls) -> str:
        return "loamwork_fastq"

    def schema(self) -> str:
        return FIELDS

    def reader(self, schema: StructType) -> FastqReader:
        return FastqReader(schema, self.options)


def read_fastq(spark: SparkSession, path: str, reads: int = 0, files: int = 0, seed: int = 0, columns: str = FIELDS, partition_bytes: int = RANGE_BYTES) -> DataFrame:
    """All reads of a file or folder, by ranges of bytes (a .gz file by one task).

    A6: with reads, the first so many of each file; with files, of that many files, chosen by seed.
    """
    spark.dataSource.register(FastqSource)
    options = {"reads": reads, "files": files, "seed": seed, "partitionBytes": partition_bytes}
    return spark.read.format("loamwork_fastq").schema(columns).options(**options).load(qualified(spark, path))


def write_fastq(reads: DataFrame, path: str) -> None:
    """Reads (read_id, seq, quality) as FASTQ of four lines each."""
    reads.select(F.concat(F.lit("@"), "read_id", F.lit("\n"), "seq", F.lit("\n+\n"), "quality").alias("value")).write.text(path)


def read_type(reads: DataFrame, key: str = "sample") -> DataFrame:
    """Mean length, mean Phred+33 quality (of first letters' codes over each read) and the type of each sample."""
    phred = F.aggregate(F.split("quality", ""), F.lit(0.0), lambda s, c: s + F.when(c == "", 0.0).otherwise(F.ascii(c) - 33.0)) / F.greatest(F.length("quality"), F.lit(1))
    x = reads.select(key, F.length("seq").alias("n"), phred.alias("q")).groupBy(key).agg(F.avg("n").alias("mean_length"), F.avg("q").alias("mean_quality"))
    kind = F.when(F.col("mean_length") < 500, "short").when((F.col("mean_quality") >= 30) & (F.col("mean_length") >= 5000), "hifi").otherwise("ont")
    return x.withColumn("read_type", kind)
