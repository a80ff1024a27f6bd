"""Media columns: content-addressed payloads in tar shards.

A payload's address is the SHA-256 of its bytes. One row of each address writes the
payload, as a lossless 8-bit grey image, into a tar shard: a plain file in the shared
folder, appended to while its task runs. Rows carry digest, shard, offset and length.
Readers fetch byte ranges of the shards: headers alone for the metadata columns, whole
members only for features. Only digests and ids are shuffled, never payloads.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamwork.llm.common import arrow_schema, check_columns, few, keep_until_cleanup, materialize, scratch, shared_dir, slices, texts_of, tidy

#: Payloads are padded with bytes 255 to a positive multiple of this, which is also an image's width.
UNIT = 576
#: A shard closes at the first member end beyond so many bytes.
SHARD_BYTES = 64 << 20
# Fixed values of the PNG format: signature, bytes up to the header chunk's end, grey samples without interlacing.
SIGNATURE, HEADER, GREY = b"\x89PNG\r\n\x1a\n", 33, (0, 0, 0, 0)
PLACES = "digest binary, shard string, offset long, length long"
METADATA = "digest binary, shard string, offset long, length long, width int, height int, sample_bits int, n_samples long"
FEATURES = "digest binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
COLUMNS = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "shard", "media_offset", "width", "height", "sample_bits", "n_samples"]


def payload(text: str) -> bytes:
    """The text's padded bytes."""
    raw = text.encode()
    return raw + b"\xff" * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def image(samples: bytes) -> bytes:
    """A grey PNG of UNIT samples a line, none of them filtered."""
    height = len(samples) // UNIT
    lines = np.zeros((height, UNIT + 1), np.uint8)
    lines[:, 1:] = np.frombuffer(samples, np.uint8).reshape(height, UNIT)
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">II5B", UNIT, height, 8, *GREY)) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 5)) + _chunk(b"IEND", b"")


def header(raw: bytes) -> dict[str, int]:
    """Metadata from the first HEADER bytes of an image."""
    size, kind, width, height, depth, *form = struct.unpack(">I4sII5B", raw[8:29])
    if raw[:8] != SIGNATURE or (size, kind) != (13, b"IHDR") or tuple(form) != GREY or zlib.crc32(raw[12:29]) != int.from_bytes(raw[29:HEADER], "big"):
        raise ValueError("not a grey PNG")
    return {"width": width, "height": height, "sample_bits": depth, "n_samples": width * height}


def samples_of(raw: bytes) -> bytes:
    """The samples of an image() as they were; an image that isn't whole is an error."""
    about, at, packed = header(raw[:HEADER]), HEADER, []
    while at < len(raw):
        size, kind = struct.unpack_from(">I4s", raw, at) if at + 12 <= len(raw) else (len(raw), b"")
        data = raw[at + 8 : at + 8 + size]
        if at + size + 12 > len(raw) or zlib.crc32(kind + data) != int.from_bytes(raw[at + 8 + size : at + 12 + size], "big"):
            raise ValueError(f"damaged image: chunk at {at}")
        if kind == b"IDAT":
            packed.append(data)
        at += size + 12
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(about["height"], about["width"] + 1)
    if lines[:, 0].any():
        raise ValueError("damaged image: a line is filtered")
    return lines[:, 1:].tobytes()


def feature(samples: np.ndarray) -> str:
    """Mean, energy, zero crossings and a 16-step envelope of 8-bit samples, all in whole numbers."""
    x = samples.astype(np.int64) - 128
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    envelope = np.add.reduceat(np.abs(x), np.arange(16) * len(x) // 16) // max(1, len(x) // 16)
    return f"mean={int(x.sum()) * 1000 // len(x)};power={int((x * x).sum()) // len(x)};crossings={crossings};envelope={envelope.astype(np.uint8).tobytes().hex()}"


def open_folder(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a shared folder: a URI that Arrow knows (file, hdfs, s3, ...) or a plain path."""
    if folder.startswith("file:/"):
        folder = "/" + folder[5:].lstrip("/")
    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)


class Shard:
    """A tar file that grows member by member; memory holds one member."""

    def __init__(self, folder: str, name: str):
        system, path = open_folder(folder)
        self.name, self.size, self.stream = name, 0, system.open_output_stream(f"{path}/{name}")

    def add(self, digest: bytes, media: bytes) -> int:
        """Appends a member; returns the offset of its content."""
        info = tarfile.TarInfo(f"{digest.hex()}.png")
        info.size = len(media)
        head = info.tobuf(tarfile.GNU_FORMAT)
        for part in (head, media, bytes(-len(media) % 512)):
            self.stream.write(part)
        at = self.size + len(head)
        self.size = at + -(-len(media) // 512) * 512
        return at

    def close(self) -> None:
        self.stream.write(bytes(1024))
        self.stream.close()


def named(docs: DataFrame) -> DataFrame:
    """doc_id, text, n_bytes and digest (of the payload) of the rows that have a doc_id; the JVM makes them."""
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    n = F.octet_length(F.coalesce(F.col("text"), F.lit("")))
    pad = F.greatest(F.lit(UNIT), F.ceil(n / UNIT) * UNIT) - n
    whole = F.concat(raw, F.unhex(F.repeat(F.lit("FF"), pad.cast("int"))))
    return docs.where("doc_id is not null").select("doc_id", "text", n.cast("long").alias("n_bytes"), F.unhex(F.sha2(whole, 256)).alias("digest"))


def write_shards(docs: DataFrame, folder: str, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """digest, shard, offset and length of every payload, stored once each in tar files of folder.

    Of the rows with a digest, those with the smallest doc_id write it, and a task writes a
    digest once; which other documents share it is known by ids and digests alone. A
    task's attempts write files of their own, and the table has the rows of those that
    ended well.
    """
    check_columns(docs, "doc_id", "text")
    rows = named(docs)
    ids = rows.select("doc_id", "digest")
    first = ids.groupBy("digest").agg(F.min("doc_id").alias("first"))
    copies = materialize(ids.join(first, "digest").where("doc_id <> first").select("doc_id", "digest").distinct(), "copies")
    writers = rows.join(F.broadcast(copies) if few(copies) else copies, ["doc_id", "digest"], "left_anti").select("digest", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, shard = TaskContext.get(), 0, None
        schema = arrow_schema(PLACES)
        written: set[bytes] = set()
        for part in slices(batches):
            out: list[tuple] = []
            for digest, text in zip(part.column("digest").to_pylist(), texts_of(part), strict=True):
                if digest in written:
                    continue
                written.add(digest)
                if shard is None:
                    shard = Shard(folder, f"shard-{task.partitionId():06d}-{task.taskAttemptId()}-{number}.tar")
                media = image(payload(text))
                out.append((digest, shard.name, shard.add(digest, media), len(media)))
                if shard.size >= shard_bytes:
                    shard.close()
                    number, shard = number + 1, None
            yield pa.RecordBatch.from_pydict({c: [r[i] for r in out] for i, c in enumerate(schema.names)}, schema=schema)
        if shard:
            shard.close()

    places = materialize(writers.mapInArrow(tidy(run), PLACES), "places")
    # rows that repeat an id with one text may have been written by several tasks: one place stands
    return places.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("at")).select("digest", "at.*")


def _ranges(folder: str) -> Callable[[str, int, int], bytes]:
    """A reader of byte ranges of shards; it holds one shard open."""
    system, path = open_folder(folder)
    held: list = [None, None]

    def read(shard: str, offset: int, length: int) -> bytes:
        if held[0] != shard:
            held[:] = shard, system.open_input_file(f"{path}/{shard}")
        return held[1].read_at(length, offset)

    return read


def _read(places: DataFrame, folder: str, make: Callable[[Callable, dict], dict], schema: str) -> DataFrame:
    """make(read, row) for every place; a shard's places are read in order by one task, and shards are dealt out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow, read = arrow_schema(schema), _ranges(folder)
        for part in slices(batches):
            yield pa.RecordBatch.from_pylist([make(read, row) for row in part.to_pylist()], schema=arrow)

    return places.repartition("shard").sortWithinPartitions("shard", "offset").mapInArrow(tidy(run), schema)


def metadata(places: DataFrame, folder: str) -> DataFrame:
    """places with the header fields; of each payload HEADER bytes are read."""

    def make(read, row):
        return row | header(read(row["shard"], row["offset"], HEADER))

    return _read(places, folder, make, METADATA)


def features(places: DataFrame, folder: str) -> DataFrame:
    """What the stored bytes hold, once for each payload."""

    def make(read, row):
        media = read(row["shard"], row["offset"], row["length"])
        samples = samples_of(media)
        found = hashlib.sha256(samples)
        if found.digest() != row["digest"]:
            raise ValueError(f"{row['shard']} holds other bytes than {row['digest'].hex()} at {row['offset']}")
        return {"digest": row["digest"], "payload_bytes": len(samples), "payload_sha256": found.hexdigest(), "tail_crc32": zlib.crc32(samples[-32:]), "media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(), "feature": feature(np.frombuffer(samples, np.uint8))}

    return _read(places, folder, make, FEATURES)


def media_columns(docs: DataFrame) -> DataFrame:
    """Stores every text as media and returns what reading it back gives, with where it is and its header's fields.

    Null and empty texts become one unit of bytes 255. Equal texts are stored once, so all
    columns but doc_id are equal for them. Rows without a doc_id are left out, other
    columns ignored. An empty table gives no shards and no rows.
    """
    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/media-{uuid.uuid4().hex}"
    system, path = open_folder(folder)
    system.create_dir(path)
    keep_until_cleanup(folder)
    with scratch(spark):
        about = materialize(metadata(write_shards(docs, folder), folder), "media")
        read = features(about.select("digest", "shard", "offset", "length"), folder).join(about.select("digest", "shard", F.col("offset").alias("media_offset"), "width", "height", "sample_bits", "n_samples"), "digest")
        return materialize(named(docs).select("doc_id", "n_bytes", "digest").join(read, "digest").select(*COLUMNS), "media-columns", keep=True)
