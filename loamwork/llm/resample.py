"""Importance resampling towards a target distribution, over hashed word n-grams.

Features are the runs of 1 to ORDER words of the whole texts, hashed into BUCKETS. A
bucket's gain is the logarithm of how much likelier the target texts are to hold it than
all documents; a document's weight is the mean gain of its features, and Gumbel noise
makes the highest scores a draw without replacement.

Long texts are skewed, so those over CHUNK_BYTES are split at word boundaries and their
chunks are dealt to all tasks. A chunk owns the features that start in it; it carries the
next ORDER - 1 words, which complete the last ones. Counts and gains of chunks are summed
by document. Texts of one chunk stay in the task that reads them.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamwork.llm.common import arrow_schema, bounded, check_columns, materialize, parts, scratch, slices, texts_of, tidy
from loamwork.llm.ranks import ranked

#: Words in a feature at most.
ORDER = 2
BUCKETS = 10_000
#: Bytes of text that a chunk owns, but for the rest of its last word.
CHUNK_BYTES = 1 << 16
#: Drawn are PERCENT of the documents with at least MIN_WORDS words.
PERCENT, MIN_WORDS = 25, 20
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Lower-cases A-Z and makes every byte that belongs to no word a blank.
_PLAIN = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in bytes(range(256)).lower())
_CHUNKS = "doc_id long, text_key binary, chunk int, words binary, owned int"
_SUMS = "doc_id long, text_key binary, chunk int, n_features long, gain long"


def words_of(text: str) -> bytes:
    """The text's words in lower case, with blanks for everything else."""
    return text.encode().translate(_PLAIN)


def buckets_of(words: list[bytes], owned: int) -> np.ndarray:
    """The buckets of all runs of 1 to ORDER words that start among the first owned ones."""
    state = list(map(crc32, words))
    found = [state[:owned]]
    for k in range(1, ORDER):
        tails = [b" " + w for w in words[k:]]
        state = list(map(crc32, tails, state))
        found.append(state[:owned])
    n = sum(map(len, found))
    return np.fromiter((c for x in found for c in x), np.int64, n) % BUCKETS


def chunks(words: bytes, size: int = CHUNK_BYTES) -> Iterator[tuple[list[bytes], int]]:
    """(words, how many of them it owns) of each chunk: what starts in its size bytes, and the ORDER - 1 words after that."""
    at = 0
    while at < len(words):
        end = words.find(b" ", at + size)
        if end < 0 or not _WORD.search(words, end):
            yield (own := words[at:].split()), len(own)
            return
        own, carry, after = words[at:end].split(), [], end
        while len(carry) < ORDER - 1 and (m := _WORD.search(words, after)):
            carry.append(m[0])
            after = m.end()
        yield own + carry, len(own)
        at = end


def _long(docs: DataFrame, size: int) -> DataFrame:
    """The chunks of texts over size bytes, dealt to tasks by document and place. Rows alike in id and text share their key."""
    schema = arrow_schema(_CHUNKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            doc, key, text = (part.column(c)[0].as_py() for c in ("doc_id", "text_key", "text"))
            for n, (own, owned) in enumerate(chunks(words_of(text), size)):
                yield pa.RecordBatch.from_pydict({"doc_id": [doc], "text_key": [key], "chunk": [n], "words": [b" ".join(own)], "owned": [owned]}, schema=schema)

    bounded(docs.sparkSession)
    found = docs.where(F.octet_length("text") > size).select("doc_id", "text", F.unhex(F.sha2("text", 256)).alias("text_key"))
    return found.mapInArrow(tidy(run), _CHUNKS).repartition(parts(docs), "doc_id", "text_key", "chunk")


def _features(part: pa.RecordBatch) -> Iterator[np.ndarray]:
    """The buckets of each row of chunks or of short texts."""
    if "words" in part.schema.names:
        for own, owned in zip(part.column("words").to_pylist(), part.column("owned").to_pylist(), strict=True):
            yield buckets_of(own.split(), owned)
    else:
        for text in texts_of(part):
            yield buckets_of(own := words_of(text).split(), len(own))


def _counted(*tables: DataFrame) -> DataFrame:
    """How often each bucket occurs in the tables; a task sends one row a bucket at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for part in slices(batches):
            for found in _features(part):
                total += np.bincount(found, minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": at, "n": total[at]}, schema=arrow_schema("bucket long, n long"))

    counts = [t.mapInArrow(tidy(run), "bucket long, n long") for t in tables]
    for more in counts[1:]:
        counts[0] = counts[0].unionByName(more)
    return counts[0].groupBy("bucket").agg(F.sum("n").alias("n"))


def _dense(counts: DataFrame) -> list[int]:
    """At most BUCKETS rows, as a list."""
    out = [0] * BUCKETS
    for bucket, n in counts.collect():
        out[bucket] = n
    return out


def gains(source: list[int], target: list[int]) -> list[int]:
    """floor(1000 ln((t + 1)(S + BUCKETS) / ((s + 1)(T + BUCKETS)))) of every bucket, in doubles."""
    all_s, all_t = float(sum(source) + BUCKETS), float(sum(target) + BUCKETS)
    return [math.floor(1000 * math.log((t + 1.0) * all_s / ((s + 1.0) * all_t))) for s, t in zip(source, target, strict=True)]


def _summed(rows: DataFrame, gain: list[int]) -> DataFrame:
    """Number of features and sum of their gains for every row of chunks or of short texts."""
    table, schema, keyed = np.array(gain, np.int64), arrow_schema(_SUMS), "words" in rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = [(len(x), int(table[x].sum())) for x in _features(part)]
            n, total = zip(*found, strict=True) if found else ((), ())
            key, chunk = (part.column("text_key"), part.column("chunk")) if keyed else ([None] * len(n), [0] * len(n))
            yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "text_key": key, "chunk": chunk, "n_features": n, "gain": total}, schema=schema)

    return rows.mapInArrow(tidy(run), _SUMS)


def _whole(sums: DataFrame) -> DataFrame:
    """Sums of the chunks by document; k rows alike in id and text have k times the sums and become k rows again."""
    times = F.sum(F.when(F.col("chunk") == 0, 1))
    added = sums.groupBy("doc_id", "text_key").agg(times.alias("k"), F.sum("n_features").alias("n"), F.sum("gain").alias("g"))
    return added.select("doc_id", F.expr("n div k").alias("n_features"), F.expr("g div k").alias("gain"), F.explode(F.expr("array_repeat(0, int(k))"))).drop("col")


def scored(docs: DataFrame, targets: DataFrame, seed: int = 7, size: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, n_features, weight and score of every document; the table is written."""
    check_columns(docs, "doc_id", "text")
    check_columns(targets, "text")
    with scratch(docs.sparkSession):
        docs = docs.select(F.col("doc_id").cast("long"), "text")
        long = materialize(_long(docs, size), "resample_chunks")
        short = docs.where(F.coalesce(F.octet_length("text"), F.lit(0)) <= size).select("doc_id", "text")
        wanted = targets.select(F.lit(None).cast("long").alias("doc_id"), "text")
        source, target = _counted(short, long), _counted(wanted.where(F.octet_length("text") <= size), _long(wanted, size))
        gain = gains(_dense(source), _dense(target))
        sums = _summed(short, gain).select("doc_id", "n_features", "gain").unionByName(_whole(_summed(long, gain)))
        noise = F.expr(f"(conv(substr(sha2(concat('{seed}:', doc_id), 256), 1, 8), 16, 10) + 0.5D) / 4294967296D")
        weight = F.expr("if(n_features = 0, 0, (gain - pmod(gain, n_features)) div n_features)")
        out = sums.select("doc_id", "n_features", weight.alias("weight"), noise.alias("u"))
        out = out.select("doc_id", "n_features", "weight", (F.col("weight") + F.floor(-1000 * F.log(-F.log("u")))).alias("score"))
        return materialize(out, "resample_scores", keep=True)


def resample(docs: DataFrame, targets: DataFrame, seed: int = 7, percent: int = PERCENT, min_words: int = MIN_WORDS, size: int = CHUNK_BYTES) -> DataFrame:
    """Every document's doc_id, n_features, weight, score and rank in the draw (null: not drawn), all long.

    Words are runs of letters, digits and non-ASCII characters, A-Z in lower case. Of the N
    documents with at least min_words words, the floor(percent N / 100) highest scores are
    drawn; ties go to the smaller doc_id. A null or empty text has no features and the
    weight 0. Noise comes from the id, so rows that repeat an id and a text get equal scores
    and ranks next to each other. A row without an id has no score, isn't counted in N and is
    never drawn. Empty targets give the weights that smoothing alone makes; an empty table
    gives no rows. Other columns are ignored. A chunk has size bytes and its last word; a
    word is never split, so a word's length bounds a task's memory.
    """
    rows = scored(docs, targets, seed, size)
    able = (F.col("n_features") >= sum(max(0, min_words - k) for k in range(ORDER))) & F.col("doc_id").isNotNull()
    n = rows.where(able).count() * percent // 100
    order = ranked(rows.where(able), [F.desc("score"), F.asc("doc_id")], "rank")
    out = order.withColumn("rank", F.when(F.col("rank") <= n, F.col("rank")))
    return out.unionByName(rows.where(~able).withColumn("rank", F.lit(None).cast("long")))
