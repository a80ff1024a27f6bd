"""Nucleotide search by seeds, diagonals and extension: the twelve-column hits of a repeat library on contigs."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamwork.operators import ani
from loamwork.plans.workspace import few, settled

K, EVERY = 13, 2
#: Anchors of a diagonal that are nearer than GAP belong together; so many make a start.
GAP, ANCHORS = 60, 2
MATCH, MISMATCH = 1, -2
#: An extension ends where its score has fallen so far below its best.
DROP = 20
#: The statistics of ungapped scores of 1 and -2 at equal base shares.
LAMBDA, KAPPA = 1.33, 0.621
HITS = "query string, target string, pident double, alnlen int, mismatch int, gapopen int, qstart long, qend long, tstart long, tend long, evalue double, bits double"
_LETTERS = np.full(256, 9, np.uint8)
_LETTERS[[ord(c) for c in "ACGTacgt"]] = [0, 1, 2, 3, 0, 1, 2, 3]


def starts(contigs: DataFrame, library: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """Query, target, turned, diagonal, at: stretches of anchors on one diagonal, and the place in the query of their first.

    Anchors are joined by seed and counted by diagonal in the same pass; nothing is paired
    that shares no seed.
    """
    q = ani.seeds(contigs, k, every).select(F.col("name").alias("query"), "hash", F.col("place").alias("p"), F.col("back").alias("back_q"))
    t = ani.seeds(library, k, every).select(F.col("name").alias("target"), "hash", F.col("place").alias("r"), "back")
    t = settled(t)
    x = q.join(F.broadcast(t) if few(t) else t, "hash").withColumn("turned", F.col("back") != F.col("back_q"))
    x = x.withColumn("diagonal", F.when(F.col("turned"), F.col("p") + F.col("r")).otherwise(F.col("p") - F.col("r")))
    keys = ["query", "target", "turned", "diagonal"]
    by = Window.partitionBy(*keys).orderBy("p")
    x = x.withColumn("jump", F.coalesce((F.col("p") - F.lag("p").over(by) > GAP).cast("int"), F.lit(0))).withColumn("part", F.sum("jump").over(by))
    return x.groupBy(*keys, "part").agg(F.count("*").alias("n"), F.min("p").alias("at")).where(F.col("n") >= ANCHORS).drop("part", "n")


def _reach(score: np.ndarray) -> tuple[int, int]:
    """(how far to go, the score there): the best prefix before the score drops by more than DROP."""
    if not len(score):
        return 0, 0
    run = np.cumsum(score)
    best = np.maximum.accumulate(np.maximum(run, 0))
    stop = np.flatnonzero(best - run > DROP)
    run = run[: stop[0]] if len(stop) else run
    k = int(run.argmax()) if len(run) else 0
    return (k + 1, int(run[k])) if len(run) and run[k] > 0 else (0, 0)


def extended(q: np.ndarray, t: np.ndarray, at: int, diagonal: int, turned: bool, k: int) -> tuple[int, int, int, int] | None:
    """(begin, end in q; matches; score) of the ungapped stretch through the anchor at q[at]. t is as stored; turned compares its other strand."""
    lo, hi = (max(0, diagonal + k - len(t)), min(len(q), diagonal + k)) if turned else (max(0, diagonal), min(len(q), diagonal + len(t)))
    i = np.arange(lo, hi)
    other = 3 - t[diagonal + k - 1 - i].astype(np.int64) if turned else t[i - diagonal].astype(np.int64)
    same = (q[lo:hi] == other) & (q[lo:hi] < 4)
    score = np.where(same, MATCH, MISMATCH)
    mid = at - lo
    (right, a), (left, b) = _reach(score[mid:]), _reach(score[:mid][::-1])
    if not right:
        return None
    begin, end = at - left, at + right
    return begin, end, int(same[begin - lo : end - lo].sum()), a + b


def search(contigs: DataFrame, library: DataFrame, max_evalue: float = 1e-3, k: int = K, every: int = EVERY) -> DataFrame:
    """HITS of library sequences on contigs (both: name, seq), ungapped; a hit on the other strand has qstart > qend.

    An insertion or deletion divides a hit in two. The expected number counts the whole
    library's letters.
    """
    side = lambda rows: rows.select(F.col("name").cast("string").alias("name"), "seq", F.lit(0).alias("begin"))
    letters = library.agg(F.coalesce(F.sum(F.length("seq")), F.lit(0)).alias("n")).first()[0]
    found = starts(side(contigs), side(library), k, every)
    x = found.join(side(contigs).select(F.col("name").alias("query"), F.col("seq").alias("q")), "query").join(side(library).select(F.col("name").alias("target"), F.col("seq").alias("t")), "target")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = lambda s: _LETTERS[np.frombuffer(s.encode("ascii", "replace"), np.uint8)]
        for b in batches:
            rows = []
            for at in range(b.num_rows):
                query, target, turned, diagonal, start, q, t = (b.column(c)[at].as_py() for c in ("query", "target", "turned", "diagonal", "at", "q", "t"))
                hit = extended(code(q), code(t), start, diagonal, turned, k)
                if hit is None:
                    continue
                begin, end, good, score = hit
                evalue = KAPPA * len(q) * letters * math.exp(-LAMBDA * score)
                if evalue > max_evalue:
                    continue
                n = end - begin
                places = (end, begin + 1, diagonal + k - end + 1, diagonal + k - begin) if turned else (begin + 1, end, begin - diagonal + 1, end - diagonal)
                rows.append((query, target, 100.0 * good / n, n, n - good, 0, *places, evalue, (LAMBDA * score - math.log(KAPPA)) / math.log(2)))
            names = [c.split()[0] for c in HITS.split(", ")]
            kinds = {"string": pa.string(), "double": pa.float64(), "int": pa.int32(), "long": pa.int64()}
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[c.split()[1]]) for i, c in enumerate(HITS.split(", "))], names=names)

    return x.mapInArrow(run, HITS).distinct()  # two starts may reach the same stretch
