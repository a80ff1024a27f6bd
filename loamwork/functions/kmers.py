"""Canonical 4-mer composition."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamwork.functions.sequence import canonical

K = 4


def reverse_complement(kmer: str) -> str:
    return kmer.translate(str.maketrans("ACGT", "TGCA"))[::-1]


def canonical_index(k: int = K) -> tuple[list[str], np.ndarray]:
    """V2: the sorted canonical k-mers, and for every k-mer (base 4, A C G T) the place of its canonical form."""
    every = ["".join(p) for p in product("ACGT", repeat=k)]
    forms = [min(x, reverse_complement(x)) for x in every]
    names = sorted(set(forms))
    place = {x: i for i, x in enumerate(names)}
    return names, np.array([place[x] for x in forms])


def tnf_array(seq: str, index: np.ndarray, width: int, k: int = K) -> tuple[np.ndarray, int]:
    """V3: (frequencies, windows counted) of one sequence; windows with other letters are skipped, non-ASCII is an error."""
    code = _CODES[np.frombuffer(seq.upper().encode("ascii"), np.uint8)]
    if len(code) < k:
        return np.zeros(width), 0
    n = len(code) - k + 1
    value, good = np.zeros(n, np.int64), np.ones(n, bool)
    for i in range(k):
        part = code[i : i + n]
        value = value * 4 + part
        good &= part >= 0
    counts = np.bincount(index[value[good]], minlength=width)
    total = int(counts.sum())
    return (counts / total if total else np.zeros(width)), total


_CODES = np.full(256, -1, np.int64)
_CODES[[ord(c) for c in "ACGT"]] = range(4)


def tnf(contigs: DataFrame, min_valid: int = 50, full: int = 5000, mode: str = "confidence", min_length: int = 0) -> DataFrame:
    """V3, V4: contig_id, features (136 shares), n_kmers and weight; vectorised by task, nothing shuffled."""
    names, index = canonical_index()
    schema = "contig_id string, features array<double>, n_kmers long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [tnf_array(s or "", index, len(names)) for s in b.column("seq").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("contig_id").cast(pa.string()), pa.array([r[0].tolist() for r in rows], pa.list_(pa.float64())), pa.array([r[1] for r in rows], pa.int64())], names=["contig_id", "features", "n_kmers"])

    out = contigs.select("contig_id", "seq").mapInArrow(run, schema)
    if min_length:
        short = contigs.where(F.length("seq") < min_length).select("contig_id", F.lit(True).alias("short"))
        out = out.join(short, "contig_id", "left").withColumn("n_kmers", F.when(F.col("short"), F.lit(0)).otherwise(F.col("n_kmers"))).drop("short")
        out = out.withColumn("features", F.when(F.col("n_kmers") == 0, F.transform("features", lambda x: x * 0)).otherwise(F.col("features")))
    return out.withColumn("weight", tnf_weight(F.col("n_kmers"), min_valid, full, mode))


def tnf_weight(n: Column, min_valid: int = 50, full: int = 5000, mode: str = "confidence") -> Column:
    """V4: 0 below min_valid windows; else 1 (binary) or the share of full."""
    return F.when(n < min_valid, 0.0).otherwise(F.lit(1.0) if mode == "binary" else F.least(F.lit(1.0), n / F.lit(float(full))))


def kmer_rows(contigs: DataFrame, k: int = K) -> DataFrame:
    """The same counts as rows (contig_id, kmer, n), in DataFrame operations alone; one row a distinct k-mer."""
    at = F.explode(F.sequence(F.lit(1), F.length("seq") - (k - 1))).alias("at")
    windows = contigs.where(F.length("seq") >= k).select("contig_id", "seq", at).select("contig_id", F.expr(f"substr(seq, at, {k})").alias("window"))
    return windows.where(~F.col("window").rlike("[^ACGT]")).groupBy("contig_id", canonical(F.col("window")).alias("kmer")).agg(F.count("*").alias("n"))


#: Letters that are counted at a time.
LETTERS = 1 << 20


def kmer_totals(contigs: DataFrame, k: int = K) -> DataFrame:
    """kmer, n: kmer_rows() summed over all contigs; a task counts its sequences and sends a row a canonical k-mer and slice."""
    names, index = canonical_index(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total, held, size = np.zeros(len(names), np.int64), [], 0
            for s in [*b.column("seq").to_pylist(), None]:
                if s is not None:
                    held.append(s)
                    size += len(s)
                if s is None or size >= LETTERS:
                    code = _CODES[np.frombuffer("N".join(held).encode("ascii"), np.uint8)]  # no window spans two
                    n = len(code) - k + 1
                    if n > 0:
                        value, good = np.zeros(n, np.int64), np.ones(n, bool)
                        for i in range(k):
                            value = value * 4 + code[i : i + n]
                            good &= code[i : i + n] >= 0
                        total += np.bincount(index[value[good]], minlength=len(names))
                    held, size = [], 0
            there = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict({"kmer": pa.array([names[i] for i in there], pa.string()), "n": total[there]})

    return contigs.where("seq IS NOT NULL").select("seq").mapInArrow(run, "kmer string, n long").groupBy("kmer").agg(F.sum("n").alias("n"))


def mean_vector(vectors: DataFrame, column: str = "features") -> DataFrame:
    """The mean of all vectors as one row; only positions meet in the shuffle."""
    means = vectors.select(F.posexplode(column).alias("pos", "x")).groupBy("pos").agg(F.avg("x").alias("x"))
    return means.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("mean"))
