"""FASTA, FASTQ and NumPy sources: ranges that cut records, odd records, and writes that fail."""

import gzip
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamwork.sources import fasta, fastq, npy


def _reads(n, seed=3):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        size = rnd.choice([0, 1, 2, rnd.randint(3, 90)])
        out.append((f"r{i}", "".join(rnd.choices("ACGTN", k=size)), "".join(rnd.choices("@+I!", k=size))))
    return out


def _text(reads, end="\n"):
    return "".join(f"@{i} about{end}{s}{end}+{i if k % 3 else ''}{end}{q}{end}" for k, (i, s, q) in enumerate(reads))


@pytest.mark.parametrize("size", [1, 7, 64, 1000, 1 << 20])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_every_range_finds_its_records(tmp_path, size, end):
    reads = _reads(120)
    text = _text(reads, end).encode()
    (tmp_path / "r.fq").write_bytes(text)
    got = []
    for r in fastq.cut(str(tmp_path / "r.fq"), len(text), size):
        with open(r.path, "rb") as f:
            got += fastq.records(f, r.start, r.end, r.path)
    assert got == reads


def test_fastq_through_spark(spark, tmp_path):
    reads = _reads(300)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.fq").write_text(_text(reads[:200]))
    with gzip.open(tmp_path / "in" / "b.fq.gz", "wt") as f:
        f.write(_text(reads[200:]) + "\n\n")
    x = fastq.read_fastq(spark, str(tmp_path / "in"), partition_bytes=500)
    assert x.rdd.getNumPartitions() > 10
    assert sorted((r.read_id, r.seq, r.quality) for r in x.collect()) == sorted(reads)
    assert fastq.read_fastq(spark, str(tmp_path / "in"), columns="seq string").columns == ["seq"]
    fastq.write_fastq(x, str(tmp_path / "out"))
    assert sorted((r.read_id, r.seq, r.quality) for r in fastq.read_fastq(spark, str(tmp_path / "out"), partition_bytes=99).collect()) == sorted(reads)


def test_sniff_takes_first_reads_of_seeded_files(spark, tmp_path):
    for k in range(6):
        (tmp_path / f"{k}.fq").write_text(_text([(f"{k}-{i}", "ACGT", "IIII") for i in range(20)]))
    sets = []
    for seed in (1, 1, 2, 3):
        rows = fastq.read_fastq(spark, str(tmp_path), reads=5, files=3, seed=seed).groupBy("file").agg(F.collect_set("read_id").alias("ids")).collect()
        assert len(rows) == 3 and all({i.split("-")[1] for i in r.ids} == set("01234") for r in rows)
        sets.append(frozenset(r.file for r in rows))
    assert sets[0] == sets[1] and len(set(sets)) > 1


@pytest.mark.parametrize("bad", ["ACGT\n", "@a\nACGT\n+\nIII\n", "@a\nACGT\n-\nIIII\n", "@a\nACGT\n"])
def test_broken_fastq_is_an_error(tmp_path, bad):
    (tmp_path / "r.fq").write_text(bad)
    with open(tmp_path / "r.fq", "rb") as f, pytest.raises(ValueError, match="byte 0"):
        list(fastq.records(f, 0, len(bad), "r.fq"))


def test_fasta_headers_may_hold_the_mark(spark, tmp_path):
    (tmp_path / "a.fa").write_text("\n>x len>5 a>b\nAC\nGT\n>y\n\n>>z\r\nA\r\n>w")
    rows = {(r.contig_id, r.seq) for r in fasta.read_fasta(spark, str(tmp_path / "a.fa")).collect()}
    assert rows == {("x", "ACGT"), ("y", ""), ("z", "A"), ("w", "")}


@pytest.mark.parametrize("order", ["C", "F"])
@pytest.mark.parametrize("kind", [np.float32, np.int16])
def test_npy_by_ranges(spark, tmp_path, order, kind):
    x = np.arange(60).reshape(20, 3).astype(kind)
    np.save(tmp_path / "x.npy", np.asarray(x, order=order))
    got = npy.read_npy(spark, str(tmp_path / "x.npy"), partition_bytes=24)
    assert got.rdd.getNumPartitions() == (1 if order == "F" else 20 // (24 // (3 * x.itemsize)))
    assert [r.vec for r in got.orderBy("ord").collect()] == x.tolist()


def test_npy_round_trip_and_failed_write(spark, tmp_path):
    path = str(tmp_path / "m")
    rows = spark.range(1000).select(F.array(F.col("id").cast("double"), F.lit(0.5)).alias("vec"))
    npy.write_npy(rows, path, file_bytes=1000)
    first = {r.vec[0] for r in npy.read_npy(spark, path).collect()}
    assert first == set(range(1000)) and len(list((tmp_path / "m").glob("*.npy"))) > 4
    uneven = spark.range(10).select(F.when(F.col("id") < 9, F.array(F.lit(1.0))).otherwise(F.array(F.lit(1.0), F.lit(2.0))).alias("vec"))
    with pytest.raises(Exception, match="equally long"):
        npy.write_npy(uneven.coalesce(1), path)
    assert {r.vec[0] for r in npy.read_npy(spark, path).collect()} == first
    npy.write_npy(rows.where("vec[0] < 10"), path)
    assert npy.read_npy(spark, path).count() == 10
    npy.write_npy(rows.where("vec[0] >= 990"), path, overwrite=False)
    assert npy.read_npy(spark, path).count() == 20
