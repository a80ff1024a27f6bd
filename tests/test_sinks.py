"""Writers take the place of earlier files, whole or not at all."""

import pytest

from loamwork.sources import sinks


def _tables(spark, labels):
    rows = spark.createDataFrame([(f"c{i}", k, 100 + i) for i, k in enumerate(labels)], "contig_id string, label int, length long")
    contigs = spark.createDataFrame([(f"c{i}", "ACGT" * 5) for i in range(len(labels))], "contig_id string, seq string")
    return rows, contigs


def _bins(path):
    return sorted(p.name for p in path.iterdir() if p.is_dir())


def test_a_second_run_replaces_the_first(spark, tmp_path):
    rows, contigs = _tables(spark, [0, 0, 1, 2, -1])
    sinks.write_bins(rows.where("label >= 0"), contigs, str(tmp_path / "bins"))
    sinks.write_outputs(rows, str(tmp_path / "tables"))
    assert _bins(tmp_path / "bins") == ["bin_id=bin_001", "bin_id=bin_002", "bin_id=bin_003"]
    rows, contigs = _tables(spark, [0, 0, 0])
    sinks.write_bins(rows.where("label >= 0"), contigs, str(tmp_path / "bins"))
    sinks.write_outputs(rows, str(tmp_path / "tables"))
    assert _bins(tmp_path / "bins") == ["bin_id=bin_001"] and sorted(p.name for p in tmp_path.iterdir()) == ["bins", "tables"]
    read = spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "tables/assignments"))
    assert {(r.contig_id, r.bin_id, r.length) for r in read.collect()} == {(f"c{i}", "bin_001", str(100 + i)) for i in range(3)}


def test_an_aborted_write_leaves_the_old_files(spark, tmp_path):
    rows, _ = _tables(spark, [0, 1])
    sinks.write_tsv(rows, str(tmp_path / "t"))
    before = {p.name: p.read_bytes() for p in (tmp_path / "t").iterdir()}
    with pytest.raises(Exception, match="(?i)divi"):
        sinks.write_tsv(rows.selectExpr("contig_id", "CAST(raise_error('divided') AS string) AS x"), str(tmp_path / "t"))
    assert {p.name: p.read_bytes() for p in (tmp_path / "t").iterdir()} == before and [p.name for p in tmp_path.iterdir()] == ["t"]
