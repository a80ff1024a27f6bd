"""Writers of final tables."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamwork.operators import bins
from loamwork.sources.fasta import write_fasta


def committed(spark: SparkSession, path: str, write: Callable[[str], None]) -> None:
    """write(folder) into a new folder beside path, which takes its place once everything is written.

    Files of an earlier run go only then; a write that fails leaves them as they are.
    """
    hadoop, new = spark._jvm.org.apache.hadoop.fs.Path, f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    files = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        write(new)
    except BaseException:
        files.delete(hadoop(new), True)
        raise
    files.delete(hadoop(path), True)
    if not files.rename(hadoop(new), hadoop(path)):
        raise OSError(f"{new} can't be renamed to {path}")


def write_tsv(rows: DataFrame, path: str) -> None:
    """A TSV with a header, in place of one from before."""
    committed(rows.sparkSession, path, lambda new: rows.write.option("sep", "\t").option("header", True).csv(new))


def write_bins(rows: DataFrame, contigs: DataFrame, path: str) -> None:
    """One folder of FASTA a bin, bins dealt out by their own rows; bins from before go."""
    named = rows.join(F.broadcast(bins.dense_ids(rows).select("label", "bin_id")), "label").select("contig_id", "bin_id")
    committed(rows.sparkSession, path, lambda new: write_fasta(contigs.join(named, "contig_id"), new, by="bin_id"))


def write_outputs(rows: DataFrame, path: str) -> None:
    """Assignments, summary and unclustered contigs."""
    named = rows.where("label >= 0").join(F.broadcast(bins.dense_ids(rows)), "label")
    write_tsv(named.select("contig_id", "bin_id", "length"), f"{path}/assignments")
    write_tsv(bins.summary(rows), f"{path}/summary")
    write_tsv(rows.where("label < 0").select("contig_id", "length"), f"{path}/unclustered")


def rejected(rows: DataFrame, classified: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members of rejected bins with their reasons, and organelle contigs by evidence with their bins."""
    lost = rows.where("reason <> ''").select("contig_id", "was", "reason")
    return lost, bins.organelle_evidence(classified).join(rows.select("contig_id", "label"), "contig_id", "left").select("contig_id", "classification", "evidence", "label")


def one_row_json(rows: DataFrame, **more) -> str:
    """A one-row aggregate as JSON, with further entries."""
    first = rows.first()
    return json.dumps((first.asDict(recursive=True) if first else {}) | more, sort_keys=True, default=str)
