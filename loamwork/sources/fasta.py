"""FASTA reading and writing by Spark's own text readers; gzip is read too."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamwork.functions.sequence import wrapped


def records(spark: SparkSession, path: str) -> DataFrame:
    """header and body of each record; a '>' that begins a line parts records (a second one is dropped), so tasks read parts of a file."""
    raw = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", "^>", "").alias("value")).where(F.trim("value") != "")
    at = F.expr("instr(value, '\n')")
    return raw.select(F.when(at == 0, F.col("value")).otherwise(F.expr("substr(value, 1, instr(value, '\n') - 1)")).alias("header"), F.when(at == 0, "").otherwise(F.expr("substr(value, instr(value, '\n') + 1)")).alias("body"))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """A1: contig_id, the header's first word."""
    return records(spark, path).select(F.regexp_extract("header", r"^\s*(\S+)", 1).alias("contig_id"))


def read_fasta(spark: SparkSession, path: str, upper: bool = False) -> DataFrame:
    """A2: contig_id, seq, length."""
    seq = F.regexp_replace("body", r"\s", "")
    out = records(spark, path).select(F.regexp_extract("header", r"^\s*(\S+)", 1).alias("contig_id"), (F.upper(seq) if upper else seq).alias("seq"))
    return out.withColumn("length", F.length("seq").cast("long"))


def repeated_ids(contigs: DataFrame) -> DataFrame:
    """Ids that occur more than once; every caller treats any as fatal."""
    return contigs.groupBy("contig_id").agg(F.count("*").alias("n")).where("n > 1")


def write_fasta(contigs: DataFrame, path: str, width: int = 60, by: str | None = None) -> None:
    """Contigs as FASTA, of width columns (0: one line each); by makes a folder for each of its values."""
    seq = wrapped(F.col("seq"), width) if width else F.col("seq")
    rows = contigs.select(*([by] if by else []), F.concat(F.lit(">"), "contig_id", F.lit("\n"), seq).alias("value"))
    (rows.write.partitionBy(by) if by else rows.write).text(path)
