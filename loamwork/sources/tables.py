"""Readers of the tab-separated tables that external tools write; every schema is stated, none inferred."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Column layouts of the tables.
SAMPLES = "sample string, r1 string, r2 string"
CLASSIFICATION = "contig_id string, classification string, confidence double, confidence_type string, conflict boolean, source string, call_basis string, tiara_label string, whokaryote_label string, tiara_stage1 string, tiara_prob double, tiara_stage2 string, length bigint, whokaryote_status string"
ANI = "ref_file string, query_file string, ANI double, Align_fraction_ref double, Align_fraction_query double, Ref_name string, Query_name string"
GFF = "seqid string, src string, type string, start int, end int, score string, strand string, phase string, attrs string"
HIT_COLUMNS = {"query": "string", "target": "string", "pident": "double", "alnlen": "int", "mismatch": "int", "gapopen": "int", "qstart": "int", "qend": "int", "tstart": "int", "tend": "int", "evalue": "double", "bits": "double"}
LIBRARY_NAMES = ("TE_library.fa", "repeats.fa", "consensi.fa")
NUCLEOTIDE_SUFFIXES = (".fasta", ".fa", ".fna", ".fas", ".fasta.gz", ".fa.gz")


def read_tsv(spark: SparkSession, path: str, schema: str, header: bool = True) -> DataFrame:
    """A TSV; 'n/a' and 'NA' stay text."""
    return spark.read.schema(schema).option("sep", "\t").option("header", header).option("nullValue", "").csv(path)


def read_gff(spark: SparkSession, path: str) -> DataFrame:
    """Features as 0-based half-open spans."""
    g = spark.read.schema(GFF).option("sep", "\t").option("comment", "#").csv(path)
    return g.select(F.col("seqid").alias("contig_id"), (F.col("start") - 1).alias("lo"), F.col("end").alias("hi"), "type", "attrs")


def parse_hits(lines: DataFrame) -> DataFrame:
    """A10: hits from text lines, with ok false for malformed ones; blank lines are skipped."""
    parts = F.split("value", "\t")
    x = lines.where(F.trim("value") != "").withColumn("parts", parts)
    cells = [(F.get("parts", F.lit(i)) if kind == "string" else F.get("parts", F.lit(i)).try_cast(kind)).alias(name) for i, (name, kind) in enumerate(HIT_COLUMNS.items())]
    y = x.select(F.size("parts").alias("width"), *cells)
    whole = F.lit(True)
    for name in HIT_COLUMNS:
        whole &= F.col(name).isNotNull()
    return y.withColumn("ok", (F.col("width") == len(HIT_COLUMNS)) & whole).drop("width")


def read_hits(spark: SparkSession, path: str, most_malformed: float = 0.5) -> DataFrame:
    """A10: the well-formed hits of a file; too many malformed lines are an error."""
    hits = parse_hits(spark.read.text(path))
    n = hits.agg(F.count("*").alias("all"), F.sum((~F.col("ok")).cast("long")).alias("bad")).first()
    if n["all"] and n["bad"] > most_malformed * n["all"]:
        raise ValueError(f"{n['bad']} of {n['all']} lines in {path} are malformed")
    return hits.where("ok").drop("ok").withColumnRenamed("query", "contig_id")


def parse_scores(rows: DataFrame) -> DataFrame:
    """Bin, completeness, contamination: columns found by name, paths cut to their stem, unusable numbers left out."""
    find = lambda part: next((c for c in rows.columns if part in c.lower()), None)
    names = {k: find(k) for k in ("bin", "complet", "contam")}
    if None in names.values():
        raise ValueError(f"no columns for bin, completeness and contamination among {rows.columns}")
    stem = F.regexp_replace(F.regexp_extract(F.col(names["bin"]), r"([^/]+)$", 1), r"\.(fa|fasta|fna)(\.gz)?$", "")
    x = rows.select(stem.alias("bin"), F.col(names["complet"]).try_cast("double").alias("completeness"), F.col(names["contam"]).try_cast("double").alias("contamination"))
    good = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & F.col(c).between(0.0, 1e300)
    return x.where(good("completeness") & good("contamination"))


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """Completeness scores from a table whose separator is sniffed from its header."""
    head = spark.read.text(path).first()[0]
    return parse_scores(spark.read.option("header", True).option("sep", "\t" if "\t" in head else ",").csv(path))


def wide_coverage(rows: DataFrame, depth: list[str], breadth: list[str], key: str = "contig_id") -> DataFrame:
    """The long form of a wide coverage table whose depth and breadth columns pair by sample."""
    import re

    strip = lambda c: re.sub(r"[ _](mean|covered[ _]?fraction|breadth)$", "", c, flags=re.I).strip()
    if sorted(map(strip, depth)) != sorted(map(strip, breadth)):
        raise ValueError("depth and breadth columns don't pair by sample")
    by = {strip(c): c for c in breadth}
    pairs = F.array(*(F.struct(F.lit(strip(c)).alias("sample"), F.col(f"`{c}`").cast("double").alias("depth"), F.col(f"`{by[strip(c)]}`").cast("double").alias("breadth")) for c in depth))
    return rows.select(key, F.explode(pairs).alias("s")).select(key, "s.*")


def looks_like(path: str, first: str) -> bool:
    """Does a local file exist, hold bytes and begin with '>' or '@'?"""
    import gzip

    if not os.path.isfile(path) or not os.path.getsize(path):
        return False
    with gzip.open(path, "rt") if path.endswith(".gz") else open(path) as f:
        return f.read(1) == first


def repeat_library(path: str) -> str:
    """A library file itself, else a folder's preferred file, else its first nucleotide file by suffix order."""
    if os.path.isfile(path):
        return path
    names = sorted(os.listdir(path))
    for wanted in LIBRARY_NAMES:
        if wanted in names:
            return os.path.join(path, wanted)
    for suffix in NUCLEOTIDE_SUFFIXES:
        for n in names:
            if n.endswith(suffix):
                return os.path.join(path, n)
    raise FileNotFoundError(f"no nucleotide library in {path}")
