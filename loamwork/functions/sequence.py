"""Column functions on nucleotide sequences and identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_id(sample: Column, name: Column) -> Column:
    """B1: an id that tools accept: the sample, and the name with other characters replaced."""
    return F.concat(sample, F.lit("_"), F.regexp_replace(F.trim(name), r"[^A-Za-z0-9_.\-]", "_"))


def sample_tag(header: Column, pattern: str) -> Column:
    """B2: the one capture group of pattern; null where the header doesn't match."""
    return F.when(header.rlike(pattern), F.regexp_extract(header, pattern, 1))


def reverse_complement(seq: Column) -> Column:
    """V1: A-T and C-G exchanged, reversed."""
    return F.reverse(F.translate(seq, "ACGT", "TGCA"))


def canonical(kmer: Column) -> Column:
    """V2: the lower of a k-mer and its reverse complement."""
    return F.least(kmer, reverse_complement(kmer))


def count_of(seq: Column, letters: str) -> Column:
    """How many characters of seq are among letters."""
    return F.length(F.regexp_replace(seq, f"[^{letters}]", "")).cast("long")


def gc_share(seq: Column) -> Column:
    """V5: (G+C) over all characters; 0 for an empty sequence."""
    return count_of(seq, "GC") / F.greatest(F.length(seq), F.lit(1))


def gc_known(seq: Column) -> Column:
    """V5: (G+C) over A, C, G and T; null without any."""
    return F.when(count_of(seq, "ACGT") > 0, count_of(seq, "GC") / count_of(seq, "ACGT"))


def masked(seq: Column, spans: Column) -> Column:
    """Seq with N in the half-open spans (array of struct lo, hi), which are sorted and apart."""
    return F.aggregate(spans, seq, lambda s, x: F.overlay(s, F.repeat(F.lit("N"), (x["hi"] - x["lo"]).cast("int")), (x["lo"] + 1).cast("int"), (x["hi"] - x["lo"]).cast("int")))


def wrapped(seq: Column, width: int = 60) -> Column:
    """Seq in lines of width characters."""
    return F.regexp_replace(F.regexp_replace(seq, f"(.{{{width}}})", "$1\n"), "\n$", "")
