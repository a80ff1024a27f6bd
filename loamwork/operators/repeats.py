"""Repeat hits: classes, merged intervals, features and confidence weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Class tokens after '#', and keywords of names without one, in their order of precedence.
SKIP_TOKENS = ["RRNA", "SNRNA", "TRNA", "SCRNA"]
CLASS_TOKENS = {"LTR": ["LTR", "RETROPOSON", "RETROTRANSPOSON"], "DNA": ["DNA", "RC", "SATELLITE", "ROLLING_CIRCLE"], "LINE": ["LINE", "SINE", "SINE?"]}
CLASS_KEYWORDS = {
    "LTR": ["gypsy", "dirs", "copia", "ty1", "ty3", "bel", "pao", "retroviral", "erv", "ltr", "chromovirus", "reverse_transcriptase", "integrase", "retroposon"],
    "DNA": ["dna", "hat", "hobo", "activator", "tc1", "tc3", "mariner", "pogo", "en_spm", "enspm", "cacta", "mule", "mudr", "piggybac", "harbinger", "tourist", "transib", "kolobok", "merlin", "chapaev", "crypton", "transposase", "tir", "rolling", "helitron", "satellite"],
    "LINE": ["line", "sine", "r1", "r2", "rte", "bov", "l1", "cin4", "cr1", "penelope", "alu", "b1", "tad1", "jockey", "i-element"],
}
MIN_BASES = 30


def repeat_class(name: Column) -> Column:
    """LTR, DNA, LINE, Unclassified or Skip (RNA), by the token after '#', else by keywords."""
    token = F.trim(F.element_at(F.split(F.upper(F.substring_index(name, "#", -1)), "/"), 1))
    tagged = F.when(token.isin(SKIP_TOKENS), "Skip")
    for kind, tokens in CLASS_TOKENS.items():
        tagged = tagged.when(token.isin(tokens), kind)
    plain = None
    for kind, words in CLASS_KEYWORDS.items():
        found = F.lower(name).rlike("|".join(words))
        plain = F.when(found, kind) if plain is None else plain.when(found, kind)
    return F.when(F.contains(name, F.lit("#")), tagged.otherwise("Unclassified")).otherwise(plain.otherwise("Unclassified"))


def usable_hits(hits: DataFrame) -> DataFrame:
    """Hits of at least MIN_BASES bases that aren't RNA, with class, lo, hi and bases."""
    lo, hi = F.least("qstart", "qend"), F.greatest("qstart", "qend")
    h = hits.withColumn("te_class", repeat_class(F.col("target"))).withColumn("lo", lo).withColumn("hi", hi).withColumn("bases", hi - lo + 1)
    return h.where((F.col("bases") >= MIN_BASES) & (F.col("te_class") != "Skip"))


def islands(hits: DataFrame, key: str = "contig_id") -> DataFrame:
    """Key, lo, hi of merged intervals; only intervals that share a position merge."""
    order = Window.partitionBy(key).orderBy("lo", "hi")
    before = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = hits.select(key, "lo", "hi", F.coalesce(F.col("lo") > before, F.lit(True)).cast("int").alias("opens"))
    numbered = opened.withColumn("island", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("island")


def summarize(hits: DataFrame) -> DataFrame:
    """One row a contig with hits. Sums and the merged length come from one shuffle on contig_id."""
    h = usable_hits(hits)
    order = Window.partitionBy("contig_id").orderBy("lo", "hi")
    before = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.lit(0), F.col("hi") - F.greatest(F.coalesce(before, F.col("lo") - 1), F.col("lo") - 1))
    bp = lambda kind: F.sum(F.when(F.col("te_class") == kind, F.col("bases")).otherwise(0))
    return h.withColumn("fresh", fresh).groupBy("contig_id").agg(
        bp("LTR").alias("ltr_bp"), bp("DNA").alias("dna_bp"), bp("LINE").alias("line_bp"), bp("Unclassified").alias("unclassified_bp"),
        F.sum("bases").alias("total_te_bp"), F.sum("fresh").alias("merged_te_bp"), F.count("*").alias("n_hits"), F.sum("pident").alias("quality_sum"),
    )


def features(summary: DataFrame, lengths: DataFrame, full_bp: float = 500.0, full_length: float = 8000.0, full_hits: float = 5.0, coefs: tuple[float, float, float] = (0.55, 0.25, 0.20)) -> DataFrame:
    """Five square-rooted features and a confidence weight of every contig; zeros without valid hits."""
    if abs(sum(coefs) - 1) > 1e-9:
        raise ValueError("the coefficients must sum to 1")
    names = [c for c in summary.columns if c != "contig_id"]
    x = lengths.join(summary, "contig_id", "left").select("contig_id", "length", *(F.coalesce(c, F.lit(0)).alias(c) for c in names))
    valid = (F.col("length") > 0) & (F.col("total_te_bp") > 0) & (F.col("n_hits") > 0)
    kinds = sum(((F.col(c) > 0).cast("int") for c in ("ltr_bp", "dna_bp", "line_bp", "unclassified_bp")), F.lit(0))
    merged = F.least(F.lit(1.0), F.col("merged_te_bp") / F.col("length"))
    raw = {"te_diversity": kinds / 4.0, "te_density": merged, "dna_share": F.col("dna_bp") / F.col("total_te_bp"), "ltr_share": F.col("ltr_bp") / F.col("total_te_bp"), "unclassified_share": F.col("unclassified_bp") / F.col("total_te_bp")}
    signal = F.least(F.lit(1.0), F.col("merged_te_bp") / full_bp) * F.least(F.lit(1.0), F.col("length") / full_length)
    weight = coefs[0] * signal + coefs[1] * F.least(F.lit(1.0), F.col("n_hits") / full_hits) + coefs[2] * F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("quality_sum") / F.col("n_hits") / 100.0))
    clipped = F.least(F.lit(1.0), F.greatest(F.lit(0.0), weight))
    return x.select("contig_id", *(F.when(valid, F.sqrt(v)).otherwise(0.0).alias(k) for k, v in raw.items()), F.when(valid, clipped).otherwise(0.0).alias("te_weight"))


def class_signals(summary: DataFrame, warn_share: float = 0.95, least: int = 20) -> DataFrame:
    """Contigs with signal of each class, and a warning when nearly all is unclassified."""
    n = {k: F.sum((F.col(f"{k}_bp") > 0).cast("long")) for k in ("ltr", "dna", "line", "unclassified")}
    x = summary.agg(*(F.coalesce(v, F.lit(0)).alias(f"n_{k}") for k, v in n.items()))
    total = sum((F.col(f"n_{k}") for k in n), F.lit(0))
    return x.withColumn("warn", (total >= least) & (F.col("n_unclassified") > warn_share * total))


def unknown_contigs(hits: DataFrame, contigs: DataFrame) -> DataFrame:
    """Hits on contigs that don't exist; a caller refuses any."""
    return hits.join(contigs.select("contig_id"), "contig_id", "left_anti")


def bed(hits: DataFrame) -> DataFrame:
    """S3: 0-based half-open intervals of usable hits."""
    return usable_hits(hits).select("contig_id", (F.col("lo") - 1).alias("start"), F.col("hi").alias("stop"), "target", "te_class")
