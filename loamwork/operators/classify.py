"""Domain calls: what two classifiers say, one resolved call, and what is removed."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Labels, categories and probability columns.
ORGANELLES = ["mitochondrion", "mitochondria", "plastid"]
NO_LABEL = ["", "n/a", "nan", "none"]
CATEGORIES = {
    "mit": "Mitochondrial", "mitochondria": "Mitochondrial", "mitochondrion": "Mitochondrial", "pla": "Plastid", "plastid": "Plastid", "bac": "Bacterial", "bacteria": "Bacterial",
    "arc": "Archaeal", "archaea": "Archaeal", "euk": "Eukaryotic", "eukarya": "Eukaryotic", "pro": "Prokaryotic_Unclassified", "prokarya": "Prokaryotic_Unclassified",
}
PROBABILITY_COLUMNS = {"bacteria": "bac", "archaea": "arc", "eukarya": "euk", "organelle": "org", "plastid": "pla", "mitochondrion": "mit", "unknown": "unk1"}
EUKARYOTE_WORDS = ["eukaryote", "eukaryotic", "euk", "eukarya"]
PROKARYOTE_WORDS = ["prokaryote", "prokaryotic", "prok", "prokarya", "bacteria", "archaea"]
PROKARYOTES = ["Bacterial", "Archaeal", "Prokaryotic_Unclassified"]


@dataclass(frozen=True)
class Policy:
    """What step 7 removes, and thresholds of the calls."""

    remove_prokaryotes: bool = True
    agree_only: bool = False
    prokaryote_min_length: int = 0
    remove_mitochondrial: bool = False
    remove_plastid: bool = False
    remove_unknown: bool = False
    high_confidence: float = 0.80
    override: float = 0.90
    tiara_min_length: int = 1000
    whokaryote_min_length: int = 1000
    rule_sources: tuple[str, ...] = ("whokaryote+tiara",)


def tiara_label(stage1: Column, stage2: Column) -> Column:
    """The first stage's call; the second only names an organelle. 'n/a' is text, not null."""
    first, second = F.lower(F.trim(F.coalesce(stage1, F.lit("")))), F.lower(F.trim(F.coalesce(stage2, F.lit(""))))
    organelle = second.isin(ORGANELLES)
    return F.when((first == "organelle") & organelle, second).when(first.isin(NO_LABEL), F.when(organelle, second).otherwise("unknown")).otherwise(first)


def tiara_probability(label: Column) -> Column:
    """The probability of the called label, null outside 0 to 1; prokarya is the sum of bac and arc."""
    both = F.col("bac") + F.col("arc")
    p = F.when(label == "prokarya", F.when(both.between(0.0, 1.0 + 1e-6), both))
    for name, column in PROBABILITY_COLUMNS.items():
        p = p.when(label == name, F.when(F.col(column).between(0.0, 1.0), F.col(column)))
    return p


def whokaryote_label(raw: Column) -> Column:
    """Eukaryote, prokaryote, or null for any other word."""
    word = F.lower(F.trim(raw))
    return F.when(word.isin(EUKARYOTE_WORDS), "eukaryote").when(word.isin(PROKARYOTE_WORDS), "prokaryote")


def category(label: Column) -> Column:
    """The category of a label."""
    pairs = [F.lit(x) for kv in CATEGORIES.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), label), F.lit("Unknown"))


# The ordered rules that decide a call; conflicts go to the gene-structure classifier unless the other is sure of its own call.
SOURCES = ["tiara_organelle", "conflict_tiara_override", "conflict_whokaryote_wins", "whokaryote+tiara", "whokaryote", "whokaryote", "tiara_only", "no_classifier_call"]
DEFAULTS = [0.90, None, 0.75, 0.90, 0.75, 0.85, 0.60, 0.0]


def rule(cat: Column, p: Column, who: Column, override: float = 0.90) -> Column:
    """The number, from 1, of the first rule in SOURCES that holds."""
    prok, euk = cat.isin(PROKARYOTES), cat == "Eukaryotic"
    w_prok, w_euk = F.coalesce(who == "prokaryote", F.lit(False)), F.coalesce(who == "eukaryote", F.lit(False))
    clash = (w_prok & euk) | (w_euk & prok)
    return (
        F.when(cat.isin("Mitochondrial", "Plastid"), 1).when(clash, F.when(F.coalesce(p >= override, F.lit(False)), 2).otherwise(3)).when((w_prok & prok) | (w_euk & euk), 4)
        .when(w_prok, 5).when(w_euk, 6).when(prok | euk, 7).otherwise(8)
    )


def resolved(x: DataFrame) -> DataFrame:
    """Classification, confidence, confidence_type, source and conflict from rule, category, tiara_prob and whokaryote_label."""
    r, p = F.col("rule"), F.col("tiara_prob")
    by_prok = F.when(F.col("whokaryote_label") == "prokaryote", "Prokaryotic_Unclassified").otherwise("Eukaryotic")
    default = F.element_at(F.array(*(F.lit(d).cast("double") for d in DEFAULTS)), r)
    graded = r.isin(1, 2, 4, 7) & p.isNotNull()
    return x.select(
        "*", F.when(r.isin(1, 2, 4, 7), F.col("category")).when(r.isin(3, 5, 6), by_prok).otherwise("Unknown").alias("classification"), F.when(graded, p.cast("double")).otherwise(default).alias("confidence"),
        F.when(graded, "probability").when(r == 8, "no_call").otherwise("rule_based").alias("confidence_type"), F.element_at(F.array(*map(F.lit, SOURCES)), r).alias("source"), r.isin(2, 3).alias("conflict"),
    )


def call_basis(policy: Policy) -> Column:
    """Why a contig is, or is not, classified."""
    below_t, below_w = F.col("length") < policy.tiara_min_length, F.col("length") < policy.whokaryote_min_length
    return (
        F.when(F.col("conflict"), "classifier_disagreement").when(F.col("classification") != "Unknown", F.col("source")).when(below_t & below_w, "below_all_classifier_cutoffs")
        .when(below_t, "below_tiara_cutoff_whokaryote_no_call").when(below_w, "below_whokaryote_cutoff_tiara_no_call").otherwise("classifier_no_call")
    )


def classify(calls: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """The classification table, from stage1, stage2, probabilities and whokaryote_raw; one pass, no shuffle."""
    x = calls.withColumn("tiara_label", tiara_label(F.col("stage1"), F.col("stage2")))
    x = x.withColumn("tiara_prob", tiara_probability(F.col("tiara_label"))).withColumn("whokaryote_label", whokaryote_label(F.col("whokaryote_raw")))
    x = x.withColumn("category", category(F.col("tiara_label")))
    x = x.withColumn("rule", rule(F.col("category"), F.col("tiara_prob"), F.col("whokaryote_label"), policy.override))
    return resolved(x).withColumn("call_basis", call_basis(policy)).drop("rule", "category")


def high_confidence(policy: Policy) -> Column:
    """A probability by its value; a rule by its source, never by its number."""
    kind = F.col("confidence_type")
    return F.when(kind == "probability", F.coalesce(F.col("confidence") >= policy.high_confidence, F.lit(False))).when(kind == "rule_based", F.col("source").isin(list(policy.rule_sources))).otherwise(F.lit(False))


def removed(policy: Policy) -> Column:
    """Is the contig removed for its domain?"""
    kind = F.col("classification")
    prok = F.lit(policy.remove_prokaryotes) & (F.col("length") >= policy.prokaryote_min_length) & (F.lit(not policy.agree_only) | (F.col("source") == "whokaryote+tiara"))
    return (
        F.when(kind.isin(PROKARYOTES), prok).when(kind == "Mitochondrial", F.lit(policy.remove_mitochondrial) & high_confidence(policy))
        .when(kind == "Plastid", F.lit(policy.remove_plastid) & high_confidence(policy)).when(kind == "Unknown", F.lit(policy.remove_unknown) & (F.col("confidence_type") == "no_call")).otherwise(F.lit(False))
    )


def retention_reason(policy: Policy) -> Column:
    """Why such a call was not removed."""
    kind = F.col("classification")
    prok = F.when(F.lit(not policy.remove_prokaryotes), "prokaryote_removal_disabled").when(F.col("length") < policy.prokaryote_min_length, "below_prokaryote_min_length")
    prok = prok.when(F.lit(policy.agree_only) & (F.col("source") != "whokaryote+tiara"), "no_tiara_whokaryote_agreement").otherwise("prokaryote_call_retained")
    return (
        F.when(kind.isin(PROKARYOTES), prok)
        .when(kind == "Mitochondrial", "mitochondrial_below_confidence" if policy.remove_mitochondrial else "mitochondrial_flagged_not_removed")
        .when(kind == "Plastid", "plastid_below_confidence" if policy.remove_plastid else "plastid_flagged_not_removed").when(kind == "Unknown", "unknown_no_classifier_call_kept").otherwise("")
    )


def removal_table(contigs: DataFrame, classified: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Every contig with removed and reason; one without a call is kept and listed."""
    c = classified.select("contig_id", "classification", "confidence", "confidence_type", "source")
    x = contigs.select("contig_id", "length").join(c, "contig_id", "left")
    gone = F.coalesce(removed(policy), F.lit(False))
    return x.select("contig_id", gone.alias("removed"), F.when(F.col("classification").isNull(), "no_classification").when(gone, F.lower("classification")).otherwise(retention_reason(policy)).alias("reason"))
