"""Adaptive coverage filter and scoring by several signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamwork.operators.classify import PROKARYOTES, Policy, removed, retention_reason


def split_columns(names: list[str]) -> tuple[list[str], list[str]]:
    """Depth and breadth columns of a wide coverage table, by what their names hold."""
    breadth = [n for n in names if "covered" in n.lower() or "breadth" in n.lower()]
    depth = [n for n in names if n not in breadth and "mean" in n.lower()]
    return depth, breadth


def adaptive_stats(coverage: DataFrame, stat: str = "sample", min_breadth: float = 0.3, n_samples: int | None = None) -> DataFrame:
    """contig_id, coverage, breadth, n_present of a long table. 'sample' keeps depth and breadth of one sample."""
    present = F.sum((F.col("depth") > 0).cast("long")).alias("n_present")
    by = coverage.groupBy("contig_id")
    if stat == "sample":
        ok = F.col("breadth") >= min_breadth
        best = F.min(F.when(ok, F.struct((-F.col("depth")).alias("below"), "sample", "breadth")))  # of equal depths the first sample
        x = by.agg(best.alias("best"), F.max("breadth").alias("most"), present)
        return x.select("contig_id", F.coalesce(-F.col("best.below"), F.lit(0.0)).alias("coverage"), F.coalesce("best.breadth", "most").alias("breadth"), "n_present")
    if stat == "max":
        return by.agg(F.max("depth").alias("coverage"), F.max("breadth").alias("breadth"), present)
    if stat == "mean":  # samples without a row count as zero
        n = F.lit(float(n_samples)) if n_samples else F.count("*")
        return by.agg((F.sum("depth") / n).alias("coverage"), (F.sum("breadth") / n).alias("breadth"), present)
    raise ValueError(f"stat is sample, max or mean, not {stat}")


def adaptive_filter(contigs: DataFrame, stats: DataFrame, low: int, high: int, min_coverage: float = 2.0, min_samples: int = 1, min_breadth: float = 0.3, keep_short: bool = True) -> DataFrame:
    """contig_id, kept, low_breadth and reason. Only lengths from low to high are filtered by coverage."""
    x = contigs.select("contig_id", "length").join(stats, "contig_id", "left").fillna({"coverage": 0.0, "breadth": 0.0, "n_present": 0})
    ok = (F.col("coverage") >= min_coverage) & (F.col("n_present") >= min_samples) & (F.col("breadth") >= min_breadth)
    length = F.col("length")
    reason = F.when(length < low, "too_short").when(length >= high, "main").when(ok, "short_survivor" if keep_short else "short_not_used").otherwise("below_adaptive_thresholds")
    return x.select("contig_id", reason.isin("main", "short_survivor").alias("kept"), ((length >= high) & (F.col("breadth") < min_breadth)).alias("low_breadth"), reason.alias("reason"))


def coverage_variation(coverage: DataFrame, n_samples: int) -> DataFrame:
    """Mean and CV over all samples (absent rows are zero depth); CV is null for one sample and 0 without coverage."""
    n = float(n_samples)
    x = coverage.groupBy("contig_id").agg(F.sum("depth").alias("s"), F.sum(F.col("depth") * F.col("depth")).alias("ss"))
    mean = F.col("s") / n
    deviation = F.sqrt(F.greatest(F.lit(0.0), (F.col("ss") - F.col("s") * F.col("s") / n) / (n - 1))) if n_samples > 1 else F.lit(None).cast("double")
    return x.select("contig_id", mean.alias("mean_cov"), F.when(mean > 0, deviation / mean).otherwise(0.0).alias("cov_cv"))


def z_scores(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Z-scores of columns under new names, by population deviations (0 counts as 1), from one aggregate."""
    stats = rows.agg(*(f(c).alias(f"{n}_{c}") for c in columns for n, f in (("mean", F.avg), ("sd", F.stddev_pop))))
    out = rows.join(F.broadcast(stats))  # one row
    for c, name in columns.items():
        out = out.withColumn(name, (F.col(c) - F.col(f"mean_{c}")) / F.when(F.col(f"sd_{c}") == 0, 1.0).otherwise(F.col(f"sd_{c}")))
    return out.drop(*stats.columns)


def warnings(policy: Policy, cv: float = 1.5, gc: float = 3.0, tnf: float | None = 2.5) -> Column:
    """The warnings of a contig, in their order."""
    kind = F.col("classification")
    tests = [
        (F.coalesce(F.col("cov_cv") > cv, F.lit(False)), F.lit("high coverage variance")),
        (F.abs("gc_z") > gc, F.lit("GC outlier")),
        *([(F.abs("tnf_z") > tnf, F.lit("TNF composition outlier"))] if tnf is not None else []),
        (kind == "Unknown", F.lit("unclassified")),
        (kind.isin(PROKARYOTES), F.concat(F.lit("prokaryote call retained: "), retention_reason(policy))),
        (kind.isin("Mitochondrial", "Plastid"), F.concat(F.lower(kind), F.lit(" call retained: "), retention_reason(policy))),
        (F.coalesce(F.col("low_breadth"), F.lit(False)), F.lit("low breadth")),
    ]
    return F.filter(F.array(*(F.when(test, text) for test, text in tests)), lambda x: x.isNotNull())


def decisions(scored: DataFrame, policy: Policy = Policy(), **limits) -> DataFrame:
    """contig_id, decision, reasons. Two warnings make a contig uncertain; only the domain policy removes."""
    w = F.col("warnings")
    x = scored.withColumn("warnings", warnings(policy, **limits)).withColumn("gone", removed(policy))
    decision = F.when(F.col("gone"), "remove_high_confidence_contaminant").when(F.size(w) >= 2, "uncertain").when(F.size(w) == 1, "retain_with_warning").otherwise("retain")
    flags = F.when(F.col("gone"), F.array(F.concat(F.lit("borderline "), "classification"))).otherwise(F.array().cast("array<string>"))
    return x.select("contig_id", decision.alias("decision"), F.concat_ws("; ", w, flags).alias("reasons"))
