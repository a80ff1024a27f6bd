"""Coverage tables in long form: validation, normalisation and neighbourhood features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamwork.operators.quantiles import quantiles


def violations(coverage: DataFrame, expected: list[str] | None = None) -> DataFrame:
    """Counts of everything that makes a coverage table unusable, in one aggregate (and one for repeated keys)."""
    d = F.col("depth")
    bad = coverage.agg(
        F.sum(d.isNull().cast("long")).alias("n_null"), F.sum(F.isnan(d).cast("long")).alias("n_nan"), F.sum((F.abs(d) == float("inf")).cast("long")).alias("n_infinite"), F.sum((d < 0).cast("long")).alias("n_negative"),
        F.sum((~F.col("sample").isin(expected)).cast("long") if expected else F.lit(0).cast("long")).alias("n_unexpected_sample"),
    )
    twice = coverage.groupBy("contig_id", "sample").agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*").alias("n_repeated"))
    return bad.join(F.broadcast(twice))


def identical_rows(coverage: DataFrame) -> DataFrame:
    """How many contigs share all their depths with another; profiles meet by digest."""
    p = coverage.groupBy("contig_id").agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("sample", "depth")))), 256).alias("digest"))
    return p.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*").alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("contigs"))


def reconcile(contigs: DataFrame, coverage: DataFrame) -> DataFrame:
    """contig_id, side: both, contigs_only or coverage_only."""
    a = contigs.select("contig_id").distinct().withColumn("a", F.lit(True))
    b = coverage.select("contig_id").distinct().withColumn("b", F.lit(True))
    side = F.when(F.col("a") & F.col("b"), "both").when(F.col("a"), "contigs_only").otherwise("coverage_only")
    return a.join(b, "contig_id", "full").select("contig_id", side.alias("side"))


def prevalent(coverage: DataFrame) -> DataFrame:
    """Contigs with depth in any sample."""
    return coverage.groupBy("contig_id").agg(F.max("depth").alias("most")).where("most > 0").select("contig_id")


def caps(coverage: DataFrame, percentile: float = 99.5) -> DataFrame:
    """For each sample the cap (linear percentile of positive depths) and the scale, the median of capped positive depths."""
    positive = coverage.where("depth > 0").select("sample", "depth")
    cap = quantiles(positive, ["sample"], "depth", {"cap": percentile / 100.0})
    capped = positive.join(cap, "sample").select("sample", "depth", "cap", F.least("depth", "cap").alias("least"))
    over = capped.groupBy("sample").agg(F.first("cap").alias("cap"), F.sum((F.col("depth") > F.col("cap")).cast("long")).alias("n_capped"))
    return over.join(quantiles(capped, ["sample"], "least", {"scale": 0.5}), "sample").select("sample", "cap", "scale", "n_capped")


def normalized(coverage: DataFrame, percentile: float = 99.5) -> DataFrame:
    """V6: log1p of capped depth over its sample's scale."""
    c = caps(coverage, percentile).select("sample", "cap", "scale")
    value = F.log1p(F.least("depth", "cap") / F.when(F.col("scale") > 0, F.col("scale")).otherwise(1.0))
    return coverage.join(c, "sample").select("contig_id", "sample", value.alias("value"))


def matrix(values: DataFrame, samples: list[str]) -> DataFrame:
    """contig_id and an array of values in the order of samples; absent ones are 0."""
    one = [F.coalesce(F.max(F.when(F.col("sample") == s, F.col("value"))), F.lit(0.0)) for s in samples]
    return values.groupBy("contig_id").agg(F.array(*one).alias("vec"))


def present(coverage: DataFrame) -> DataFrame:
    """Samples with depth of each contig."""
    return coverage.groupBy("contig_id").agg(F.sum((F.col("depth") > 0).cast("long")).alias("n_samples_present"))


def distance_features(neighbours: DataFrame, clip: float | None = None) -> DataFrame:
    """Mean and population deviation of each contig's neighbour distances."""
    d = F.least("distance", F.lit(clip)) if clip else F.col("distance")
    return neighbours.groupBy("query_id").agg(F.avg(d).alias("mean_dist"), F.stddev_pop(d).alias("std_dist")).withColumnRenamed("query_id", "contig_id")


def feature_rows(contigs: DataFrame, vectors: DataFrame, present_: DataFrame, distances: DataFrame, n_samples: int) -> DataFrame:
    """[valid_mask, n_samples_present, mean_dist, std_dist, cov...] of all contigs; zeros where there is no coverage."""
    x = contigs.select("contig_id").join(vectors, "contig_id", "left").join(present_, "contig_id", "left").join(distances, "contig_id", "left")
    zero = F.array_repeat(F.lit(0.0), n_samples)
    head = F.array(F.when(F.col("vec").isNull(), 0.0).otherwise(1.0), F.coalesce(F.col("n_samples_present").cast("double"), F.lit(0.0)), F.coalesce("mean_dist", F.lit(0.0)), F.coalesce("std_dist", F.lit(0.0)))
    return x.select("contig_id", F.concat(head, F.coalesce("vec", zero)).alias("features"))


def final_table(coverage: DataFrame, kept: DataFrame) -> DataFrame:
    """The coverage of the final contigs with their place in the contig order; a writer sorts by it in parallel ranges."""
    return coverage.join(kept.select("contig_id", "ord"), "contig_id")


def aligned(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows (ord, contig_id) that two manifests don't share."""
    return a.exceptAll(b).withColumn("only_in", F.lit("first")).union(b.exceptAll(a).withColumn("only_in", F.lit("second")))


def manifest_hash(contigs: DataFrame) -> DataFrame:
    """The first 16 digits of a digest of all ids in order.

    A digest of sorted ids is one value by definition; the ids of a shard are joined first.
    """
    joined = contigs.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "contig_id"))), lambda s: s["contig_id"]), "\n").alias("ids"))
    return joined.select(F.substring(F.sha2("ids", 256), 1, 16).alias("manifest"))
