"""Statistics of groups of vectors: centroids, radii, shape models, misfit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamwork.functions import vectors as V
from loamwork.operators.quantiles import quantiles


def _field(name: str):
    return lambda s: s[name]


def _rebuilt(rows: DataFrame, keys: list[str], *columns: str) -> DataFrame:
    """Arrays in position order from rows of positions; a group has as many rows as its vectors are wide."""
    x = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", *columns))).alias("r"))
    return x.select(*keys, *(F.transform("r", _field(c)).alias(c) for c in columns))


def means(rows: DataFrame, key: str, vec: str = "vec") -> DataFrame:
    """key, mean: position by position, with partial sums before the shuffle."""
    by = rows.select(key, F.posexplode(vec).alias("pos", "x")).groupBy(key, "pos").agg(F.avg("x").alias("mean"))
    return _rebuilt(by, [key], "mean")


def centroids(rows: DataFrame, key: str = "label", vec: str = "u") -> DataFrame:
    """Key, centroid (the normalised mean) and radius (the median distance, at least 1e-6)."""
    c = means(rows, key, vec).select(key, V.unit(F.col("mean")).alias("centroid"))
    far = rows.join(c, key).select(key, V.distance(F.col(vec), F.col("centroid")).alias("d"))
    return c.join(quantiles(far, [key], "d", {"half": 0.5}).select(key, F.greatest("half", F.lit(1e-6)).alias("radius")), key)


def shape_models(rows: DataFrame, key: str = "label", vec: str = "shape", floor: float = 0.05) -> DataFrame:
    """Key, median and sd (1.4826 median absolute deviations, at least floor) position by position."""
    x = rows.select(key, F.posexplode(vec).alias("pos", "x"))
    m = quantiles(x, [key, "pos"], "x", {"median": 0.5})
    far = x.join(m, [key, "pos"]).select(key, "pos", F.abs(F.col("x") - F.col("median")).alias("far"))
    sd = quantiles(far, [key, "pos"], "far", {"half": 0.5}).select(key, "pos", F.greatest(F.col("half") * 1.4826, F.lit(floor)).alias("sd"))
    return _rebuilt(m.join(sd, [key, "pos"]), [key], "median", "sd")


def shape_scores(rows: DataFrame, models: DataFrame, key: str = "label", vec: str = "shape") -> DataFrame:
    """Rows with z, the misfit to their own group's model."""
    return rows.join(models, key).withColumn("z", V.shape_z(F.col(vec), F.col("median"), F.col("sd"))).drop("median", "sd")


def misfit(rows: DataFrame, models: DataFrame, limit: float, key: str = "label", vec: str = "shape") -> DataFrame:
    """For each group and each other group's model, the share of its rows beyond the limit. Models are few."""
    m = models.select(F.col(key).alias("under"), "median", "sd")
    x = rows.select(F.col(key).alias("of"), vec).join(F.broadcast(m), F.col("of") != F.col("under"))
    return x.groupBy("of", "under").agg(F.avg((V.shape_z(F.col(vec), F.col("median"), F.col("sd")) > limit).cast("double")).alias("misfit"))


def standardized(rows: DataFrame, mask: str = "mask", vec: str = "vec") -> DataFrame:
    """Vec less the mean over the masked rows, over their population deviation (0 counts as 1)."""
    x = rows.where(mask).select(F.posexplode(vec).alias("pos", "x")).groupBy("pos").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd"))
    s = _rebuilt(x.withColumn("one", F.lit(0)), ["one"], "mean", "sd").drop("one")
    z = F.zip_with(F.zip_with(vec, "mean", lambda a, b: a - b), "sd", lambda a, b: a / F.when(b == 0, 1.0).otherwise(b))
    return rows.join(F.broadcast(s)).withColumn(vec, z).drop("mean", "sd")


def pair_table(rows: DataFrame, profile: str = "shape", key: str = "label") -> DataFrame:
    """A, b, separation (centroid distance over the mean radius) and coverage (mean shape difference over the median MAD).

    Groups are few; the table has a row for each pair of them.
    """
    c = centroids(rows, key)
    x = rows.select(key, F.posexplode(profile).alias("pos", "x"))
    med = x.groupBy(key, "pos").agg(F.median("x").alias("median"))
    mad = x.join(F.broadcast(med), [key, "pos"]).groupBy(key, "pos").agg(F.median(F.abs(F.col("x") - F.col("median"))).alias("mad"))
    sd = _rebuilt(mad.groupBy("pos").agg(F.greatest(F.median("mad") * 1.4826, F.lit(1e-3)).alias("scale")).withColumn("one", F.lit(0)), ["one"], "scale").drop("one")
    g = c.join(_rebuilt(med, [key], "median"), key).join(F.broadcast(sd))
    side = lambda s: g.select(F.col(key).alias(s), F.col("centroid").alias(f"c{s}"), F.col("radius").alias(f"r{s}"), F.zip_with("median", "scale", lambda p, q: p / q).alias(f"m{s}"))
    p = side("a").join(F.broadcast(side("b")), F.col("a") < F.col("b"))
    diff = V.mean(F.zip_with("ma", "mb", lambda p, q: F.abs(p - q)))
    return p.select("a", "b", (V.distance(F.col("ca"), F.col("cb")) / (0.5 * (F.col("ra") + F.col("rb")))).alias("separation"), diff.alias("coverage"))


def pooled_z(rows: DataFrame, pairs: DataFrame, key: str = "label", vec: str = "shape", floor: float = 0.05) -> DataFrame:
    """A, b, z of each pair of groups: the mean over positions of how far their medians are apart, in pooled deviations.

    A position's deviation is 1.4826 times the median distance of both groups' rows from their own group's median, at least floor.
    """
    ends = pairs.select("a", "b", F.explode(F.array("a", "b")).alias(key)).distinct()
    x = rows.select(key, F.posexplode(vec).alias("pos", "x"))
    medians = x.groupBy(key, "pos").agg(F.median("x").alias("m"))
    far = x.join(medians, [key, "pos"]).select(key, "pos", F.abs(F.col("x") - F.col("m")).alias("far"))
    pooled = far.join(ends, key).groupBy("a", "b", "pos").agg(F.greatest(F.median("far") * 1.4826, F.lit(floor)).alias("sd"))
    for s in "ab":
        pooled = pooled.join(medians.select(F.col(key).alias(s), "pos", F.col("m").alias(f"m_{s}")), [s, "pos"])
    return pooled.groupBy("a", "b").agg(F.avg(F.abs(F.col("m_a") - F.col("m_b")) / F.col("sd")).alias("z"))
