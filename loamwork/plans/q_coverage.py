"""Queries on coverage tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from loamwork.operators import coverage, neighbours, mapping
from loamwork.plans import fixtures as fx
from loamwork.plans.registry import query
from loamwork.plans.workspace import settled

SAMPLES = ["AF", "AO", "NF", "NO", "RF", "RO"]
D = f"WITH {fx.DEPTH}"
NORM = D + """, cap AS (SELECT sample, quantile_cont(depth, 0.95) AS cap FROM cov WHERE depth > 0 GROUP BY 1),
sc AS (SELECT sample, any_value(cap) AS cap, median(least(depth, cap)) AS scale, CAST(sum((depth > cap)::INT) AS BIGINT) AS n_capped FROM cov JOIN cap USING (sample) WHERE depth > 0 GROUP BY 1),
nm AS (SELECT contig_id, sample, ln(1 + least(depth, cap) / CASE WHEN scale > 0 THEN scale ELSE 1 END) AS value FROM cov JOIN sc USING (sample))"""
MAT = NORM + ", mat AS (SELECT contig_id, [" + ", ".join(f"coalesce(max(CASE WHEN sample = '{s}' THEN value END), 0)" for s in SAMPLES) + "] AS vec FROM nm GROUP BY 1)"


def _matrix(spark, sf_dir):
    return coverage.matrix(coverage.normalized(fx.depth(spark, sf_dir), 95.0), SAMPLES)


@query(D + " SELECT 0::BIGINT AS n_null, 0::BIGINT AS n_nan, 0::BIGINT AS n_infinite, CAST(sum((depth < 0)::INT) AS BIGINT) AS n_negative, CAST(sum((sample NOT IN ('AF', 'NF', 'NO'))::INT) AS BIGINT) AS n_unexpected_sample, 0::BIGINT AS n_repeated FROM cov")
def coverage_violations(spark, sf_dir):
    """What is wrong with a coverage table."""
    return coverage.violations(fx.depth(spark, sf_dir), ["AF", "NF", "NO"])


@query(D + ", p AS (SELECT contig_id, list(sample || ':' || depth ORDER BY sample) AS key FROM cov GROUP BY 1), g AS (SELECT key, count(*) AS n FROM p GROUP BY 1 HAVING count(*) > 1) SELECT count(*) AS groups, CAST(coalesce(sum(n), 0) AS BIGINT) AS contigs FROM g")
def coverage_identical(spark, sf_dir):
    """Contigs with identical rows."""
    return coverage.identical_rows(fx.depth(spark, sf_dir))


@query(D + ", u AS (SELECT contig_id FROM ids), v AS (SELECT DISTINCT contig_id FROM cov) SELECT coalesce(u.contig_id, v.contig_id) AS contig_id, CASE WHEN u.contig_id IS NULL THEN 'coverage_only' WHEN v.contig_id IS NULL THEN 'contigs_only' ELSE 'both' END AS side FROM u FULL JOIN v ON u.contig_id = v.contig_id")
def coverage_reconcile(spark, sf_dir):
    """Ids of two sources."""
    return coverage.reconcile(fx.part_contigs(spark, sf_dir), fx.depth(spark, sf_dir))


@query(D + " SELECT contig_id FROM cov GROUP BY 1 HAVING max(depth) > 0")
def coverage_prevalent(spark, sf_dir):
    """Contigs with any coverage."""
    return coverage.prevalent(fx.depth(spark, sf_dir))


@query(NORM + " SELECT sample, cap, scale, n_capped FROM sc")
def coverage_scales(spark, sf_dir):
    """Caps and scales."""
    return coverage.caps(fx.depth(spark, sf_dir), 95.0)


@query(NORM + " SELECT contig_id, sample, round(value, 6) AS value FROM nm")
def coverage_normalized(spark, sf_dir):
    """V6: normalised coverage."""
    n = coverage.normalized(fx.depth(spark, sf_dir), 95.0)
    return n.withColumn("value", F.round("value", 6))


@query(D + " SELECT contig_id, CAST(sum((depth > 0)::INT) AS BIGINT) AS n_samples_present FROM cov GROUP BY 1")
def samples_present(spark, sf_dir):
    """Samples with depth."""
    return coverage.present(fx.depth(spark, sf_dir))


KNN = MAT + """, kn AS (SELECT query_id, ref_id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, ref_id) AS rank FROM (SELECT a.contig_id AS query_id, b.contig_id AS ref_id, list_distance(a.vec, b.vec) AS distance FROM mat a, mat b WHERE a.contig_id <> b.contig_id)),
df AS (SELECT query_id AS contig_id, avg(distance) AS mean_dist, stddev_pop(distance) AS std_dist FROM kn WHERE rank <= 10 GROUP BY 1)"""


def _distances(m):
    return coverage.distance_features(neighbours.knn_distinct(m, 10))


@query(KNN + " SELECT contig_id, round(mean_dist, 5) AS mean_dist, round(std_dist, 5) AS std_dist FROM df")
def coverage_neighbours(spark, sf_dir):
    """Mean and deviation of the distances of ten neighbours."""
    d = _distances(settled(_matrix(spark, sf_dir)))
    return d.select("contig_id", F.round("mean_dist", 5).alias("mean_dist"), F.round("std_dist", 5).alias("std_dist"))


@query(KNN + """, pr AS (SELECT contig_id, sum((depth > 0)::INT) AS n FROM cov GROUP BY 1),
al AS (SELECT ids.contig_id, list_concat([CASE WHEN vec IS NULL THEN 0.0 ELSE 1.0 END, coalesce(n, 0)::DOUBLE, coalesce(mean_dist, 0), coalesce(std_dist, 0)], coalesce(vec, [0, 0, 0, 0, 0, 0]::DOUBLE[])) AS f FROM ids LEFT JOIN mat USING (contig_id) LEFT JOIN pr USING (contig_id) LEFT JOIN df USING (contig_id))
SELECT contig_id, CAST(i - 1 AS INT) AS pos, round(f[i], 5) AS x FROM (SELECT contig_id, f, unnest(range(1, 11)) AS i FROM al)""")
def coverage_features(spark, sf_dir):
    """The feature rows of all contigs, placeholders included."""
    m = settled(_matrix(spark, sf_dir))
    rows = coverage.feature_rows(fx.part_contigs(spark, sf_dir), m, coverage.present(fx.depth(spark, sf_dir)), _distances(m), 6)
    return rows.select("contig_id", F.posexplode("features").alias("pos", "x")).withColumn("x", F.round("x", 5))


@query(D + " SELECT contig_id, sample, depth, contig_id AS ord FROM cov JOIN ids USING (contig_id) WHERE length >= 6000")
def coverage_final(spark, sf_dir):
    """Coverage of the final contigs."""
    kept = fx.part_contigs(spark, sf_dir).where("length >= 6000").withColumn("ord", F.col("contig_id"))
    return coverage.final_table(fx.depth(spark, sf_dir), kept).select("contig_id", "sample", "depth", "ord")


@query("WITH a AS (SELECT p_partkey AS ord, p_partkey AS contig_id FROM part), b AS (SELECT p_partkey AS ord, CASE WHEN p_partkey % 400 = 0 THEN -1 ELSE p_partkey END AS contig_id FROM part) SELECT *, 'first' AS only_in FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'second' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)")
def manifest_alignment(spark, sf_dir):
    """Manifests that don't agree."""
    a = fx.part_contigs(spark, sf_dir).select(F.col("contig_id").alias("ord"), "contig_id")
    b = a.select("ord", F.when(F.col("ord") % 400 == 0, F.lit(-1)).otherwise(F.col("contig_id")).alias("contig_id"))
    return coverage.aligned(a, b)


@query("SELECT substr(sha256(string_agg(CAST(p_partkey AS VARCHAR), chr(10) ORDER BY p_partkey)), 1, 16) AS manifest FROM part")
def manifest_hash(spark, sf_dir):
    """The digest of a contig order."""
    return coverage.manifest_hash(fx.part_contigs(spark, sf_dir).select(F.col("contig_id").alias("ord"), F.col("contig_id").cast("string").alias("contig_id")))


@query(f"""WITH {fx.HITS}, s AS (SELECT contig_id, target AS sample, least(qstart, qend) - 1 AS lo, greatest(qstart, qend) AS hi FROM hits), b AS (SELECT contig_id, sample, unnest(range(CAST(lo AS BIGINT), CAST(hi AS BIGINT))) AS base FROM s)
SELECT contig_id, sample, round(count(*) / any_value(length), 9) AS depth, round(count(DISTINCT base) / any_value(length), 9) AS breadth FROM b JOIN ids USING (contig_id) GROUP BY 1, 2""")
def span_depth(spark, sf_dir):
    """Mean depth and covered share of each contig and target by a sweep over spans' ends; the SQL counts every base."""
    h = fx.hits(spark, sf_dir)
    spans = h.select("contig_id", F.col("target").alias("sample"), (F.least("qstart", "qend") - 1).alias("lo"), F.greatest("qstart", "qend").alias("hi"))
    d = mapping.depth_and_breadth(spans, fx.part_contigs(spark, sf_dir), ["contig_id", "sample"])
    return d.select("contig_id", "sample", F.round("depth", 9).alias("depth"), F.round("breadth", 9).alias("breadth"))


@query()
def mapped_depth(spark, sf_dir):
    """Reads of all contigs mapped by their seeds, and the depth and breadth that they make."""
    c = settled(fx.letters(spark, sf_dir))  # letters cost more than what is read of them
    return mapping.coverage(fx.reads_of(c), c)
