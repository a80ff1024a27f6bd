"""Queries on label vectors and groups of vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from loamwork.functions import vectors as V
from loamwork.operators import bins, groups
from loamwork.plans import fixtures as fx
from loamwork.plans.registry import query

L = f"WITH {fx.LATENT}"


def rows(spark, sf_dir):
    """Latents with unit vectors u, coverage shapes and masks."""
    x = fx.latent(spark, sf_dir).withColumn("u", V.unit(F.col("vec")))
    return x.withColumn("shape", V.shape(V.profile(F.col("profile")))).withColumn("pool", F.col("length") >= 1000).withColumn("eligible", F.col("length") >= 2000)


BINS = L + """, sz AS (SELECT label, count(*) AS n_contigs, CAST(sum(length) AS BIGINT) AS total_bp, max(length) AS max_len, CAST(floor(avg(length)) AS BIGINT) AS mean_len FROM lat WHERE label >= 0 GROUP BY 1),
cu AS (SELECT label, length, sum(length) OVER (PARTITION BY label ORDER BY length DESC, contig_id ROWS UNBOUNDED PRECEDING) AS run, sum(length) OVER (PARTITION BY label) AS total FROM lat WHERE label >= 0),
n5 AS (SELECT label, max(length) AS n50 FROM cu WHERE run >= total / 2.0 GROUP BY 1), bs AS (SELECT * FROM sz JOIN n5 USING (label)),
dn AS (SELECT label, CAST(row_number() OVER (ORDER BY label) AS INT) AS dense, 'bin_' || lpad(CAST(row_number() OVER (ORDER BY label) AS VARCHAR), CAST(greatest(3, length(CAST(count(*) OVER () AS VARCHAR))) AS INT), '0') AS bin_id FROM sz)"""


@query(BINS + " SELECT label, dense, bin_id FROM dn")
def dense_bins(spark, sf_dir):
    """Dense identifiers."""
    return bins.dense_ids(rows(spark, sf_dir))


@query(BINS + """ SELECT bin_id, n_contigs, total_bp, mean_len, max_len, n50 FROM bs JOIN dn USING (label)
UNION ALL SELECT 'unbinned', count(*), CAST(coalesce(sum(length), 0) AS BIGINT), CAST(coalesce(floor(avg(length)), 0) AS BIGINT), coalesce(max(length), 0), 0 FROM lat WHERE label < 0""")
def bin_summary(spark, sf_dir):
    """The bin summary."""
    return bins.summary(rows(spark, sf_dir))


@query(BINS + """, fl AS (SELECT label, CASE WHEN n_contigs < 43 THEN 'too_few_contigs' WHEN total_bp < 215000 THEN 'too_short' WHEN n50 < 6800 THEN 'low_n50' ELSE '' END AS reason FROM bs)
SELECT contig_id, CASE WHEN coalesce(reason, '') <> '' THEN -1 ELSE label END AS label, coalesce(reason, '') AS reason FROM lat LEFT JOIN fl USING (label)""")
def bin_filter(spark, sf_dir):
    """Bins that are too small, short or fragmented become noise."""
    return bins.filter_bins(rows(spark, sf_dir), 43, 215000, 6800).select("contig_id", "label", "reason")


@query(L + " SELECT contig_id, CASE WHEN contig_id % 13 = 0 THEN 'invalid_coverage' WHEN length < 2000 THEN 'too_short' ELSE '' END AS reason, contig_id % 13 <> 0 AND length >= 2000 AS eligible FROM lat")
def eligibility(spark, sf_dir):
    """What takes part in clustering."""
    x = rows(spark, sf_dir).drop("eligible").withColumn("valid_mask", (F.col("contig_id") % 13 != 0).cast("int"))
    return bins.eligibility(x, 2000).select("contig_id", "reason", "eligible")


@query(L + " SELECT contig_id FROM lat WHERE length >= 4500 AND prob >= 0.6")
def anchors(spark, sf_dir):
    """Anchors by relaxing tiers (the second holds enough)."""
    x = rows(spark, sf_dir).withColumn("weight", F.col("prob")).withColumn("variance", F.lit(1.0))
    tiers = [(9490.0, 0.95, 0.5), (4500.0, 0.6, 2.0), (1000.0, 0.5, float("inf")), (1000.0, 0.0, float("inf"))]
    return bins.anchors(x, tiers).select("contig_id")


@query(L + ", m AS (SELECT greatest(10, count(*) // 10) AS m FROM lat) SELECT contig_id FROM (SELECT contig_id, row_number() OVER (ORDER BY length DESC, contig_id DESC) AS k FROM lat) WHERE k <= (SELECT m FROM m)")
def anchors_longest(spark, sf_dir):
    """Without any tier, the longest tenth."""
    x = rows(spark, sf_dir).withColumn("weight", F.col("prob")).withColumn("variance", F.lit(1.0))
    return bins.anchors(x, [(1e9, 0.0, 1.0)]).select("contig_id")


@query(L + " SELECT contig_id, CAST(CASE WHEN prob < 0.5 THEN -1 ELSE label END AS INT) AS label FROM lat")
def probability_filter(spark, sf_dir):
    """Uncertain members become noise."""
    return bins.probability_filter(rows(spark, sf_dir), 0.5).select("contig_id", "label")


@query(BINS + ", k AS (SELECT total_bp AS x, row_number() OVER (ORDER BY total_bp) AS k FROM sz) SELECT (2 * sum(k * x) - (count(*) + 1) * sum(x)) / CAST(count(*) * sum(x) AS DOUBLE) AS size_gini FROM k")
def size_gini(spark, sf_dir):
    """Inequality of bin sizes."""
    return bins.size_gini("total_bp", bins.bin_sizes(rows(spark, sf_dir)))


@query(L + """ SELECT 100.0 * count(*) FILTER (label < 0 AND length >= 1000) / CAST(count(*) FILTER (length >= 1000) AS DOUBLE) AS noise_pct, 100.0 * count(*) FILTER (label < 0 AND length >= 2000) / CAST(count(*) FILTER (length >= 2000) AS DOUBLE) AS noise_pct_eligible,
 100.0 * sum(length) FILTER (label >= 0 AND length >= 1000) / CAST(sum(length) FILTER (length >= 1000) AS DOUBLE) AS assigned_bp_pct FROM lat""")
def assigned_shares(spark, sf_dir):
    """Noise and assigned sequence."""
    return bins.shares(rows(spark, sf_dir))


@query(L + " SELECT (SELECT count(*) FROM labels) AS n, (SELECT count(*) FROM labels WHERE doc_id IN (SELECT contig_id FROM lat)) AS matched, (SELECT count(*) FROM labels WHERE doc_id IN (SELECT contig_id FROM lat)) >= 0.5 * (SELECT count(*) FROM labels) AS usable")
def known_ids(spark, sf_dir):
    """Does a table fit the contigs?"""
    return bins.known_ids(fx.table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "contig_id"), rows(spark, sf_dir))


@query("""WITH b AS (SELECT DISTINCT l_suppkey AS set_id, l_partkey AS contig_id FROM lineitem), a AS (SELECT DISTINCT l_suppkey // 2 AS out_id, l_partkey AS contig_id FROM lineitem WHERE l_suppkey % 10 <> 3),
t AS (SELECT set_id, count(*) AS k FROM b GROUP BY 1), i AS (SELECT out_id, set_id, count(*) AS n FROM a JOIN b USING (contig_id) GROUP BY 1, 2), g AS (SELECT out_id, count(*) AS sources, sum(k) AS covered FROM i JOIN t USING (set_id) WHERE n = k GROUP BY 1)
SELECT out_id, sources, covered = (SELECT count(*) FROM a WHERE a.out_id = g.out_id) AS exact FROM g""")
def merge_provenance(spark, sf_dir):
    """Which bins a merged bin holds whole."""
    li = fx.table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").distinct()
    before = li.select(F.col("l_suppkey").alias("set_id"), F.col("l_partkey").alias("contig_id"))
    after = li.where("l_suppkey % 10 <> 3").select(F.expr("l_suppkey div 2").alias("out_id"), F.col("l_partkey").alias("contig_id")).distinct()
    return bins.merge_covers(before, after)


@query("SELECT least(a, b) AS bin_1, greatest(a, b) AS bin_2, CAST(sum(n) AS BIGINT) AS links FROM (SELECT 'bin_' || l_suppkey % 7 AS a, 'bin_' || l_partkey % 5 AS b, l_linenumber AS n FROM lineitem WHERE l_linenumber <> 4) WHERE a <> b GROUP BY 1, 2")
def link_sums(spark, sf_dir):
    """Links between bins, without malformed rows."""
    li = fx.table(spark, sf_dir, "lineitem")
    n = F.when(F.col("l_linenumber") == 4, "x").otherwise(F.col("l_linenumber").cast("string"))
    return bins.link_sums(li.select(F.concat(F.lit("bin_"), F.col("l_suppkey") % 7).alias("bin_1"), F.concat(F.lit("bin_"), F.col("l_partkey") % 5).alias("bin_2"), n.alias("links")))


SHAPES = fx.LATENT + """, pr AS (SELECT *, list_transform(profile, lambda x: ln(1 + x)) AS p FROM nv), sp AS (SELECT *, list_transform(p, lambda x: x - list_avg(p)) AS shape FROM pr),
ex AS (SELECT contig_id, label, unnest(shape) AS x, unnest(range(0, 5)) AS pos FROM sp WHERE label >= 0), md AS (SELECT label, pos, median(x) AS m FROM ex GROUP BY 1, 2),
sm AS (SELECT label, pos, any_value(m) AS m, greatest(median(abs(x - m)) * 1.4826, 0.05) AS sd FROM ex JOIN md USING (label, pos) GROUP BY 1, 2),
zs AS (SELECT contig_id, label, avg(abs(x - m) / sd) AS z FROM ex JOIN sm USING (label, pos) GROUP BY 1, 2)"""


@query(f"WITH {SHAPES} SELECT label, CAST(pos AS INT) AS pos, round(m, 6) AS median, round(sd, 6) AS sd FROM sm")
def shape_models(spark, sf_dir):
    """The coverage shape model of each bin."""
    m = groups.shape_models(rows(spark, sf_dir).where("label >= 0"))
    x = m.select("label", F.posexplode(F.arrays_zip("median", "sd")).alias("pos", "v"))
    return x.select("label", "pos", F.round("v.median", 6).alias("median"), F.round("v.sd", 6).alias("sd"))


@query(f"WITH {SHAPES} SELECT contig_id, label, round(z, 5) AS z FROM zs")
def shape_scores(spark, sf_dir):
    """How each member fits its bin's coverage."""
    r = rows(spark, sf_dir).where("label >= 0")
    return groups.shape_scores(r, groups.shape_models(r)).select("contig_id", "label", F.round("z", 5).alias("z"))


@query(f"WITH {SHAPES}, o AS (SELECT e.label AS \"of\", s.label AS under, e.contig_id, avg(abs(x - m) / sd) AS z FROM ex e JOIN sm s ON e.pos = s.pos AND e.label <> s.label GROUP BY 1, 2, 3) SELECT \"of\", under, avg((z > 1.2)::INT) AS misfit FROM o GROUP BY 1, 2")
def misfits(spark, sf_dir):
    """Misfit of each bin under each other bin's model."""
    r = rows(spark, sf_dir).where("label >= 0")
    return groups.misfit(r, groups.shape_models(r), 1.2)


CENTRES = SHAPES + """, me AS (SELECT label, pos, avg(x) AS x FROM (SELECT label, unnest(u) AS x, unnest(range(0, 64)) AS pos FROM nv WHERE label >= 0) GROUP BY 1, 2), mv AS (SELECT label, list(x ORDER BY pos) AS mean FROM me GROUP BY 1),
ce AS (SELECT label, mean, list_transform(mean, lambda x: x / sqrt(list_dot_product(mean, mean))) AS c FROM mv), ra AS (SELECT label, greatest(median(list_distance(u, c)), 1e-6) AS radius FROM nv JOIN ce USING (label) GROUP BY 1)"""


@query(f"WITH {CENTRES} SELECT label, round(radius, 6) AS radius, round(c[1], 6) AS first FROM ra JOIN ce USING (label)")
def centroids(spark, sf_dir):
    """Centroids and radii."""
    c = groups.centroids(rows(spark, sf_dir).where("label >= 0"))
    return c.select("label", F.round("radius", 6).alias("radius"), F.round(F.element_at("centroid", 1), 6).alias("first"))


@query(f"""WITH {CENTRES}, ma AS (SELECT label, pos, median(abs(x - m)) AS d FROM ex JOIN md USING (label, pos) GROUP BY 1, 2), sc AS (SELECT pos, greatest(median(d) * 1.4826, 1e-3) AS scale FROM ma GROUP BY 1),
cv AS (SELECT a.label AS a, b.label AS b, avg(abs(a.m - b.m) / scale) AS coverage FROM md a JOIN md b ON a.pos = b.pos AND a.label < b.label JOIN sc ON sc.pos = a.pos GROUP BY 1, 2)
SELECT cv.a, cv.b, round(list_distance(x.c, y.c) / (0.5 * (r.radius + s.radius)), 5) AS separation, round(coverage, 5) AS coverage FROM cv JOIN ce x ON x.label = cv.a JOIN ce y ON y.label = cv.b JOIN ra r ON r.label = cv.a JOIN ra s ON s.label = cv.b""")
def merge_candidates(spark, sf_dir):
    """The pair table that merging starts from."""
    p = groups.pair_table(rows(spark, sf_dir).where("label >= 0"))
    return p.select("a", "b", F.round("separation", 5).alias("separation"), F.round("coverage", 5).alias("coverage"))


@query(L + ", e AS (SELECT contig_id, length, unnest(vec) AS x, unnest(range(0, 64)) AS pos FROM lat), s AS (SELECT pos, avg(x) AS m, stddev_pop(x) AS sd FROM e WHERE length >= 3000 GROUP BY 1) SELECT contig_id, round(sum(abs((x - m) / CASE WHEN sd = 0 THEN 1 ELSE sd END)), 4) AS size FROM e JOIN s USING (pos) GROUP BY 1")
def standardized_features(spark, sf_dir):
    """Features by masked mean and deviation."""
    x = groups.standardized(rows(spark, sf_dir).withColumn("mask", F.col("length") >= 3000))
    return x.select("contig_id", F.round(V.total(F.transform("vec", F.abs)), 4).alias("size"))


@query(L + " SELECT contig_id, CAST(CASE WHEN contig_id % 3 = 0 THEN 0.0 ELSE round(vec[2], 6) END AS DOUBLE) AS second, round(vec[3], 6) AS third, least(1.0, greatest(0.0, 3 * prob - 1)) AS weight FROM lat")
def validated_features(spark, sf_dir):
    """NaN become 0 and weights are clipped."""
    x = rows(spark, sf_dir).withColumn("bad", F.transform("vec", lambda v, i: F.when((i == 1) & (F.col("contig_id") % 3 == 0), float("nan")).otherwise(v)))
    v = V.finite(F.col("bad"))
    return x.select("contig_id", F.round(F.element_at(v, 2), 6).alias("second"), F.round(F.element_at(v, 3), 6).alias("third"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), 3 * F.col("prob") - 1)).alias("weight"))


@query(L + " SELECT contig_id FROM lat WHERE contig_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def training_subset(spark, sf_dir):
    """Ids chosen for training; unknown ones are ignored."""
    chosen = fx.table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("contig_id"))
    return rows(spark, sf_dir).join(chosen, "contig_id", "left_semi").select("contig_id")


@query(L + " SELECT contig_id, round(vec[1], 6) AS weight, round(vec[3], 6) AS first_value, round(vec[64], 6) AS last_value, 62 AS n_values FROM lat")
def coverage_split(spark, sf_dir):
    """The weight of a coverage feature row apart from its features."""
    from loamwork.operators.encoder import split_coverage

    weight, values = split_coverage(F.col("vec"))
    return rows(spark, sf_dir).select("contig_id", F.round(weight, 6).alias("weight"), F.round(F.element_at(values, 1), 6).alias("first_value"), F.round(F.element_at(values, -1), 6).alias("last_value"), F.size(values).alias("n_values"))
