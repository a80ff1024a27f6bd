"""Queries on refinement stages and quality indices."""

from __future__ import annotations

from pyspark.sql import functions as F

from loamwork.operators import quality, refine, trials
from loamwork.plans import fixtures as fx
from loamwork.plans.q_bins import CENTRES, SHAPES, rows
from loamwork.plans.registry import query
from loamwork.plans.workspace import settled

N = f"WITH {fx.LATENT}"
_VOTE = """vo AS (SELECT q, l, count(*) AS n FROM nr GROUP BY 1, 2), tl AS (SELECT q, sum(n) AS support, max(n) AS agree FROM vo GROUP BY 1), wi AS (SELECT vo.q, min(l) AS winner, any_value(support) AS support, any_value(agree) AS agree FROM vo JOIN tl ON vo.q = tl.q AND vo.n = tl.agree GROUP BY 1)"""


def _near(query_where: str, ref_where: str, k: int, radius: float = 99.0, table: str = "nv") -> str:
    """CTE nr: q, r, l, d of the k nearest references within a radius."""
    return f"""kn AS (SELECT a.contig_id AS q, b.contig_id AS r, b.label AS l, list_distance(a.u, b.u) AS d, row_number() OVER (PARTITION BY a.contig_id ORDER BY list_distance(a.u, b.u), b.contig_id) AS k FROM {table} a, {table} b WHERE a.contig_id <> b.contig_id AND ({query_where.format("a")}) AND ({ref_where.format("b")})),
nr AS (SELECT * FROM kn WHERE k <= {k} AND d <= {radius})"""


@query(N + ", " + _near("{0}.label < 0", "{0}.label >= 0 AND {0}.prob >= 0.2", 15, 1.2) + ", " + _VOTE + " SELECT contig_id, CAST(coalesce(winner, label) AS INT) AS label FROM lat LEFT JOIN (SELECT * FROM wi WHERE support >= 3 AND agree >= 3 AND agree >= 0.3 * support) w ON lat.contig_id = w.q")
def rescue_votes(spark, sf_dir):
    """Noise rescued by neighbour votes."""
    return refine.rescue_by_votes(rows(spark, sf_dir), 15, 1.2, 3, 0.3, 0.2).select("contig_id", "label")


@query(f"""WITH {CENTRES}, tr AS (SELECT label, pos, avg(x) AS x FROM (SELECT label, unnest(u) AS x, unnest(range(0, 64)) AS pos FROM nv WHERE label >= 0 AND prob >= 0.2) GROUP BY 1, 2), tm AS (SELECT label, list(x ORDER BY pos) AS m FROM tr GROUP BY 1), tc AS (SELECT label, list_transform(m, lambda x: x / sqrt(list_dot_product(m, m))) AS c FROM tm),
cd AS (SELECT contig_id, tc.label AS bin, list_distance(u, c) AS d FROM nv, tc WHERE nv.label < 0), cr AS (SELECT *, row_number() OVER w AS k, lead(d) OVER w AS nx FROM cd WINDOW w AS (PARTITION BY contig_id ORDER BY d, bin)), fi AS (SELECT * FROM cr WHERE k = 1 AND d <= 1.35 AND (nx IS NULL OR nx - d >= 0.005)),
""" + _near("{0}.label < 0", "{0}.label >= 0 AND {0}.prob >= 0.2", 20, 1.3) + """, lo AS (SELECT q, bin, count(*) AS support, sum((l = bin)::INT) AS agree FROM nr JOIN fi ON fi.contig_id = nr.q GROUP BY 1, 2)
SELECT lat.contig_id, CAST(coalesce(bin, label) AS INT) AS label FROM lat LEFT JOIN (SELECT * FROM lo WHERE support >= 2 AND agree >= 2 AND agree >= 0.15 * support) x ON x.q = lat.contig_id""")
def rescue_centroid(spark, sf_dir):
    """K3: noise rescued by centroid and local agreement."""
    return refine.rescue_by_centroid(rows(spark, sf_dir), 1.35, 0.005, 20, 1.3, 2, 0.15, 0.2).select("contig_id", "label")


@query(f"""WITH {CENTRES}, mo AS (SELECT label AS bin, u AS med FROM (SELECT nv.label, nv.u, row_number() OVER (PARTITION BY nv.label ORDER BY list_distance(nv.u, mean), contig_id) AS k FROM nv JOIN mv ON nv.label = mv.label) WHERE k = 1),
be AS (SELECT contig_id, label, bin, d FROM (SELECT contig_id, label, bin, list_distance(u, med) AS d, row_number() OVER (PARTITION BY contig_id ORDER BY list_distance(u, med), bin) AS k FROM nv, mo WHERE label >= 0) WHERE k = 1)
SELECT lat.contig_id, CAST(CASE WHEN bin IS NOT NULL AND bin <> lat.label AND d <= 1.25 THEN bin ELSE lat.label END AS INT) AS label FROM lat LEFT JOIN be USING (contig_id)""")
def medoid_pass(spark, sf_dir):
    """K5: one medoid pass."""
    return refine.medoid_pass(rows(spark, sf_dir), 1.25).select("contig_id", "label")


@query()
def medoid_refinement(spark, sf_dir):
    """K5: passes until few rows move."""
    return refine.medoid_refinement(rows(spark, sf_dir), 1.25, 4).select("contig_id", "label")


@query(N + ", " + _near("{0}.label < 0 AND {0}.length >= 600 AND {0}.length < 5000", "{0}.label >= 0 AND {0}.length >= 5000", 15, 1.3) + ", " + _VOTE + " SELECT contig_id, CAST(coalesce(winner, label) AS INT) AS label FROM lat LEFT JOIN (SELECT * FROM wi WHERE support >= 4 AND agree >= 0.3 * support) w ON lat.contig_id = w.q")
def recruit_short(spark, sf_dir):
    """K6: short contigs recruited."""
    return refine.recruit_short(rows(spark, sf_dir), 600, 5000, 15, 1.3, 4, 0.3).select("contig_id", "label")


@query(f"WITH {SHAPES}, " + _near("{0}.label >= 0", "{0}.label >= 0", 15) + ", " + _VOTE + """, ca AS (SELECT ex.contig_id, winner, avg(abs(x - m) / sd) AS z FROM wi JOIN ex ON ex.contig_id = wi.q JOIN sm ON sm.label = winner AND sm.pos = ex.pos WHERE agree >= 0.25 * 15 AND winner <> ex.label GROUP BY 1, 2)
SELECT lat.contig_id, CAST(CASE WHEN z <= 1.2 THEN winner ELSE label END AS INT) AS label FROM lat LEFT JOIN ca USING (contig_id)""")
def consensus_pass(spark, sf_dir):
    """K7: one pass of composition consensus with a coverage check."""
    from loamwork.operators.neighbours import knn

    r = rows(spark, sf_dir)
    v = r.where("label >= 0").select("contig_id", F.col("u").alias("vec"))
    return refine.consensus_pass(r, knn(v, v, 15), 15, 0.25, 1.2).select("contig_id", "label")


@query()
def consensus_reassign(spark, sf_dir):
    """K7: synchronous passes until nothing moves, at most three."""
    return refine.consensus_reassign(rows(spark, sf_dir), 15, 0.25, 1.2, 3).select("contig_id", "label")


PRUNED = f"""WITH {SHAPES}, fg AS (SELECT zs.contig_id, zs.label, z > 1.7 AS flag, length FROM zs JOIN lat USING (contig_id)), al AS (SELECT label FROM fg GROUP BY 1 HAVING count(*) >= 30 AND sum(CASE WHEN flag THEN length ELSE 0 END) / sum(length) <= 0.12),
pn AS (SELECT contig_id, label FROM fg WHERE flag AND label IN (SELECT label FROM al)), af AS (SELECT nv.contig_id, nv.u, CAST(CASE WHEN nv.contig_id IN (SELECT contig_id FROM pn) THEN -1 ELSE label END AS INT) AS label, nv.contig_id IN (SELECT contig_id FROM pn) AS pruned FROM nv)"""


@query(PRUNED + " SELECT contig_id, label, pruned FROM af")
def prune_outliers(spark, sf_dir):
    """K8: coverage-shape outliers unbinned, up to a share of bp."""
    return refine.prune_outliers(rows(spark, sf_dir), 1.7, 30, 0.12).select("contig_id", "label", "pruned")


@query(PRUNED + ", " + _near("{0}.pruned", "{0}.label >= 0", 20, table="af") + """, op AS (SELECT q, l AS bin, count(*) AS n FROM nr GROUP BY 1, 2 HAVING count(*) >= 3),
x2 AS (SELECT sp.contig_id, af.label, unnest(shape) AS x, unnest(range(0, 5)) AS pos FROM sp JOIN af USING (contig_id)), m2 AS (SELECT label, pos, median(x) AS m FROM x2 WHERE label >= 0 GROUP BY 1, 2), s2 AS (SELECT x2.label, x2.pos, any_value(m) AS m, greatest(median(abs(x - m)) * 1.4826, 0.05) AS sd FROM x2 JOIN m2 ON x2.label = m2.label AND x2.pos = m2.pos GROUP BY 1, 2),
z2 AS (SELECT q, bin, avg(abs(x - m) / sd) AS z FROM op JOIN x2 ON x2.contig_id = q JOIN s2 ON s2.label = bin AND s2.pos = x2.pos GROUP BY 1, 2), b2 AS (SELECT q, bin FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY z, bin) AS k FROM z2) WHERE k = 1 AND z <= 3)
SELECT contig_id, CAST(coalesce(bin, label) AS INT) AS label FROM af LEFT JOIN b2 ON b2.q = contig_id""")
def reassign_pruned(spark, sf_dir):
    """K9: pruned contigs moved to the best-fitting bin."""
    p = refine.prune_outliers(rows(spark, sf_dir), 1.7, 30, 0.12)
    return refine.reassign_pruned(p, 20, 3, 3.0).select("contig_id", "label")


_TWO = N + """, va AS (SELECT contig_id, vec[1:32] AS v FROM lat), vb AS (SELECT contig_id, vec[17:48] AS v FROM lat), ka AS (SELECT q, list(r) AS s FROM (SELECT a.contig_id AS q, b.contig_id AS r, row_number() OVER (PARTITION BY a.contig_id ORDER BY list_distance(a.v, b.v), b.contig_id) AS k FROM va a, va b WHERE a.contig_id <> b.contig_id) WHERE k <= 10 GROUP BY 1),
kb AS (SELECT q, list(r) AS s FROM (SELECT a.contig_id AS q, b.contig_id AS r, row_number() OVER (PARTITION BY a.contig_id ORDER BY list_distance(a.v, b.v), b.contig_id) AS k FROM vb a, vb b WHERE a.contig_id <> b.contig_id) WHERE k <= 10 GROUP BY 1),
ja AS (SELECT ka.q AS contig_id, len(list_intersect(ka.s, kb.s)) / CAST(20 - len(list_intersect(ka.s, kb.s)) AS DOUBLE) AS jaccard FROM ka JOIN kb ON ka.q = kb.q)"""


def _jaccards(spark, sf_dir):
    r = rows(spark, sf_dir)
    a, b = (r.select("contig_id", F.slice("vec", s, 32).alias("vec")) for s in (1, 17))
    return refine.neighbour_jaccard(a, b, 10)


@query(_TWO + " SELECT contig_id, jaccard FROM ja")
def neighbour_jaccard(spark, sf_dir):
    """U4, K2: agreement of neighbourhoods in two spaces."""
    return _jaccards(spark, sf_dir)


@query(_TWO + """, g AS (SELECT label, avg((prob < 0.3)::INT) AS zero, median(CASE WHEN prob < 0.3 THEN 0 ELSE prob END) AS w, avg(jaccard) AS j FROM lat JOIN ja USING (contig_id) WHERE label >= 0 GROUP BY 1), h AS (SELECT label, CASE WHEN zero >= 0.5 THEN 'te_weight_zero' WHEN w < 0.5 THEN 'low_te_weight' WHEN j < 0.13 THEN 'low_agreement' ELSE 'useful' END AS reason FROM g) SELECT label, reason = 'useful' AS use_te, reason FROM h""")
def te_usefulness(spark, sf_dir):
    """Which bins repeat features help."""
    r = rows(spark, sf_dir).withColumn("te_weight", F.when(F.col("prob") < 0.3, 0.0).otherwise(F.col("prob")))
    return refine.te_usefulness(r, _jaccards(spark, sf_dir), 0.5, 0.13)


@query(N + ", " + _near("{0}.label = 1", "{0}.label IN (1, 2)", 10) + " SELECT avg((l = 2)::INT) / ((SELECT count(*) FROM lat WHERE label = 2) / CAST((SELECT count(*) - 1 FROM lat WHERE label IN (1, 2)) AS DOUBLE)) AS mixing FROM nr")
def composition_mixing(spark, sf_dir):
    """Are two bins intermixed?"""
    return refine.mixing(rows(spark, sf_dir), 1, 2, 10)


@query(f"""WITH {CENTRES}, ga AS (SELECT list(x ORDER BY pos) AS g FROM (SELECT pos, avg(x) AS x FROM (SELECT unnest(u) AS x, unnest(range(0, 64)) AS pos FROM nv WHERE label >= 0) GROUP BY 1)), wi AS (SELECT nv.label, count(*) AS n, avg(list_distance(u, mean)) AS s, sum(list_distance(u, mean) ** 2) AS w FROM nv JOIN mv ON nv.label = mv.label GROUP BY 1),
ch AS (SELECT count(*) AS k, sum(n * list_distance(mean, g) ** 2) * (sum(n) - count(*)) / (sum(w) * (count(*) - 1)) AS c FROM wi JOIN mv USING (label), ga), db AS (SELECT x.label, max((x.s + y.s) / list_distance(p.mean, q.mean)) AS d FROM wi x JOIN wi y ON x.label <> y.label JOIN mv p ON p.label = x.label JOIN mv q ON q.label = y.label GROUP BY 1)
SELECT k AS n_clusters, round(c, 6) AS calinski_harabasz, round((SELECT avg(d) FROM db), 6) AS davies_bouldin FROM ch""")
def cluster_indices(spark, sf_dir):
    """Q1: Calinski-Harabasz and Davies-Bouldin."""
    x = quality.indices(rows(spark, sf_dir))
    return x.select("n_clusters", F.round("calinski_harabasz", 6).alias("calinski_harabasz"), F.round("davies_bouldin", 6).alias("davies_bouldin"))


@query(N + """, p AS (SELECT a.contig_id, a.label, b.label AS bin, sum(list_distance(a.u, b.u)) / count(*) AS d FROM nv a JOIN nv b ON a.contig_id <> b.contig_id AND a.label >= 0 AND b.label >= 0 GROUP BY 1, 2, 3), q AS (SELECT contig_id, label, max(CASE WHEN bin = label THEN d END) AS a, min(CASE WHEN bin <> label THEN d END) AS b FROM p GROUP BY 1, 2),
s AS (SELECT label, (b - a) / greatest(a, b) AS s FROM q) SELECT round(avg(s), 6) AS silhouette, round((SELECT avg(m) FROM (SELECT avg(s) AS m FROM s GROUP BY label)), 6) AS silhouette_macro FROM s""")
def silhouettes(spark, sf_dir):
    """Q1, Q2: silhouettes."""
    x = quality.silhouette(rows(spark, sf_dir))
    return x.select(F.round("silhouette", 6).alias("silhouette"), F.round("silhouette_macro", 6).alias("silhouette_macro"))


@query(N + ", " + _near("{0}.label >= 0", "{0}.label >= 0", 50) + ", y AS (SELECT q, avg((l = nv.label)::INT) FILTER (k <= 10) AS a, avg((l = nv.label)::INT) FILTER (k <= 30) AS b, avg((l = nv.label)::INT) AS c FROM nr JOIN nv ON nv.contig_id = q GROUP BY 1) SELECT round(avg(a), 6) AS knn_agree_10, round(avg(b), 6) AS knn_agree_30, round(avg(c), 6) AS knn_agree_50 FROM y")
def neighbour_agreement(spark, sf_dir):
    """Q1: neighbour agreement at 10, 30 and 50."""
    x = quality.neighbour_agreement(rows(spark, sf_dir))
    return x.select(*(F.round(F.col(f"`knn_agree@{k}`"), 6).alias(f"knn_agree_{k}") for k in (10, 30, 50)))


_TRIALS = [trials.Votes(15, 1.2, 3, 0.3), trials.Votes(15, 1.2, 3, 0.2), trials.Votes(20, 1.25, 3, 0.2), trials.Votes(8, 1.3, 2, 0.25), trials.Votes(20, 1.2, 20, 0.9), trials.Votes(15, 1.2, 3, 0.31)]


@query(N + ", " + _near("{0}.label < 0", "{0}.label >= 0 AND {0}.prob >= 0.2", 20) + ", ca(candidate, kk, radius, sup, agr) AS (VALUES " + ", ".join(f"({i}, {v.k}, {v.radius}, {v.support}, {v.agreement})" for i, v in enumerate(_TRIALS)) + """),
vo AS (SELECT candidate, q, l, count(*) AS n FROM nr JOIN ca ON nr.k <= kk AND d <= radius GROUP BY ALL), tl AS (SELECT candidate, q, sum(n) AS support, max(n) AS agree FROM vo GROUP BY ALL),
mo AS (SELECT candidate, q, min(l) AS winner FROM vo JOIN tl USING (candidate, q) JOIN ca USING (candidate) WHERE n = agree AND support >= sup AND agree >= sup AND agree >= agr * support GROUP BY ALL),
lb AS (SELECT ca.candidate, nv.contig_id, nv.u, lat.length, coalesce(winner, nv.label) AS label, winner FROM ca CROSS JOIN nv JOIN lat USING (contig_id) LEFT JOIN mo ON mo.candidate = ca.candidate AND mo.q = nv.contig_id),
sx AS (SELECT candidate, label, pos, sum(x) AS s, count(*) AS n, sum(x * x) AS sq FROM (SELECT candidate, label, unnest(u) AS x, unnest(range(0, 64)) AS pos FROM lb WHERE label >= 0) GROUP BY ALL),
gx AS (SELECT candidate, label, max(n) AS n, sum(s * s) / max(n) AS a, sum(sq) AS sq FROM sx GROUP BY ALL), tx AS (SELECT candidate, sum(s * s) AS w FROM (SELECT candidate, pos, sum(s) AS s FROM sx GROUP BY ALL) GROUP BY ALL),
ch AS (SELECT candidate, count(*) AS n_clusters, (sum(a) - any_value(w) / sum(n)) * (sum(n) - count(*)) / ((sum(sq) - sum(a)) * (count(*) - 1)) AS calinski_harabasz FROM gx JOIN tx USING (candidate) GROUP BY ALL),
dg AS (SELECT candidate, count(winner) AS n_moved, coalesce(string_agg(contig_id || ':' || winner, ',' ORDER BY contig_id), '') AS h, 100.0 * sum(length) FILTER (label >= 0) / CAST(sum(length) AS DOUBLE) AS assigned_bp_pct FROM lb GROUP BY ALL)
SELECT candidate, n_moved, min(candidate) OVER (PARTITION BY h) AS first, n_clusters, calinski_harabasz, assigned_bp_pct FROM dg JOIN ch USING (candidate)""")
def tried_votes(spark, sf_dir):
    """Q7: six settings of the vote stage over one list of neighbours, with what the judge looks at."""
    x = settled(rows(spark, sf_dir))
    found = trials.vote_trials(x, trials.vote_neighbours(x, 20, 0.2), _TRIALS)
    return found.drop("passed", "score")
