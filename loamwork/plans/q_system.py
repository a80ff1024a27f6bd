"""Queries on parsers, resources, runs, density clustering, merging and encoders."""

from __future__ import annotations

from pyspark.sql import functions as F

from loamwork.functions import vectors as V
from loamwork.operators import density, encoder, groups, merge, quality, split
from loamwork.operators.neighbours import knn, knn_indexed
from loamwork.plans import fixtures as fx
from loamwork.plans import runs
from loamwork.plans.q_bins import BINS, CENTRES, SHAPES, rows
from loamwork.plans.registry import query
from loamwork.plans.workspace import settled, workspace
from loamwork.sources import tables
from loamwork.streaming import resources

_LINE = "concat_ws('\t', l_partkey, l_returnflag, {p}, l_linenumber, 1, 0, l_suppkey, l_suppkey + 9, 1, 9, 0.001, l_extendedprice)"


@query("SELECT l_linenumber <> 3 AS ok, count(*) AS n, CAST(sum(CASE WHEN l_linenumber <> 3 THEN l_suppkey ELSE 0 END) AS BIGINT) AS starts FROM lineitem WHERE l_linenumber <> 5 GROUP BY 1")
def hit_lines(spark, sf_dir):
    """A10: hits parsed from text; blank lines are skipped, malformed ones counted."""
    li = fx.table(spark, sf_dir, "lineitem")
    line = F.when(F.col("l_linenumber") == 5, "  ").when(F.col("l_linenumber") == 3, F.expr(_LINE.format(p="'x'"))).otherwise(F.expr(_LINE.format(p="l_discount")))
    x = tables.parse_hits(li.select(line.alias("value")))
    return x.groupBy("ok").agg(F.count("*").alias("n"), F.sum(F.when(F.col("ok"), F.col("qstart")).otherwise(0)).cast("long").alias("starts"))


@query("SELECT 'p' || p_partkey AS bin, p_retailprice AS completeness, CAST(p_size AS DOUBLE) AS contamination FROM part WHERE p_size > 5")
def bin_scores(spark, sf_dir):
    """Completeness scores; paths, negative and unreadable numbers."""
    p = fx.table(spark, sf_dir, "part")
    bad = F.when(F.col("p_size") <= 2, "-1").when(F.col("p_size") <= 5, "oops").otherwise(F.col("p_size").cast("string"))
    return tables.parse_scores(p.select(F.concat(F.lit("/a/b/p"), "p_partkey", F.lit(".fa")).alias("Bin path"), F.col("p_retailprice").cast("string").alias("Completeness"), bad.alias("Contamination %")))


@query(f"WITH {fx.SAMPLES} SELECT pid, event_id, greatest(0.0, counter - lag(counter) OVER (PARTITION BY pid ORDER BY at_us, event_id)) AS delta FROM samples WHERE counter IS NOT NULL")
def counter_deltas(spark, sf_dir):
    """Growth of counters."""
    return resources.deltas(fx.samples(spark, sf_dir)).select("pid", "event_id", "delta")


@query(f"""WITH {fx.SAMPLES}, r AS (SELECT stage, counter, row_number() OVER (PARTITION BY stage ORDER BY counter) - 1 AS k, count(*) OVER (PARTITION BY stage) AS n FROM samples),
p AS (SELECT stage, max(counter) FILTER (k = floor(0.5 * (n - 1) + 0.5)) AS p50, max(counter) FILTER (k = floor(0.95 * (n - 1) + 0.5)) AS p95 FROM r GROUP BY 1)
SELECT s.stage, count(*) AS n, avg(counter) AS mean, min(counter) AS min, max(counter) AS max, arg_min(counter, {{'a': at_us, 'b': event_id}}) AS first, arg_max(counter, {{'a': at_us, 'b': event_id}}) AS last, any_value(p50) AS p50, any_value(p95) AS p95 FROM samples s JOIN p ON s.stage = p.stage GROUP BY 1""")
def stage_statistics(spark, sf_dir):
    """Statistics of stages."""
    return resources.stage_statistics(fx.samples(spark, sf_dir))


@query(f"WITH {fx.SAMPLES}, b AS (SELECT stage, (max(at_us) - min(at_us)) / 1e6 AS seconds FROM samples GROUP BY 1) SELECT stage, seconds, seconds / sum(seconds) OVER () AS share, seconds = max(seconds) OVER () AS bottleneck FROM b")
def stage_shares(spark, sf_dir):
    """Shares of stages."""
    return resources.stage_shares(fx.samples(spark, sf_dir))


@query("WITH v AS (SELECT event_type AS metric, user_id % 12 AS ord, sum(value) AS value FROM events GROUP BY 1, 2) SELECT metric, ord, round((value - b) / greatest(abs(b), 1e-9), 6) AS change FROM (SELECT *, lag(value) OVER (PARTITION BY metric ORDER BY ord) AS b FROM v)")
def stage_changes(spark, sf_dir):
    """Change from stage to stage."""
    v = fx.table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("metric"), (F.col("user_id") % 12).alias("ord")).agg(F.sum("value").alias("value"))
    return resources.stage_changes(v).select("metric", "ord", F.round("change", 6).alias("change"))


@query(f"WITH {fx.SAMPLES}, o AS (SELECT *, CASE WHEN at_us - lag(at_us) OVER (PARTITION BY pid ORDER BY at_us) < 21600000000 THEN 0 ELSE 1 END AS opens FROM samples), n AS (SELECT *, sum(opens) OVER (PARTITION BY pid ORDER BY at_us ROWS UNBOUNDED PRECEDING) AS s FROM o) SELECT pid, min(at_us) AS start_us, count(*) AS n FROM n GROUP BY pid, s")
def sample_sessions(spark, sf_dir):
    """Section 2.12 extension: sessions of processes."""
    return resources.sessions(fx.samples(spark, sf_dir))


@query()
def streamed_windows(spark, sf_dir):
    """Section 2.12 extension: the windowed aggregate run as a stream over files until it has read all."""
    base = workspace(spark)
    source = fx.samples(spark, sf_dir)
    source.write.parquet(f"{base}/in")
    stream = spark.readStream.schema(source.schema).parquet(f"{base}/in")
    q = resources.windowed(stream).writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema("start timestamp, stage string, n bigint, mean double").parquet(f"{base}/out")


@query(BINS + ", b AS (SELECT total_bp, sum(total_bp) OVER (ORDER BY total_bp DESC ROWS UNBOUNDED PRECEDING) AS run, sum(total_bp) OVER () AS t FROM sz) SELECT 'all' AS run, count(*) AS n_bins, CAST(sum(n_contigs) AS BIGINT) AS n_binned, CAST(sum(total_bp) AS BIGINT) AS binned_bp, max(total_bp) AS largest_bp, (SELECT max(total_bp) FROM b WHERE run >= t / 2.0) AS n50 FROM sz")
def run_comparison(spark, sf_dir):
    """A line for each run."""
    return runs.comparison({"all": rows(spark, sf_dir)})


@query("WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), d AS (SELECT a.id, list_distance(a.v, b.v) AS d, row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.v, b.v), b.id) AS k FROM v a, v b WHERE a.id <> b.id) SELECT id AS contig_id, round(d, 6) AS core FROM d WHERE k = 9")
def core_distances(spark, sf_dir):
    """M8: core distances."""
    c = density.core_distances(rows(spark, sf_dir), 10)
    return c.select("contig_id", F.round("core", 6).alias("core"))


@query()
def density_parts(spark, sf_dir):
    """M8: density clusters of the whole vectors inside each bin, K14's first step."""
    r = rows(spark, sf_dir).where("label >= 0")
    return density.cluster(r, "label", 4, 2)


@query()
def density_clusters(spark, sf_dir):
    """M8: density clusters of all rows by the finest method, over the graph of each row's nearest neighbours."""
    r = rows(spark, sf_dir).withColumn("all", F.lit(0))
    return density.cluster(r, "all", 4, 2)


PIECES = split.PieceRules(min_contigs=30, min_cluster=3, min_samples=2, min_part_bp=20_000, limits=merge.Limits(separation=0.2, coverage=3.0))


@query()
def subclustered(spark, sf_dir):
    """Large bins cut into density pieces, which move, merge, take in noise by votes, and stand if two are large."""
    return split.subcluster(rows(spark, sf_dir), PIECES)


def _near(name: str, space: str, asked: str) -> str:
    return f"""{name} AS (SELECT * FROM (SELECT q.contig_id AS query, r.contig_id AS ref, q.label, r.piece, list_distance(q.{space}, r.{space}) AS d, row_number() OVER (PARTITION BY q.contig_id ORDER BY list_distance(q.{space}, r.{space}), r.contig_id) AS k
 FROM {asked} q JOIN kn r ON q.label = r.label AND q.contig_id <> r.contig_id) WHERE k <= 10)"""


def _mix(name: str, near: str) -> str:
    return f"""{name} AS (SELECT n.label, k.piece AS a, n.piece AS b, count(*) / any_value(t.slots) * (any_value(al.n) - 1) / any_value(sz.n) AS mix FROM {near} n JOIN kn k ON k.contig_id = n.query JOIN (SELECT label, piece, count(*) AS n FROM kn GROUP BY 1, 2) sz ON sz.label = n.label AND sz.piece = n.piece
 JOIN (SELECT label, count(*) AS n FROM kn GROUP BY 1) al ON al.label = n.label JOIN (SELECT m.label, j.piece, count(*) AS slots FROM {near} m JOIN kn j ON j.contig_id = m.query GROUP BY 1, 2) t ON t.label = n.label AND t.piece = k.piece WHERE k.piece <> n.piece GROUP BY 1, 2, 3)"""


def _gap(name: str, pairs: str, members: str) -> str:
    """The pooled gap of pairs (label, a, b) over members (contig_id, label, piece)."""
    return f"""{name}_e AS (SELECT m.label, m.piece, ex.pos, ex.x FROM {members} m JOIN ex USING (contig_id)), {name}_m AS (SELECT label, piece, pos, median(x) AS m FROM {name}_e GROUP BY 1, 2, 3), {name}_f AS (SELECT e.label, e.piece, e.pos, abs(e.x - m.m) AS far FROM {name}_e e JOIN {name}_m m USING (label, piece, pos)),
{name}_s AS (SELECT p.label, p.a, p.b, f.pos, greatest(median(far) * 1.4826, 0.05) AS sd FROM {pairs} p JOIN {name}_f f ON f.label = p.label AND f.piece IN (p.a, p.b) GROUP BY 1, 2, 3, 4),
{name} AS (SELECT s.label, s.a, s.b, avg(abs(p.m - q.m) / sd) AS gap FROM {name}_s s JOIN {name}_m p ON p.label = s.label AND p.piece = s.a AND p.pos = s.pos JOIN {name}_m q ON q.label = s.label AND q.piece = s.b AND q.pos = s.pos GROUP BY 1, 2, 3)"""


# every bin is cut in two, so a bin has one pair of pieces and uniting them is one step
SPLITS = SHAPES + f""", xs AS (SELECT contig_id, label, u, vec, length, CASE WHEN contig_id % 11 = 0 THEN -1 ELSE 2 * label + CAST(u[1] > 0 AS INT) END AS piece FROM nv WHERE label >= 0), kn AS (SELECT * FROM xs WHERE piece >= 0), op AS (SELECT * FROM xs WHERE piece < 0),
{_near("nu", "u", "kn")}, {_near("nq", "vec", "kn")}, {_near("no", "u", "op")}, {_mix("mu", "nu")}, {_mix("mq", "nq")},
mx AS (SELECT label, least(a, b) AS a, greatest(a, b) AS b, min(mix) AS mix FROM (SELECT label, a, b, least(mu.mix, mq.mix) AS mix FROM mu JOIN mq USING (label, a, b)) GROUP BY 1, 2, 3 HAVING count(*) = 2), {_gap("pg", "mx", "kn")},
pairs AS (SELECT label, a, b, mix, gap, coalesce(mix >= 0.6 AND gap < 0.2, false) AS alike FROM mx LEFT JOIN pg USING (label, a, b))"""


@query(f"WITH {SPLITS} SELECT label, a, b, round(mix, 6) AS mix, round(gap, 6) AS gap, alike FROM pairs")
def split_pairs(spark, sf_dir):
    """Q6: how mixed and how alike in coverage the two pieces of each bin are."""
    x = _cut_rows(spark, sf_dir).where("label >= 0").withColumnRenamed("cut", "piece")
    known = settled(x.where("piece >= 0").select(F.col("label").cast("long").alias("label"), "contig_id", F.col("piece").cast("long").alias("piece"), "u", "vec", "shape"))
    near = {c: settled(split._nearby(known, c, 10)) for c in ("u", "vec")}
    return split.piece_pairs(known, near, SPLIT_RULES).withColumn("mix", F.round("mix", 6)).withColumn("gap", F.round("gap", 6))


_DECIDED = SPLITS + f""", lim AS (SELECT label, quantile_cont(d, 0.95) AS most FROM (SELECT query, any_value(label) AS label, avg(d) AS d FROM nu GROUP BY 1) GROUP BY 1), vo AS (SELECT query, label, piece, count(*) AS n, sum(d) AS d FROM no GROUP BY 1, 2, 3),
won AS (SELECT query, label, arg_max(piece, n * 1000000 - piece) AS piece, max(n) AS n, sum(n) AS f, sum(d) / sum(n) AS far FROM vo GROUP BY 1, 2),
me1 AS (SELECT k.label, k.piece, pos, median(x) AS m FROM kn k JOIN ex USING (contig_id) GROUP BY 1, 2, 3), me2 AS (SELECT k.label, k.piece, e.pos, any_value(m) AS m, greatest(median(abs(x - m)) * 1.4826, 0.05) AS sd FROM kn k JOIN ex e USING (contig_id) JOIN me1 ON me1.label = k.label AND me1.piece = k.piece AND me1.pos = e.pos GROUP BY 1, 2, 3),
fit AS (SELECT w.query AS contig_id, w.piece FROM won w JOIN lim USING (label) JOIN ex e ON e.contig_id = w.query JOIN me2 m ON m.label = w.label AND m.piece = w.piece AND m.pos = e.pos WHERE 2 * n >= f AND far <= most + 1e-9 GROUP BY 1, 2 HAVING avg(abs(e.x - m.m) / m.sd) <= 3.0 + 1e-9),
si AS (SELECT label, piece, count(*) AS n FROM kn GROUP BY 1, 2), un AS (SELECT p.label, p.a, p.b, CASE WHEN s.n >= t.n THEN a ELSE b END AS keep FROM pairs p JOIN si s ON s.label = p.label AND s.piece = a JOIN si t ON t.label = p.label AND t.piece = b WHERE alike),
nw AS (SELECT x.contig_id, x.label, x.length, fit.piece IS NOT NULL AS took, CASE WHEN coalesce(fit.piece, x.piece) IN (un.a, un.b) THEN un.keep ELSE coalesce(fit.piece, x.piece) END AS piece FROM xs x LEFT JOIN fit USING (contig_id) LEFT JOIN un ON un.label = x.label),
pu AS (SELECT label, piece, avg(s) AS pure FROM (SELECT q.label, q.piece, n.query, avg(CAST(q.piece = r.piece AS INT)) AS s FROM nu n JOIN nw q ON q.contig_id = n.query JOIN nw r ON r.contig_id = n.ref GROUP BY 1, 2, 3) GROUP BY 1, 2),
ps AS (SELECT label, piece, sum(length) AS bp FROM nw WHERE piece >= 0 GROUP BY 1, 2), we AS (SELECT label, count(*) AS pieces, 100 * (1 - min(coalesce(pure, 0))) AS dp FROM ps LEFT JOIN pu USING (label, piece) GROUP BY 1),
tw AS (SELECT label, min(piece) AS a, max(piece) AS b FROM ps GROUP BY 1 HAVING count(*) = 2), {_gap("tg", "tw", "nw")},
be AS (SELECT label, count(*) AS contigs, count(DISTINCT piece) FILTER (piece >= 0) AS raw FROM xs GROUP BY 1), af AS (SELECT label, count(*) FILTER (took) AS reattached, coalesce(sum(length) FILTER (piece < 0), 0) / sum(length) AS unassigned FROM nw GROUP BY 1),
al AS (SELECT *, coalesce(dp <= 60 + 1e-9, false) AS apart, coalesce(gap >= 0.2 - 1e-9, false) AS dist FROM be JOIN af USING (label) LEFT JOIN we USING (label) LEFT JOIN tg USING (label)),
ve AS (SELECT *, CASE WHEN pieces < 2 THEN 'one genome' WHEN NOT (apart AND dist) THEN 'not enough evidence' WHEN unassigned > 0.05 + 1e-9 THEN 'too much is lost' END AS why FROM al)"""


@query(f"""WITH {_DECIDED} SELECT label AS parent, contigs, raw AS raw_pieces, pieces, reattached, raw - pieces AS rejoined, round(unassigned, 6) AS unassigned, round(dp, 6) AS drop_points, round(gap, 6) AS gap,
 CASE WHEN why IS NULL THEN 'split' ELSE 'keep_parent' END AS decision, coalesce(why, 'tnf_separable+coverage_distinct') AS reason FROM ve""")
def split_decisions(spark, sf_dir):
    """Q6: a split of each bin in two by the side of a plane, judged bin by bin."""
    found = split.decide_splits(_cut_rows(spark, sf_dir), SPLIT_RULES)
    return found.select(*(F.round(c, 6).alias(c) if c in ("unassigned", "drop_points", "gap") else F.col(c) for c in found.columns))


SPLIT_RULES = split.SplitRules(max_drop_points=60.0, min_z=0.2, max_loss=0.05, rejoin_mix=0.6)


def _cut_rows(spark, sf_dir):
    r = rows(spark, sf_dir)
    return r.withColumn("cut", F.when(F.col("label") < 0, -1).when(F.col("contig_id") % 11 == 0, -1).otherwise(2 * F.col("label") + (F.element_at("u", 1) > 0).cast("int")))


@query()
def neighbours_approximate(spark, sf_dir):
    """K1: neighbours by the index, for every row whose id is divisible by 50, among all rows."""
    r = rows(spark, sf_dir).select("contig_id", "vec")
    return knn_indexed(r.where("contig_id % 50 = 0"), r, 10)


LIMITS = merge.Limits(separation=1.15, coverage=0.35, gc_difference=0.05, gc_outside=0.2, misfit=0.045, misfit_z=1.6, mixing=0.95, reciprocal=True)

GUARDS = CENTRES + """, ma AS (SELECT label, pos, median(abs(x - m)) AS d FROM ex JOIN md USING (label, pos) GROUP BY 1, 2), sc AS (SELECT pos, greatest(median(d) * 1.4826, 1e-3) AS scale FROM ma GROUP BY 1),
cv AS (SELECT a.label AS a, b.label AS b, avg(abs(a.m - b.m) / scale) AS coverage FROM md a JOIN md b ON a.pos = b.pos AND a.label < b.label JOIN sc ON sc.pos = a.pos GROUP BY 1, 2),
pt AS (SELECT cv.a, cv.b, list_distance(x.c, y.c) / (0.5 * (r.radius + s.radius)) AS separation, coverage FROM cv JOIN ce x ON x.label = cv.a JOIN ce y ON y.label = cv.b JOIN ra r ON r.label = cv.a JOIN ra s ON s.label = cv.b),
ok AS (SELECT * FROM pt WHERE separation < 1.15 AND coverage < 0.35), lr AS (SELECT contig_id, label, u, gc FROM nv WHERE label >= 0),
gs AS (SELECT label, count(*) AS n, median(gc) AS med, quantile_cont(gc, 0.05) AS lo, quantile_cont(gc, 0.95) AS hi FROM lr GROUP BY 1),
pp AS (SELECT ok.*, CASE WHEN p.n <= q.n THEN a ELSE b END AS small, CASE WHEN p.n <= q.n THEN b ELSE a END AS big, abs(p.med - q.med) AS gc_diff FROM ok JOIN gs p ON p.label = a JOIN gs q ON q.label = b),
wy AS (SELECT small AS fr, big AS un FROM pp UNION SELECT big, small FROM pp),
mz AS (SELECT wy.fr, wy.un, e.contig_id, avg(abs(x - s.m) / s.sd) AS z FROM wy JOIN ex e ON e.label = wy.fr JOIN sm s ON s.label = wy.un AND s.pos = e.pos GROUP BY 1, 2, 3), mf AS (SELECT fr, un, avg((z > 1.6)::INT) AS misfit FROM mz GROUP BY 1, 2),
gb AS (SELECT fr, un, avg((gc < lo OR gc > hi)::INT) AS gc_beyond FROM wy JOIN lr ON lr.label = fr JOIN gs ON gs.label = un GROUP BY 1, 2),
nn AS (SELECT fr, un, x.contig_id, (y.label = un)::INT AS other, row_number() OVER (PARTITION BY fr, un, x.contig_id ORDER BY list_distance(x.u, y.u), y.contig_id) AS k FROM wy JOIN lr x ON x.label = fr JOIN lr y ON (y.label = fr OR y.label = un) AND y.contig_id <> x.contig_id),
mx AS (SELECT fr, un, avg(other) / (any_value(q.n) / (any_value(p.n) + any_value(q.n) - 1.0)) AS mix FROM nn JOIN gs p ON p.label = fr JOIN gs q ON q.label = un WHERE k <= 10 GROUP BY 1, 2),
gd AS (SELECT pp.*, greatest(f.misfit, g.misfit) AS misfit, b.gc_beyond, least(m.mix, o.mix) AS mix FROM pp JOIN mf f ON f.fr = small AND f.un = big JOIN mf g ON g.fr = big AND g.un = small JOIN gb b ON b.fr = small AND b.un = big JOIN mx m ON m.fr = small AND m.un = big JOIN mx o ON o.fr = big AND o.un = small)"""


def _members(spark, sf_dir):
    return settled(rows(spark, sf_dir).where("label >= 0").select("contig_id", "label", "u", "shape", "gc"))


@query(f"""WITH {GUARDS} SELECT a, b, small, big, round(separation, 5) AS separation, round(coverage, 5) AS coverage, round(gc_diff, 6) AS gc_diff, round(misfit, 6) AS misfit, round(gc_beyond, 6) AS gc_beyond, round(mix, 6) AS mix,
 CASE WHEN gc_diff > 0.05 THEN 'gc_diff' WHEN gc_beyond > 0.2 THEN 'gc_outside' WHEN misfit > 0.045 THEN 'misfit' WHEN mix < 0.95 THEN 'tnf_mix' ELSE '' END AS refusal FROM gd""")
def merge_guards(spark, sf_dir):
    """The admissible pairs of bins with every guard's measure and verdict."""
    r = _members(spark, sf_dir)
    stats = settled(merge.with_parent(merge.statistics(r)))
    g = merge.guarded(r, stats, merge.admissible(stats, merge.shape_scale(stats), LIMITS), LIMITS)
    measures = {"separation": 5, "coverage": 5, "gc_diff": 6, "misfit": 6, "gc_beyond": 6, "mix": 6}
    return g.select("a", "b", "small", "big", *(F.round(c, k).alias(c) for c, k in measures.items()), "refusal")


@query(f"""WITH {GUARDS}, ps AS (SELECT small, big, a, b, separation FROM gd WHERE NOT (gc_diff > 0.05 OR gc_beyond > 0.2 OR misfit > 0.045 OR mix < 0.95))
SELECT a, b FROM ps ORDER BY separation, a, b LIMIT 1""")
def first_merge(spark, sf_dir):
    """The pair that greedy merging joins first."""
    r = _members(spark, sf_dir)
    stats = settled(merge.with_parent(merge.statistics(r)))
    g = merge.guarded(r, stats, merge.admissible(stats, merge.shape_scale(stats), LIMITS), LIMITS)
    return g.where("refusal = ''").orderBy("separation", "a", "b").limit(1).select("a", "b")


@query()
def merged_groups(spark, sf_dir):
    """Greedy merging of bins under all guards."""
    return merge.merge_bins(_members(spark, sf_dir), LIMITS)[0]


@query()
def same_genome(spark, sf_dir):
    """Merging under its own conditions: two samples, bins of ten contigs."""
    return merge.merge_same_genome(rows(spark, sf_dir), LIMITS, 10).select("contig_id", "label")


@query(f"""WITH RECURSIVE {fx.BIN_EDGES}, ed AS (SELECT DISTINCT a, b FROM (SELECT a, b FROM be WHERE a <> b AND ani >= 99.0 AND least(af_a, af_b) >= 80 UNION ALL SELECT b, a FROM be WHERE a <> b AND ani >= 99.0 AND least(af_a, af_b) >= 80)),
rk AS (SELECT bin, row_number() OVER (ORDER BY length DESC, bin DESC) AS k FROM bl), nb AS (SELECT r.bin, r.k, list(s.k) FILTER (s.k < r.k) AS over FROM rk r LEFT JOIN ed ON ed.a = r.bin LEFT JOIN rk s ON s.bin = ed.b GROUP BY 1, 2),
st AS (SELECT 0::BIGINT AS k, CAST([] AS BIGINT[]) AS kept UNION ALL SELECT st.k + 1, CASE WHEN len(list_intersect(coalesce(nb.over, []), st.kept)) = 0 THEN list_append(st.kept, st.k + 1) ELSE st.kept END FROM st JOIN nb ON nb.k = st.k + 1),
fin AS (SELECT kept FROM st ORDER BY k DESC LIMIT 1)
SELECT nb.bin, CASE WHEN list_contains(kept, nb.k) THEN nb.bin ELSE (SELECT rk.bin FROM rk WHERE rk.k = list_min(list_intersect(nb.over, kept))) END AS keeper FROM nb, fin""")
def bin_dedup(spark, sf_dir):
    """Which bin stands for each redundant one, from a table of edges."""
    return merge.redundant_bins(*fx.bin_edges(spark, sf_dir))


@query(f"""WITH RECURSIVE {fx.BIN_EDGES}, lk AS (SELECT least(a, b) AS a, greatest(a, b) AS b FROM be WHERE a <> b GROUP BY 1, 2 HAVING sum(CASE WHEN ani >= 98.5 THEN 1 ELSE 0 END) >= 9), two AS (SELECT a, b FROM lk UNION ALL SELECT b, a FROM lk),
rc AS (SELECT bin, bin AS other FROM bl UNION SELECT rc.bin, two.b FROM rc JOIN two ON rc.other = two.a), best AS (SELECT rc.bin, min((-length, other)) AS m FROM rc JOIN bl ON bl.bin = rc.other GROUP BY 1)
SELECT bin, m[2] AS stands_for FROM best""")
def linked_bins(spark, sf_dir):
    """Chains of linked bins under the name of their longest one."""
    bins, e = fx.bin_edges(spark, sf_dir)
    return merge.linked_bins(bins, e.select("a", "b", (F.col("ani") >= 98.5).cast("int").alias("links")), 9)


@query("""WITH p AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE 40.0 + c_custkey % 37 END AS c_a, (c_custkey % 5) * 1.0 AS x_a, 42.0 + c_custkey % 31 AS c_b, (c_custkey % 4) * 1.0 AS x_b, 45.0 + c_custkey % 43 AS c_ab, (c_custkey % 8) * 1.0 AS x_ab FROM customer)
SELECT id, c_ab - greatest(c_a, c_b) AS gain, x_ab - greatest(x_a, x_b) AS rise, 'ok' AS kind, CASE WHEN c_ab - greatest(c_a, c_b) >= 5 AND x_ab - greatest(x_a, x_b) <= 2 THEN 'merge' ELSE 'apart' END AS decision FROM p WHERE c_a IS NOT NULL
UNION ALL SELECT id, NULL, NULL, 'ok', 'no_score' FROM p WHERE c_a IS NULL""")
def marker_verdicts(spark, sf_dir):
    """What completeness and contamination say of a union."""
    k = F.col("c_custkey")
    p = fx.table(spark, sf_dir, "customer").select(k.alias("id"), F.when(k % 9 != 0, 40.0 + k % 37).alias("c_a"), (k % 5 * 1.0).alias("x_a"), (42.0 + k % 31).alias("c_b"), (k % 4 * 1.0).alias("x_b"), (45.0 + k % 43).alias("c_ab"), (k % 8 * 1.0).alias("x_ab"))
    return merge.marker_verdicts(p).select("id", "gain", "rise", F.lit("ok").alias("kind"), "decision")


@query("WITH r AS (SELECT least(l_suppkey, l_partkey % 50) AS a, greatest(l_suppkey, l_partkey % 50) AS b, min(l_extendedprice) AS separation FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1, 2) SELECT a, b, separation FROM r ORDER BY separation, a, b LIMIT 40")
def marker_candidates(spark, sf_dir):
    """The closest pairs that GC alone kept apart."""
    li = fx.table(spark, sf_dir, "lineitem")
    why = F.when(F.col("l_returnflag") == "A", "gc_diff").otherwise("misfit")
    other = F.col("l_partkey") % 50
    return merge.marker_candidates(li.select(F.least("l_suppkey", other).alias("a"), F.greatest("l_suppkey", other).alias("b"), F.col("l_extendedprice").alias("separation"), why.alias("refusal")))


@query(f"WITH {fx.CANDIDATES} SELECT name, round(c_ch, 6) AS ch, round(c_db, 6) AS db, round(c_si, 6) AS si, round(c_k10, 6) AS k10, round(c_k30, 6) AS k30 FROM ch")
def metric_changes(spark, sf_dir):
    """Q3: signed changes of the metrics that both sides have."""
    names = {"ch": "calinski_harabasz", "db": "davies_bouldin", "si": "silhouette", "k10": "knn_agree@10", "k30": "knn_agree@30"}
    x = quality.changes(fx.candidates(spark, sf_dir))
    return x.select("name", *(F.round(F.col("changes")[m], 6).alias(c) for c, m in names.items()))


@query(f"""WITH {fx.CANDIDATES}, k AS (SELECT *, coalesce(a_bp, 0) - coalesce(b_bp, 0) AS gain, list_filter([c_ch, c_db, c_si, r_k10, r_k30], lambda x: x IS NOT NULL) AS terms, list_filter([c_ch, c_db, c_si, c_k10, c_k30], lambda x: x IS NOT NULL) AS all_ch FROM ch),
v AS (SELECT *, list_avg(terms) AS col, list_min(all_ch) AS low, len(all_ch) > 0 AS known, coalesce(b_ch, b_db, b_si, b_k10, b_k30) IS NOT NULL AS had,
 concat_ws(';', CASE WHEN b_ch IS NOT NULL AND coalesce(c_ch < -0.1 - 1e-9, true) THEN 'calinski_harabasz' END, CASE WHEN b_k10 IS NOT NULL AND coalesce(c_k10 < -0.01 - 1e-9, true) THEN 'knn_agree@10' END, CASE WHEN b_k30 IS NOT NULL AND coalesce(c_k30 < -0.01 - 1e-9, true) THEN 'knn_agree@30' END,
 CASE WHEN col < -0.05 - 1e-9 THEN 'collective' END, CASE WHEN a_bp IS NOT NULL AND gain < -2 - 1e-9 THEN 'assigned_bp' END, CASE WHEN b_n >= 5 AND a_n < 0.7 * b_n - 1e-9 THEN 'bin_collapse' END) AS why FROM k)
SELECT name, CASE WHEN known THEN why = '' ELSE NOT had END AS passed, round(CASE WHEN known THEN col + 0.5 * gain / 100 WHEN had THEN -1e6 ELSE 0 END, 6) AS score, round(CASE WHEN known THEN col WHEN had THEN -1 ELSE 0 END, 6) AS collective,
 round(CASE WHEN known THEN low WHEN had THEN -1 ELSE 0 END, 6) AS worst, CASE WHEN known THEN why WHEN had THEN 'metrics undefined' ELSE '' END AS reasons FROM v""")
def judged_candidates(spark, sf_dir):
    """Q4: the gate's verdict on each candidate."""
    x = quality.judged(fx.candidates(spark, sf_dir), quality.Tolerance(points=1.0, collective=True))
    return x.select("name", "passed", *(F.round(c, 6).alias(c) for c in ("score", "collective", "worst")), F.concat_ws(";", "reasons").alias("reasons"))


@query(f"WITH {fx.CANDIDATES} SELECT name, NOT (a_n + 1e-9 < b_n) AS passed, round(weakest + 0.5 * (a_bp - b_bp) / 100, 6) AS score FROM cd")
def judged_splits(spark, sf_dir):
    """Q5: the gate's verdict on splits."""
    return quality.judged_splits(fx.candidates(spark, sf_dir)).select("name", "passed", F.round("score", 6).alias("score"))


@query(f"""WITH {SHAPES}, pr2 AS (SELECT p.label AS a, q.label AS b FROM (SELECT DISTINCT label FROM ex) p JOIN (SELECT DISTINCT label FROM ex) q ON p.label < q.label), fa AS (SELECT label, pos, abs(x - m) AS far FROM ex JOIN md USING (label, pos)),
sd AS (SELECT a, b, pos, greatest(median(far) * 1.4826, 0.05) AS sd FROM pr2 JOIN fa ON fa.label = a OR fa.label = b GROUP BY 1, 2, 3)
SELECT a, b, round(avg(abs(p.m - q.m) / sd), 5) AS z FROM sd JOIN md p ON p.label = a AND p.pos = sd.pos JOIN md q ON q.label = b AND q.pos = sd.pos GROUP BY 1, 2""")
def pooled_coverage(spark, sf_dir):
    """How far two bins' coverage is apart, in pooled deviations."""
    r = rows(spark, sf_dir).where("label >= 0")
    names = r.select("label").distinct()
    pairs = names.withColumnRenamed("label", "a").join(F.broadcast(names.withColumnRenamed("label", "b")), F.col("a") < F.col("b"))
    return groups.pooled_z(r, pairs).select("a", "b", F.round("z", 5).alias("z"))


@query()
def encoded_latents(spark, sf_dir):
    """M1-M3: latents by a variational autoencoder."""
    mu = encoder.encode(rows(spark, sf_dir), encoder.Vae(latent=8, epochs=5))
    return mu.select("contig_id", F.size("mu").alias("width"), V.norm(F.col("mu")).alias("size"))


@query()
def principal_components(spark, sf_dir):
    """M1: the linear baseline."""
    return encoder.principal_components(rows(spark, sf_dir), 8).select("contig_id", F.size("mu").alias("width"))


_GATES = f"""WITH {fx.LATENT}, g AS (SELECT contig_id, vec[1:32] AS a, vec[33:64] AS b, prob AS ra, 1 - prob AS rb FROM lat), f AS (SELECT *, CASE WHEN ra + rb > 0 THEN ra / (ra + rb) ELSE 0.5 END AS ga FROM g),
w AS (SELECT *, list_transform(list_zip(a, b), lambda p: ga * p[1] + (1 - ga) * p[2]) AS z FROM f)"""


@query(_GATES + " SELECT contig_id, round(ga, 6) AS gate, round(z[1], 6) AS first, round(z[32], 6) AS last FROM w")
def gated_fusion(spark, sf_dir):
    """M5: fusion by reliability gates."""
    r = rows(spark, sf_dir).select("contig_id", F.slice("vec", 1, 32).alias("a"), F.slice("vec", 33, 32).alias("b"), F.col("prob").alias("ra"), (1 - F.col("prob")).alias("rb"))
    g = encoder.gates({"a": F.col("ra"), "b": F.col("rb")})
    z = encoder.fused({"a": F.col("a"), "b": F.col("b")}, g)
    return r.select("contig_id", F.round(g["a"], 6).alias("gate"), F.round(F.element_at(z, 1), 6).alias("first"), F.round(F.element_at(z, 32), 6).alias("last"))


@query(_GATES + ", i AS (SELECT avg(list_distance(z, b)) / avg(sqrt(list_dot_product(z, z))) AS a, avg(list_distance(z, a)) / avg(sqrt(list_dot_product(z, z))) AS b FROM w) SELECT 'a' AS modality, round(a / (a + b), 6) AS influence FROM i UNION ALL SELECT 'b', round(b / (a + b), 6) FROM i")
def modality_influence(spark, sf_dir):
    """M7: influence by leaving a modality out."""
    r = rows(spark, sf_dir).select("contig_id", F.slice("vec", 1, 32).alias("a"), F.slice("vec", 33, 32).alias("b"), F.col("prob").alias("ra"), (1 - F.col("prob")).alias("rb"))
    return encoder.influence(r, {"a": "a", "b": "b"}, {"a": "ra", "b": "rb"}).select("modality", F.round("influence", 6).alias("influence"))


@query("WITH n AS (SELECT l_suppkey AS piece, l_linenumber AS bin, count(*) AS n, avg(l_discount) AS d FROM lineitem GROUP BY 1, 2), t AS (SELECT piece, sum(n) AS f, min(d) AS m FROM n GROUP BY 1), w AS (SELECT *, row_number() OVER (PARTITION BY piece ORDER BY n DESC, bin) AS k FROM n) SELECT w.piece, w.bin FROM w JOIN t USING (piece) WHERE k = 1 AND n >= 0.17 * f AND d <= 1.1 * m")
def best_homes(spark, sf_dir):
    """Where a piece belongs."""
    n = fx.table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("piece"), F.col("l_linenumber").alias("bin")).agg(F.count("*").alias("n"), F.avg("l_discount").alias("d"))
    return merge.best_home(n.select("piece", "bin", "n"), n.select("piece", "bin", "d"), 0.17, 1.1).select("piece", F.col("bin").cast("int").alias("bin"))


@query("WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), d AS (SELECT a.id AS query_id, b.id AS ref_id, list_distance(a.v, b.v) AS distance, row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.v, b.v), b.id) AS rank FROM v a, v b WHERE a.id <> b.id AND a.id % 50 = 0) SELECT query_id, ref_id, round(distance, 6) AS distance, CAST(rank AS INT) AS rank FROM d WHERE rank <= 10")
def nearest_rows(spark, sf_dir):
    """K1, K2: ten nearest of each query, exactly, in blocks."""
    r = rows(spark, sf_dir).select("contig_id", "vec")
    return knn(r.where("contig_id % 50 = 0"), r, 10).select("query_id", "ref_id", F.round("distance", 6).alias("distance"), "rank")
