"""Queries on domain calls, coverage rules and scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from loamwork.functions import kmers, sequence
from loamwork.operators import classify, scoring
from loamwork.operators.classify import CATEGORIES, EUKARYOTE_WORDS, ORGANELLES, PROBABILITY_COLUMNS, PROKARYOTE_WORDS, Policy
from loamwork.plans import fixtures as fx
from loamwork.plans.registry import query
from loamwork.plans.workspace import settled

POLICY = Policy(remove_mitochondrial=True, prokaryote_min_length=300, tiara_min_length=400, whokaryote_min_length=250)
AGREE = Policy(agree_only=True, remove_plastid=True, remove_unknown=True, tiara_min_length=400, whokaryote_min_length=250)


def _in(names) -> str:
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


_PROK = "('Bacterial', 'Archaeal', 'Prokaryotic_Unclassified')"
CLASSIFIED = f"""WITH {fx.CALLS},
a AS (SELECT *, CASE WHEN stage1 = 'organelle' AND stage2 IN {_in(ORGANELLES)} THEN stage2 WHEN stage1 IN ('', 'n/a', 'nan', 'none') THEN CASE WHEN stage2 IN {_in(ORGANELLES)} THEN stage2 ELSE 'unknown' END ELSE stage1 END AS tiara_label,
  CASE WHEN lower(whokaryote_raw) IN {_in(EUKARYOTE_WORDS)} THEN 'eukaryote' WHEN lower(whokaryote_raw) IN {_in(PROKARYOTE_WORDS)} THEN 'prokaryote' END AS who FROM calls),
b AS (SELECT *, CAST(CASE WHEN tiara_label = 'prokarya' THEN CASE WHEN bac + arc <= 1.000001 THEN bac + arc END {" ".join(f"WHEN tiara_label = '{k}' THEN {v}" for k, v in PROBABILITY_COLUMNS.items())} END AS DOUBLE) AS p,
  CASE {" ".join(f"WHEN tiara_label = '{k}' THEN '{v}'" for k, v in CATEGORIES.items())} ELSE 'Unknown' END AS cat FROM a),
d AS (SELECT *, cat IN {_PROK} AS is_p, cat = 'Eukaryotic' AS is_e, coalesce(who = 'prokaryote', false) AS wp, coalesce(who = 'eukaryote', false) AS we, coalesce(p >= 0.9, false) AS sure FROM b),
e AS (SELECT *, CASE WHEN cat IN ('Mitochondrial', 'Plastid') THEN 1 WHEN (wp AND is_e) OR (we AND is_p) THEN CASE WHEN sure THEN 2 ELSE 3 END WHEN (wp AND is_p) OR (we AND is_e) THEN 4 WHEN wp THEN 5 WHEN we THEN 6 WHEN is_p OR is_e THEN 7 ELSE 8 END AS rule FROM d),
f AS (SELECT *, CASE WHEN rule IN (1, 2, 4, 7) THEN cat WHEN rule = 3 THEN CASE WHEN wp THEN 'Prokaryotic_Unclassified' ELSE 'Eukaryotic' END WHEN rule = 5 THEN 'Prokaryotic_Unclassified' WHEN rule = 6 THEN 'Eukaryotic' ELSE 'Unknown' END AS classification,
  CAST(CASE rule WHEN 1 THEN coalesce(p, 0.9) WHEN 2 THEN p WHEN 3 THEN 0.75 WHEN 4 THEN coalesce(p, 0.9) WHEN 5 THEN 0.75 WHEN 6 THEN 0.85 WHEN 7 THEN coalesce(p, 0.6) ELSE 0.0 END AS DOUBLE) AS confidence,
  CASE WHEN rule = 2 OR (rule IN (1, 4, 7) AND p IS NOT NULL) THEN 'probability' WHEN rule = 8 THEN 'no_call' ELSE 'rule_based' END AS confidence_type,
  list_extract(['tiara_organelle', 'conflict_tiara_override', 'conflict_whokaryote_wins', 'whokaryote+tiara', 'whokaryote', 'whokaryote', 'tiara_only', 'no_classifier_call'], rule) AS source, rule IN (2, 3) AS conflict FROM e),
cl AS (SELECT *, CASE WHEN conflict THEN 'classifier_disagreement' WHEN classification <> 'Unknown' THEN source WHEN length < 250 THEN 'below_all_classifier_cutoffs' WHEN length < 400 THEN 'below_tiara_cutoff_whokaryote_no_call' ELSE 'classifier_no_call' END AS call_basis FROM f)"""


@query(CLASSIFIED + " SELECT contig_id, tiara_label, p AS tiara_prob, who AS whokaryote_label, classification, confidence, confidence_type, source, conflict, call_basis FROM cl")
def domain_calls(spark, sf_dir):
    """The classification table."""
    x = classify.classify(fx.calls(spark, sf_dir), POLICY)
    return x.select("contig_id", "tiara_label", F.col("tiara_prob").cast("double").alias("tiara_prob"), "whokaryote_label", "classification", "confidence", "confidence_type", "source", "conflict", "call_basis")


@query(CLASSIFIED + " SELECT classification, source, conflict, count(*) AS n FROM cl GROUP BY ALL")
def domain_summary(spark, sf_dir):
    """Calls by class and source."""
    return classify.classify(fx.calls(spark, sf_dir), POLICY).groupBy("classification", "source", "conflict").agg(F.count("*").alias("n"))


_HIGH = "CASE confidence_type WHEN 'probability' THEN confidence >= 0.8 WHEN 'rule_based' THEN source = 'whokaryote+tiara' ELSE false END"


@query(CLASSIFIED + f""", x AS (SELECT *, CASE WHEN classification IN {_PROK} THEN length >= 300 WHEN classification = 'Mitochondrial' THEN {_HIGH} ELSE false END AS removed FROM cl WHERE ord % 11 <> 0)
SELECT c.contig_id, coalesce(removed, false) AS removed, CASE WHEN classification IS NULL THEN 'no_classification' WHEN removed THEN lower(classification) WHEN classification IN {_PROK} THEN CASE WHEN x.length < 300 THEN 'below_prokaryote_min_length' ELSE 'prokaryote_call_retained' END
  WHEN classification = 'Mitochondrial' THEN 'mitochondrial_below_confidence' WHEN classification = 'Plastid' THEN 'plastid_flagged_not_removed' WHEN classification = 'Unknown' THEN 'unknown_no_classifier_call_kept' ELSE '' END AS reason FROM c LEFT JOIN x USING (contig_id)""")
def domain_removal(spark, sf_dir):
    """Removal in mode 'any'; contigs without a row are kept."""
    x = classify.classify(fx.calls(spark, sf_dir).where(F.col("ord") % 11 != 0), POLICY)
    return classify.removal_table(fx.contigs(spark, sf_dir), x, POLICY)


@query(CLASSIFIED + f""", x AS (SELECT *, CASE WHEN classification IN {_PROK} THEN source = 'whokaryote+tiara' WHEN classification = 'Plastid' THEN {_HIGH} WHEN classification = 'Unknown' THEN confidence_type = 'no_call' ELSE false END AS removed FROM cl)
SELECT contig_id, removed, CASE WHEN removed THEN lower(classification) WHEN classification IN {_PROK} THEN 'no_tiara_whokaryote_agreement' WHEN classification = 'Mitochondrial' THEN 'mitochondrial_flagged_not_removed' WHEN classification = 'Plastid' THEN 'plastid_below_confidence' WHEN classification = 'Unknown' THEN 'unknown_no_classifier_call_kept' ELSE '' END AS reason FROM x""")
def domain_removal_agree(spark, sf_dir):
    """Removal in mode 'agree', of plastids and of unknowns."""
    return classify.removal_table(fx.contigs(spark, sf_dir), classify.classify(fx.calls(spark, sf_dir), AGREE), AGREE)


@query(CLASSIFIED + " SELECT sample AS bin, avg((classification = 'Eukaryotic')::INT) AS eukaryote_share, avg((classification = 'Eukaryotic')::INT) >= 0.3 AS eligible FROM cl GROUP BY 1")
def eukaryote_share(spark, sf_dir):
    """Which bins hold enough eukaryote contigs."""
    from loamwork.operators.bins import eukaryote_bins

    x = classify.classify(fx.calls(spark, sf_dir), POLICY)
    return eukaryote_bins(x.withColumn("bin", F.col("sample")), 0.3)


@query(CLASSIFIED + " SELECT contig_id, CASE WHEN coalesce(confidence, 0) >= 0.9 THEN 'high_confidence' ELSE 'candidate' END AS evidence FROM cl WHERE classification IN ('Mitochondrial', 'Plastid')")
def organelle_evidence(spark, sf_dir):
    """Organelle contigs by evidence."""
    from loamwork.operators.bins import organelle_evidence as evidence

    return evidence(classify.classify(fx.calls(spark, sf_dir), POLICY)).select("contig_id", "evidence")


ADAPTIVE = f"""WITH {fx.DEPTH}, st AS (SELECT contig_id, max(breadth) AS most, CAST(sum((depth > 0)::INT) AS BIGINT) AS n_present FROM cov GROUP BY 1),
bs AS (SELECT contig_id, depth, breadth FROM (SELECT *, row_number() OVER (PARTITION BY contig_id ORDER BY depth DESC, sample) AS k FROM cov WHERE breadth >= 0.5) WHERE k = 1),
ad AS (SELECT st.contig_id, coalesce(bs.depth, 0) AS coverage, coalesce(bs.breadth, most) AS breadth, n_present FROM st LEFT JOIN bs USING (contig_id))"""


@query(ADAPTIVE + " SELECT contig_id, coverage, round(breadth, 6) AS breadth, n_present FROM ad")
def adaptive_sample(spark, sf_dir):
    """Coverage and breadth of the best single sample."""
    return scoring.adaptive_stats(fx.depth(spark, sf_dir), "sample", 0.5).withColumn("breadth", F.round("breadth", 6))


@query(f"WITH {fx.DEPTH} SELECT contig_id, round(sum(depth) / 6, 6) AS mean_coverage, round(max(depth), 6) AS max_coverage, round(sum(breadth) / 6, 6) AS mean_breadth, round(max(breadth), 6) AS max_breadth FROM cov GROUP BY 1")
def adaptive_mean_max(spark, sf_dir):
    """Mean over all samples, and separate maxima."""
    d = fx.depth(spark, sf_dir)
    a, b = scoring.adaptive_stats(d, "mean", n_samples=6), scoring.adaptive_stats(d, "max")
    r = lambda x, c, n: F.round(x[c], 6).alias(n)
    return a.join(b, "contig_id").select("contig_id", r(a, "coverage", "mean_coverage"), r(b, "coverage", "max_coverage"), r(a, "breadth", "mean_breadth"), r(b, "breadth", "max_breadth"))


_FILTERED = ADAPTIVE + """, x AS (SELECT ids.contig_id, length, coalesce(coverage, 0) AS coverage, coalesce(breadth, 0) AS breadth, coalesce(n_present, 0) AS n FROM ids LEFT JOIN ad USING (contig_id)),
af AS (SELECT contig_id, length, breadth, CASE WHEN length < 4500 THEN 'too_short' WHEN length >= 7000 THEN 'main' WHEN coverage >= 50 AND n >= 1 AND breadth >= 0.5 THEN 'short_survivor' ELSE 'below_adaptive_thresholds' END AS reason FROM x)"""


def _filtered(spark, sf_dir):
    stats = scoring.adaptive_stats(fx.depth(spark, sf_dir), "sample", 0.5)
    return scoring.adaptive_filter(fx.part_contigs(spark, sf_dir), stats, 4500, 7000, min_coverage=50.0, min_breadth=0.5)


@query(_FILTERED + " SELECT contig_id, reason IN ('main', 'short_survivor') AS kept, length >= 7000 AND breadth < 0.5 AS low_breadth, reason FROM af")
def adaptive_filter(spark, sf_dir):
    """Triage by length and coverage."""
    return _filtered(spark, sf_dir)


@query(_FILTERED + " SELECT reason, count(*) AS n, CAST(sum((length >= 7000 AND breadth < 0.5)::INT) AS BIGINT) AS low_breadth FROM af GROUP BY 1")
def adaptive_counts(spark, sf_dir):
    """Counters of the triage."""
    return _filtered(spark, sf_dir).groupBy("reason").agg(F.count("*").alias("n"), F.sum(F.col("low_breadth").cast("long")).alias("low_breadth"))


@query(f"""WITH {fx.DEPTH}, x AS (SELECT contig_id, sum(depth) AS s, sum(depth * depth) AS ss FROM cov GROUP BY 1)
SELECT contig_id, round(s / 6, 6) AS mean_cov, round(CASE WHEN s > 0 THEN sqrt(greatest(0, (ss - s * s / 6) / 5)) / (s / 6) ELSE 0 END, 6) AS cov_cv FROM x""")
def coverage_variation(spark, sf_dir):
    """Coverage mean and coefficient of variation."""
    x = scoring.coverage_variation(fx.depth(spark, sf_dir), 6)
    return x.select("contig_id", F.round("mean_cov", 6).alias("mean_cov"), F.round("cov_cv", 6).alias("cov_cv"))


def _scored(spark, sf_dir):
    """Classified contigs with z-scores of GC and of the distance from the mean composition; composition is counted once."""
    v = settled(kmers.tnf(fx.contigs(spark, sf_dir)).select("contig_id", "features"))
    far = v.join(F.broadcast(kmers.mean_vector(v))).select("contig_id", F.sqrt(F.aggregate(F.zip_with("features", "mean", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)).alias("tnf_distance"))
    c = classify.classify(fx.calls(spark, sf_dir), POLICY).withColumn("gc", sequence.gc_share(F.col("seq"))).drop("seq").join(far, "contig_id")
    return scoring.z_scores(settled(c), {"gc": "gc_z", "tnf_distance": "tnf_z"})


def _with_coverage(spark, sf_dir):
    """Scored contigs with the variation of their coverage (G12) and what the adaptive filter says of their breadth."""
    x, depth = _scored(spark, sf_dir), settled(fx.contig_depth(spark, sf_dir))
    breadth = scoring.adaptive_filter(x, scoring.adaptive_stats(depth, "sample", 0.473), 200, 400, min_breadth=0.473).select("contig_id", "low_breadth")
    return x.join(scoring.coverage_variation(depth, 6).select("contig_id", "cov_cv"), "contig_id", "left").join(breadth, "contig_id")


SCORED = CLASSIFIED + """, w AS (SELECT contig_id, substr(seq, CAST(i AS INT), 4) AS x FROM (SELECT contig_id, seq, unnest(range(1, length - 2)) AS i FROM c WHERE length >= 4)),
k AS (SELECT contig_id, least(x, reverse(translate(x, 'ACGT', 'TGCA'))) AS kmer, count(*) AS n FROM w WHERE NOT regexp_matches(x, '[^ACGT]') GROUP BY 1, 2),
sh AS (SELECT contig_id, kmer, n / CAST(sum(n) OVER (PARTITION BY contig_id) AS DOUBLE) AS s FROM k), mean AS (SELECT kmer, sum(s) / (SELECT count(*) FROM c) AS m FROM sh GROUP BY 1),
td AS (SELECT c.contig_id, sqrt((SELECT sum(m * m) FROM mean) + coalesce(sum(s * s - 2 * s * m), 0)) AS d FROM c LEFT JOIN sh USING (contig_id) LEFT JOIN mean USING (kmer) GROUP BY 1),
g AS (SELECT contig_id, CASE WHEN length = 0 THEN 0 ELSE length(regexp_replace(seq, '[^GC]', '', 'g')) / CAST(length AS DOUBLE) END AS gc FROM c),
z AS (SELECT g.contig_id, (gc - avg(gc) OVER ()) / stddev_pop(gc) OVER () AS gc_z, (d - avg(d) OVER ()) / stddev_pop(d) OVER () AS tnf_z FROM g JOIN td USING (contig_id))"""


@query(SCORED + " SELECT contig_id, round(gc_z, 5) AS gc_z, round(tnf_z, 5) AS tnf_z FROM z")
def composition_z(spark, sf_dir):
    """Z-scores of GC and of the distance from the mean composition."""
    return _scored(spark, sf_dir).select("contig_id", F.round("gc_z", 5).alias("gc_z"), F.round("tnf_z", 5).alias("tnf_z"))


@query(SCORED + f""", {fx.CONTIG_DEPTH}, q AS (SELECT cl.*, CASE WHEN classification IN {_PROK} THEN length >= 300 WHEN classification = 'Mitochondrial' THEN {_HIGH} ELSE false END AS gone,
 list_filter([CASE WHEN cov_cv > 1.5 THEN 'high coverage variance' END, CASE WHEN abs(gc_z) > 2 THEN 'GC outlier' END, CASE WHEN abs(tnf_z) > 1.5 THEN 'TNF composition outlier' END, CASE WHEN classification = 'Unknown' THEN 'unclassified' END,
  CASE WHEN classification IN {_PROK} THEN 'prokaryote call retained: ' || CASE WHEN length < 300 THEN 'below_prokaryote_min_length' ELSE 'prokaryote_call_retained' END END,
  CASE WHEN classification = 'Mitochondrial' THEN 'mitochondrial call retained: mitochondrial_below_confidence' WHEN classification = 'Plastid' THEN 'plastid call retained: plastid_flagged_not_removed' END,
  CASE WHEN length >= 400 AND coalesce(breadth, 0) < 0.473 THEN 'low breadth' END], lambda x: x IS NOT NULL) AS w FROM cl JOIN z USING (contig_id) LEFT JOIN cvv USING (contig_id) LEFT JOIN cbr USING (contig_id))
SELECT contig_id, CASE WHEN gone THEN 'remove_high_confidence_contaminant' WHEN len(w) >= 2 THEN 'uncertain' WHEN len(w) = 1 THEN 'retain_with_warning' ELSE 'retain' END AS decision,
 array_to_string(CASE WHEN gone THEN list_append(w, 'borderline ' || classification) ELSE w END, '; ') AS reasons FROM q""")
def contig_decisions(spark, sf_dir):
    """Decisions by several signals."""
    return scoring.decisions(_with_coverage(spark, sf_dir), POLICY, cv=1.5, gc=2.0, tnf=1.5)


_WIDE = ["contig", "s1 Mean", "s1 Covered Fraction", "s2 Mean", "s2 Breadth", "s2 Length"]


@query("SELECT l_partkey AS contig, round(max(l_quantity) + max(l_extendedprice), 4) AS depth, round(max(l_discount) + max(l_tax), 4) AS breadth FROM lineitem GROUP BY 1")
def depth_and_breadth(spark, sf_dir):
    """Which columns of a wide table are depths and which are breadths, by their names."""
    li = fx.table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.max("l_quantity"), F.max("l_discount"), F.max("l_extendedprice"), F.max("l_tax"), F.max("l_linenumber"))
    wide = li.toDF(*_WIDE)
    depth, breadth = scoring.split_columns(wide.columns)
    total = lambda names: F.round(sum((F.col(f"`{n}`") for n in names[1:]), F.col(f"`{names[0]}`")), 4)
    return wide.select("contig", total(depth).alias("depth"), total(breadth).alias("breadth"))
