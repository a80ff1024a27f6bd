"""Queries on repeat hits."""

from __future__ import annotations

from loamwork.operators import repeats, search
from loamwork.operators.repeats import CLASS_KEYWORDS, CLASS_TOKENS, SKIP_TOKENS
from loamwork.plans import fixtures as fx
from loamwork.plans.registry import query
from pyspark.sql import functions as F


def _in(names: list[str]) -> str:
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


_TOKEN = "trim(split_part(upper(list_last(string_split(target, '#'))), '/', 1))"
CLASS_SQL = f"""CASE WHEN contains(target, '#') THEN CASE WHEN {_TOKEN} IN {_in(SKIP_TOKENS)} THEN 'Skip' {" ".join(f"WHEN {_TOKEN} IN {_in(t)} THEN '{k}'" for k, t in CLASS_TOKENS.items())} ELSE 'Unclassified' END
  ELSE CASE {" ".join(f"WHEN regexp_matches(lower(target), '{'|'.join(w)}') THEN '{k}'" for k, w in CLASS_KEYWORDS.items())} ELSE 'Unclassified' END END"""
USABLE = fx.HITS + f""",
usable AS (SELECT * FROM (SELECT *, {CLASS_SQL} AS te_class, least(qstart, qend) AS lo, greatest(qstart, qend) AS hi, greatest(qstart, qend) - least(qstart, qend) + 1 AS bases FROM hits) WHERE bases >= 30 AND te_class <> 'Skip')"""
ISLANDS = USABLE + """,
marked AS (SELECT contig_id, lo, hi, CASE WHEN lo > max(hi) OVER w THEN 1 ELSE 0 END AS opens FROM usable WINDOW w AS (PARTITION BY contig_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
numbered AS (SELECT *, sum(opens) OVER (PARTITION BY contig_id ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS island FROM marked),
islands AS (SELECT contig_id, min(lo) AS lo, max(hi) AS hi FROM numbered GROUP BY contig_id, island)"""
SUMMARY = ISLANDS + """,
merged AS (SELECT contig_id, sum(hi - lo + 1) AS merged_te_bp FROM islands GROUP BY 1),
summary AS (SELECT contig_id, sum(CASE WHEN te_class = 'LTR' THEN bases ELSE 0 END) AS ltr_bp, sum(CASE WHEN te_class = 'DNA' THEN bases ELSE 0 END) AS dna_bp,
  sum(CASE WHEN te_class = 'LINE' THEN bases ELSE 0 END) AS line_bp, sum(CASE WHEN te_class = 'Unclassified' THEN bases ELSE 0 END) AS unclassified_bp,
  sum(bases) AS total_te_bp, any_value(merged_te_bp) AS merged_te_bp, count(*) AS n_hits, sum(pident) AS quality_sum FROM usable JOIN merged USING (contig_id) GROUP BY contig_id)"""
_B = "CAST({0} AS BIGINT) AS {0}"


@query(f"WITH {USABLE} SELECT te_class, count(*) AS n, CAST(sum(bases) AS BIGINT) AS bases FROM usable GROUP BY 1")
def te_classes(spark, sf_dir):
    """Usable hits by class."""
    return repeats.usable_hits(fx.hits(spark, sf_dir)).groupBy("te_class").agg(F.count("*").alias("n"), F.sum("bases").cast("long").alias("bases"))


@query(f"WITH {ISLANDS} SELECT contig_id, CAST(lo AS BIGINT) AS lo, CAST(hi AS BIGINT) AS hi FROM islands")
def te_islands(spark, sf_dir):
    """Merged intervals."""
    h = repeats.usable_hits(fx.hits(spark, sf_dir))
    return repeats.islands(h).select("contig_id", F.col("lo").cast("long"), F.col("hi").cast("long"))


@query(f"WITH {SUMMARY} SELECT contig_id, {', '.join(_B.format(c) for c in ('ltr_bp', 'dna_bp', 'line_bp', 'unclassified_bp', 'total_te_bp', 'merged_te_bp', 'n_hits'))}, round(quality_sum, 4) AS quality_sum FROM summary")
def te_summary(spark, sf_dir):
    """Sums of each contig."""
    s = repeats.summarize(fx.hits(spark, sf_dir))
    return s.select("contig_id", *(F.col(c).cast("long") for c in s.columns[1:-1]), F.round("quality_sum", 4).alias("quality_sum"))


_X = f"""WITH {SUMMARY}, x AS (SELECT i.contig_id, i.length, coalesce(total_te_bp, 0) AS t, coalesce(merged_te_bp, 0) AS m, coalesce(ltr_bp, 0) AS l, coalesce(dna_bp, 0) AS d, coalesce(line_bp, 0) AS n, coalesce(unclassified_bp, 0) AS u, coalesce(n_hits, 0) AS h, coalesce(quality_sum, 0) AS q FROM ids i LEFT JOIN summary USING (contig_id)),
y AS (SELECT *, length > 0 AND t > 0 AND h > 0 AS ok FROM x)"""


@query(_X + """ SELECT contig_id, round(CASE WHEN ok THEN sqrt(((l>0)::INT + (d>0)::INT + (n>0)::INT + (u>0)::INT) / 4.0) ELSE 0 END, 6) AS te_diversity,
 round(CASE WHEN ok THEN sqrt(least(1.0, m / length)) ELSE 0 END, 6) AS te_density, round(CASE WHEN ok THEN sqrt(d / t) ELSE 0 END, 6) AS dna_share, round(CASE WHEN ok THEN sqrt(l / t) ELSE 0 END, 6) AS ltr_share,
 round(CASE WHEN ok THEN sqrt(u / t) ELSE 0 END, 6) AS unclassified_share,
 round(CASE WHEN ok THEN least(1.0, greatest(0.0, 0.55 * least(1.0, m / 500.0) * least(1.0, length / 8000.0) + 0.25 * least(1.0, h / 5.0) + 0.20 * least(1.0, greatest(0.0, q / h / 100.0)))) ELSE 0 END, 6) AS te_weight FROM y""")
def te_features(spark, sf_dir):
    """Repeat features and weight of every contig (the flagship query)."""
    f = repeats.features(repeats.summarize(fx.hits(spark, sf_dir)), fx.part_contigs(spark, sf_dir))
    return f.select("contig_id", *(F.round(c, 6).alias(c) for c in f.columns[1:]))


@query(f"WITH {SUMMARY}, s AS (SELECT CAST(sum((ltr_bp>0)::INT) AS BIGINT) AS n_ltr, CAST(sum((dna_bp>0)::INT) AS BIGINT) AS n_dna, CAST(sum((line_bp>0)::INT) AS BIGINT) AS n_line, CAST(sum((unclassified_bp>0)::INT) AS BIGINT) AS n_unclassified FROM summary) SELECT *, (n_ltr+n_dna+n_line+n_unclassified) >= 20 AND n_unclassified > 0.95*(n_ltr+n_dna+n_line+n_unclassified) AS warn FROM s")
def te_class_signals(spark, sf_dir):
    """Contigs with signal by class."""
    return repeats.class_signals(repeats.summarize(fx.hits(spark, sf_dir)))


@query(f"WITH {USABLE} SELECT contig_id, CAST(lo - 1 AS BIGINT) AS start, CAST(hi AS BIGINT) AS stop, target, te_class FROM usable")
def te_bed(spark, sf_dir):
    """S3: hits as BED intervals."""
    b = repeats.bed(fx.hits(spark, sf_dir))
    return b.select("contig_id", F.col("start").cast("long"), F.col("stop").cast("long"), "target", "te_class")


@query(f"WITH {fx.HITS} SELECT contig_id, count(*) AS n FROM hits WHERE contig_id NOT IN (SELECT contig_id FROM ids WHERE length < 8000) GROUP BY 1")
def te_orphan_hits(spark, sf_dir):
    """Hits on contigs missing from a list (here the shorter contigs only)."""
    listed = fx.part_contigs(spark, sf_dir).where("length < 8000")
    return repeats.unknown_contigs(fx.hits(spark, sf_dir), listed).groupBy("contig_id").agg(F.count("*").alias("n"))


@query()
def passage_hits(spark, sf_dir):
    """Hits of the benchmark's texts, as sequences, on all contigs."""
    return search.search(fx.letters(spark, sf_dir).select(F.col("contig_id").alias("name"), "seq"), fx.letter_library(spark, sf_dir), max_evalue=1e-12)
