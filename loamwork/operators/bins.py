"""Label vectors: eligibility, bin filters, identifiers and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamwork.operators.assembly import n50
from loamwork.operators.ordered import running
from loamwork.plans.workspace import settled


def eukaryote_bins(classified: DataFrame, share: float = 0.5) -> DataFrame:
    """Bin, eukaryote_share, eligible."""
    x = classified.groupBy("bin").agg(F.avg((F.col("classification") == "Eukaryotic").cast("double")).alias("eukaryote_share"))
    return x.withColumn("eligible", F.col("eukaryote_share") >= share)


def organelle_evidence(classified: DataFrame, level: float = 0.9) -> DataFrame:
    """Organelle contigs; a finite confidence of at least level is high."""
    sure = F.coalesce((F.col("confidence") >= level) & ~F.isnan("confidence"), F.lit(False))
    return classified.where(F.col("classification").isin("Mitochondrial", "Plastid")).withColumn("evidence", F.when(sure, "high_confidence").otherwise("candidate"))


def eligibility(rows: DataFrame, min_length: int) -> DataFrame:
    """Eligible, reason; a missing coverage outranks a short length."""
    reason = F.when(F.col("valid_mask") <= 0, "invalid_coverage").when(F.col("length") < min_length, "too_short").otherwise("")
    return rows.withColumn("reason", reason).withColumn("eligible", F.col("reason") == "")


def anchors(rows: DataFrame, tiers: list[tuple[float, float, float]], least: int = 10) -> DataFrame:
    """The first tier (length, weight, variance) with enough rows, else the longest tenth.

    One aggregate counts all tiers; the tier is then a plain filter.
    """
    test = lambda t: (F.col("length") >= t[0]) & (F.col("weight") >= t[1]) & ((F.col("variance") <= t[2]) if t[2] != float("inf") else F.lit(True))
    counts = rows.agg(F.count("*").alias("n"), *(F.sum(test(t).cast("long")).alias(f"t{i}") for i, t in enumerate(tiers))).first()
    for i, t in enumerate(tiers):
        if (counts[f"t{i}"] or 0) >= least:
            return rows.where(test(t))
    return rows.orderBy(F.desc("length"), F.desc("contig_id")).limit(max(10, counts["n"] // 10))


def probability_filter(rows: DataFrame, least: float) -> DataFrame:
    """Labels of lower probability become noise."""
    return rows.withColumn("label", F.when(F.col("prob") < least, -1).otherwise(F.col("label")))


def bin_sizes(rows: DataFrame) -> DataFrame:
    """label, n_contigs, total_bp, max_len, mean_len, n50 of each bin."""
    x = rows.where("label >= 0")
    by = x.groupBy("label").agg(F.count("*").alias("n_contigs"), F.sum("length").alias("total_bp"), F.max("length").alias("max_len"), F.floor(F.avg("length")).cast("long").alias("mean_len"))
    return by.join(n50(x, ["label"]).select("label", "n50"), "label")


def filter_bins(rows: DataFrame, min_contigs: int, min_bp: int, min_n50: int) -> DataFrame:
    """Rows with label, failing bins as noise, and the reason."""
    reason = F.when(F.col("n_contigs") < min_contigs, "too_few_contigs").when(F.col("total_bp") < min_bp, "too_short").when(F.col("n50") < min_n50, "low_n50").otherwise("")
    failed = bin_sizes(rows).select("label", reason.alias("reason"))
    x = rows.join(failed, "label", "left").withColumn("reason", F.coalesce("reason", F.lit("")))
    return x.withColumn("label", F.when(F.col("reason") != "", -1).otherwise(F.col("label")))


def dense_ids(rows: DataFrame) -> DataFrame:
    """Label, dense, bin_id: bin_001 and so on in label order, as many digits as needed, at least three."""
    labels = rows.where("label >= 0").select("label").distinct()
    numbered = running(labels, [F.asc("label")], {"dense": F.lit(1)}).withColumn("dense", F.col("dense").cast("int"))
    n = labels.agg(F.greatest(F.lit(3), F.length(F.count("*").cast("string"))).alias("digits"))
    return numbered.join(F.broadcast(n)).select("label", "dense", F.concat(F.lit("bin_"), F.lpad(F.col("dense").cast("string"), F.col("digits").cast("int"), F.lit("0"))).alias("bin_id"))


def summary(rows: DataFrame) -> DataFrame:
    """A line for each bin and one for what is unbinned."""
    lines = bin_sizes(rows).join(dense_ids(rows), "label").select("bin_id", "n_contigs", "total_bp", "mean_len", "max_len", "n50")
    rest = rows.where("label < 0").agg(F.count("*").alias("n_contigs"), F.coalesce(F.sum("length"), F.lit(0)).alias("total_bp"), F.coalesce(F.floor(F.avg("length")).cast("long"), F.lit(0)).alias("mean_len"), F.coalesce(F.max("length"), F.lit(0)).alias("max_len"))
    return lines.union(rest.select(F.lit("unbinned"), "n_contigs", "total_bp", "mean_len", "max_len", F.lit(0).cast("long")))


def size_gini(sizes: Column | str, rows: DataFrame) -> DataFrame:
    """The Gini coefficient of sizes; equal sizes are counted, so that they share a run of places."""
    x = rows.select(F.col(sizes).cast("double").alias("x") if isinstance(sizes, str) else sizes.alias("x")).groupBy("x").agg(F.count("*").alias("n"))
    placed, n = running(x, [F.asc("x")], {"upto": F.col("n")}), F.col("n")
    places = n * F.col("upto") - n * (n - 1) / 2  # the sum of the run's places
    all_n, all_x = F.sum("n"), F.sum(n * F.col("x"))
    return placed.agg(F.coalesce((2 * F.sum(places * F.col("x")) - (all_n + 1) * all_x) / (all_n * all_x), F.lit(0.0)).alias("size_gini"))


def shares(rows: DataFrame) -> DataFrame:
    """Noise and assigned bp in percent of the pool (column pool), noise of the eligible (column eligible)."""
    noise, pct = (F.col("label") < 0).cast("double"), F.lit(100.0)
    only = lambda cond, x: F.sum(F.when(F.col(cond), x).otherwise(0.0))
    one = F.lit(1.0)
    return rows.agg((pct * only("pool", noise) / F.greatest(only("pool", one), one)).alias("noise_pct"), (pct * only("eligible", noise) / F.greatest(only("eligible", one), one)).alias("noise_pct_eligible"), (pct * only("pool", (1 - noise) * F.col("length")) / F.greatest(only("pool", F.col("length").cast("double")), one)).alias("assigned_bp_pct"))


def known_ids(table: DataFrame, ids: DataFrame, least: float = 0.5) -> DataFrame:
    """How many rows of a table have known ids, and whether it is usable."""
    x = table.join(ids.select("contig_id", F.lit(1).alias("known")), "contig_id", "left")
    return x.agg(F.count("*").alias("n"), F.count("known").alias("matched")).withColumn("usable", F.col("matched") >= least * F.col("n"))


#: Contigs of a set that another set must hold before all are compared.
PIVOTS = 4


def merge_covers(before: DataFrame, after: DataFrame) -> DataFrame:
    """Relational division: which sets of before (set_id, contig_id) each set of after holds whole, and whether they make it up.

    What holds a set holds its rarest PIVOTS contigs, so only sets of after that do are
    looked at contig by contig: work follows the rows, not all pairs of sets that share one.
    """
    before, after = settled(before.select("set_id", "contig_id")), settled(after.select("out_id", "contig_id"))
    total = before.groupBy("set_id").agg(F.count("*").alias("of"))
    seen = before.join(after.groupBy("contig_id").agg(F.count("*").alias("often")), "contig_id", "left")
    rare = seen.withColumn("k", F.row_number().over(Window.partitionBy("set_id").orderBy(F.coalesce("often", F.lit(0)), "contig_id"))).where(F.col("k") <= PIVOTS)
    hopeful = after.join(rare, "contig_id").groupBy("out_id", "set_id").agg(F.count("*").alias("n")).join(total, "set_id").where(F.col("n") == F.least("of", F.lit(PIVOTS)))
    hopeful = settled(hopeful.select("out_id", "set_id", "of"))
    inside = hopeful.join(before, "set_id").join(after, ["out_id", "contig_id"]).groupBy("out_id", "set_id", "of").agg(F.count("*").alias("n")).where("n = of")
    size = after.groupBy("out_id").agg(F.count("*").alias("size"))
    return inside.groupBy("out_id").agg(F.count("*").alias("sources"), F.sum("of").alias("covered")).join(size, "out_id").select("out_id", "sources", (F.col("covered") == F.col("size")).alias("exact"))


def link_sums(links: DataFrame) -> DataFrame:
    """Links of each unordered pair of bins over all tables; rows without a number are left out."""
    n = F.expr("try_cast(links as bigint)")
    return links.withColumn("n", n).where("n is not null and bin_1 <> bin_2").groupBy(F.least("bin_1", "bin_2").alias("bin_1"), F.greatest("bin_1", "bin_2").alias("bin_2")).agg(F.sum("n").alias("links"))
