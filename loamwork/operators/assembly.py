"""Assembly statistics, duplicates, containment and the audit table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamwork.operators.ordered import running
from loamwork.plans.workspace import settled


def n50(lengths: DataFrame, keys: list[str], length: str = "length") -> DataFrame:
    """Keys, n50, l50: the first length, longest first, at which half of the total is reached.

    Lengths are counted first, so the running sum is over distinct lengths, not rows; without
    keys it runs over ranges of lengths side by side.
    """
    by = lengths.groupBy(*keys, F.col(length).alias("len")).agg(F.count("*").alias("n"))
    bp, order = F.col("len") * F.col("n"), F.desc("len")
    if not keys:
        return _half(running(by, [order], {"run": bp, "rank": F.col("n")}).join(F.broadcast(by.agg(F.sum(bp).alias("total")))), keys)  # one row
    upto = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return _half(by.select(*keys, "len", "n", F.sum(bp).over(upto).alias("run"), F.sum("n").over(upto).alias("rank"), F.sum(bp).over(Window.partitionBy(*keys)).alias("total")), keys)


def _half(runs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n50, l50 from counted lengths with running and whole sums."""
    before = F.col("run") - F.col("len") * F.col("n")
    hit = runs.where((F.col("run") * 2 >= F.col("total")) & (before * 2 < F.col("total")))
    need = F.when(F.col("len") > 0, F.ceil((F.col("total") / 2.0 - before) / F.col("len"))).otherwise(1)
    return hit.select(*keys, F.col("len").cast("long").alias("n50"), (F.col("rank") - F.col("n") + F.greatest(need, F.lit(1))).cast("long").alias("l50"))


def assembly_stats(contigs: DataFrame) -> DataFrame:
    """G1: one row of counts and length statistics; no row for no contigs.

    Lengths are counted once; the median, N50 and L50 come from one running sum over the counts.
    """
    by = contigs.groupBy(F.col("length").alias("len")).agg(F.count("*").alias("n"))
    runs = settled(running(by.where("len IS NOT NULL"), [F.desc("len")], {"run": F.col("len") * F.col("n"), "rank": F.col("n")}))
    rows, known = F.sum("n"), F.sum(F.when(F.col("len").isNotNull(), F.col("n")))
    few = (F.coalesce(F.sum(F.when(F.col("len") < x, F.col("n")).otherwise(0)), F.lit(0)).alias(f"lt_{x}") for x in (200, 500, 1000))
    bp = F.sum(F.col("len") * F.col("n"))
    agg = by.agg(rows.alias("n_contigs"), bp.alias("total_bp"), (bp / known).alias("mean_len"), F.max("len").alias("max_len"), F.min("len").alias("min_len"), *few, known.alias("known"))
    total = F.broadcast(agg.select(F.col("total_bp").alias("total"), "known"))  # one row
    x = runs.join(total)
    reaches = lambda place: F.max(F.when(F.col("rank") >= place, F.col("len")))
    middle = x.agg(((reaches(F.floor((F.col("known") + 1) / 2)) + reaches(F.floor(F.col("known") / 2) + 1)) / 2.0).alias("median_len"))
    return agg.join(F.broadcast(middle)).join(F.broadcast(_half(x, []))).drop("known")


def n50_tier(value: Column) -> Column:
    """The quality tier of an N50; a report only."""
    return F.when(value < 1000, "extremely_fragmented").when(value < 2000, "fragmented").when(value < 5000, "good").otherwise("excellent")


def first_duplicates(contigs: DataFrame) -> DataFrame:
    """duplicate_of, the first contig with the same upper-case sequence; empty for the first itself.

    Sequences meet by digest, so no long text is a shuffle key.
    """
    d = contigs.withColumn("digest", F.sha2(F.upper("seq"), 256))
    first = d.groupBy("digest").agg(F.min(F.struct("ord", "contig_id")).alias("first"))
    return d.join(first, "digest").withColumn("duplicate_of", F.when(F.col("contig_id") != F.col("first.contig_id"), F.col("first.contig_id")).otherwise("")).drop("digest", "first")


def sequence_copies(contigs: DataFrame) -> DataFrame:
    """contig_id, sample, length, first (the first contig with the same upper-case sequence) and nearest (the first of those in the contig's own sample)."""
    d = contigs.select("contig_id", "sample", "length", "ord", F.sha2(F.upper("seq"), 256).alias("digest"))
    order = F.min(F.struct("ord", "contig_id"))
    own = d.groupBy("digest", "sample").agg(order.alias("n"))
    first = own.groupBy("digest").agg(F.min("n").alias("f"))
    same = own.join(first, "digest").select("digest", F.col("sample").alias("of"), F.col("f.contig_id").alias("first"), F.col("n.contig_id").alias("nearest"))
    return d.join(same, "digest").where(F.col("sample").eqNullSafe(F.col("of"))).select("contig_id", "sample", "length", "first", "nearest")


def pairs_of_copies(pairs: DataFrame, copies: DataFrame, least: int) -> DataFrame:
    """Pairs (ref_name, query_name, ani, af_ref, af_query) of first contigs as those of each sample's nearest, and those of equal sequences of at least least letters in two samples. copies: sequence_copies()."""
    near = settled(copies.where("contig_id = nearest").select("first", "nearest", "length"))
    side = lambda s: near.select(F.col("first").alias(f"{s}_name"), F.col("nearest").alias(s))
    spread = pairs.join(side("ref"), "ref_name").join(side("query"), "query_name").select("ref", "query", "ani", "af_ref", "af_query")
    whole = (F.lit(100.0).alias(c) for c in ("ani", "af_ref", "af_query"))
    a, b = near.where(F.col("length") >= least), near.select("first", F.col("nearest").alias("query"))
    equal = a.join(b, "first").where("nearest < query").select(F.col("nearest").alias("ref"), "query", *whole)
    return spread.unionByName(equal).toDF("ref_name", "query_name", "ani", "af_ref", "af_query")


def numbered_names(files: DataFrame, name: str = "name", order: str = "file") -> DataFrame:
    """The second and later files of a name get _1, _2 in file order."""
    k = F.row_number().over(Window.partitionBy(name).orderBy(order)) - 1
    return files.withColumn("unique_name", F.when(k == 0, F.col(name)).otherwise(F.concat(name, F.lit("_"), k)))


def containment_pairs(pairs: DataFrame, contigs: DataFrame, min_ani: float = 99.5, min_af: float = 95.0, min_ratio: float = 0.0, cross_sample: bool = True) -> DataFrame:
    """Winner and loser of each redundant pair. The longer contig wins, on a tie the lower id.

    Pairs are filtered on ANI before they meet the lengths (C3); then samples must differ (C4).
    """
    c = contigs.select("contig_id", "length", "sample")
    side = lambda p: c.select(F.col("contig_id").alias(f"{p}_name"), F.col("length").alias(f"len_{p}"), F.col("sample").alias(f"sample_{p}"))
    # neither side's share counts if the larger doesn't
    pairs = pairs.where((F.col("ani") >= min_ani) & (F.greatest("af_query", "af_ref") >= min_af) & (F.col("query_name") != F.col("ref_name")))
    x = pairs.join(side("query"), "query_name").join(side("ref"), "ref_name")
    if cross_sample:
        x = x.where("sample_query <> sample_ref")
    q, r = F.col("len_query"), F.col("len_ref")
    af = F.when(q < r, F.col("af_query")).when(q > r, F.col("af_ref")).otherwise(F.least("af_query", "af_ref"))
    wins = (q > r) | ((q == r) & (F.col("query_name") < F.col("ref_name")))
    x = x.withColumn("af_short", af).where(F.col("af_short") >= min_af)
    if min_ratio > 0:
        x = x.where(F.least(q, r) / F.greatest(q, r) >= min_ratio)
    either = lambda a, b: F.when(wins, F.col(a)).otherwise(F.col(b))
    return x.select(either("query_name", "ref_name").alias("winner"), either("ref_name", "query_name").alias("loser"), either("len_query", "len_ref").alias("len_winner"), either("len_ref", "len_query").alias("len_loser"), "ani", "af_short")


def best_winners(pairs: DataFrame) -> DataFrame:
    """For each loser the winner that is longest, then most alike, then lowest by id."""
    best = pairs.groupBy("loser").agg(F.min(F.struct((-F.col("len_winner")).alias("a"), (-F.col("ani")).alias("b"), "winner", "af_short", "len_loser")).alias("x"))
    return best.select("loser", F.col("x.winner").alias("winner"), (-F.col("x.a")).alias("len_winner"), (-F.col("x.b")).alias("ani"), F.col("x.af_short").alias("af_short"), F.col("x.len_loser").alias("len_loser"))


def final_representatives(best: DataFrame, rounds: int = 64) -> DataFrame:
    """Follows winners by pointer doubling to one that wasn't removed itself; lengths and ids rule cycles out."""
    now = best.select("loser", F.col("winner").alias("final"))
    for _ in range(rounds):
        step = now.select(F.col("loser").alias("final"), F.col("final").alias("further"))
        new = now.join(step, "final", "left").select("loser", F.coalesce("further", "final").alias("final"), F.col("further").isNotNull().alias("moved"))
        new = settled(new)  # lineage would grow with every round
        now = new.drop("moved")
        if not new.where("moved").limit(1).count():
            break
    else:
        raise RuntimeError(f"winners need more than {rounds} doublings: there is a cycle")
    return best.join(now.withColumnRenamed("final", "final_representative"), "loser")


def without(rows: DataFrame, removed: DataFrame, key: str = "contig_id") -> DataFrame:
    """Rows whose key was not removed."""
    return rows.join(removed.select(key).distinct(), key, "left_anti")


def master_table(id_map: DataFrame, steps: list[tuple[str, DataFrame]]) -> DataFrame:
    """The fate of every contig. steps are (name, removed ids with a reason), the first that lists a contig decides."""
    out, fate, reason = id_map, F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, removed in steps:
        once = removed.groupBy("contig_id").agg(F.min("reason").alias(f"reason_{name}"))
        out = out.join(once, "contig_id", "left")
        fate = F.coalesce(fate, F.when(F.col(f"reason_{name}").isNotNull(), F.lit(f"removed_{name}")))
        reason = F.coalesce(reason, F.col(f"reason_{name}"))
    return out.select(*id_map.columns, F.coalesce(fate, F.lit("retained")).alias("final_status"), F.coalesce(reason, F.lit("")).alias("reason"))


def funnel(master: DataFrame) -> DataFrame:
    """Contigs and bp of each status, and their shares."""
    total = master.agg(F.count("*").alias("all_n"), F.sum("length").alias("all_bp"))
    by = master.groupBy("final_status").agg(F.count("*").alias("n"), F.sum("length").alias("bp"))
    return by.join(F.broadcast(total)).select("final_status", "n", "bp", (100.0 * F.col("n") / F.col("all_n")).alias("pct_n"), (100.0 * F.col("bp") / F.col("all_bp")).alias("pct_bp"))
