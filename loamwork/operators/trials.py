"""Many settings of the vote stage tried in one plan, over neighbours that are found once."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamwork.operators import quality
from loamwork.operators.neighbours import knn
from loamwork.plans.workspace import settled


@dataclass(frozen=True)
class Votes:
    """Settings of rescue_by_votes that a search may change."""

    k: int
    radius: float
    support: int
    agreement: float


def vote_neighbours(rows: DataFrame, k: int, ref_prob: float, search: Callable[..., DataFrame] = knn) -> DataFrame:
    """contig_id and near, an array of (rank, distance, vote), of every noise row; written, so that all rounds share it."""
    refs = rows.where((F.col("label") >= 0) & (F.col("prob") >= ref_prob)).select("contig_id", "label", F.col("u").alias("vec"))
    found = search(rows.where("label < 0").select("contig_id", F.col("u").alias("vec")), refs.drop("label"), k)
    voted = found.join(refs.select(F.col("contig_id").alias("ref_id"), F.col("label").alias("vote")), "ref_id")
    return settled(voted.groupBy(F.col("query_id").alias("contig_id")).agg(F.collect_list(F.struct("rank", "distance", "vote")).alias("near")))  # k a row


def _winner(v: Votes) -> Column:
    """The label that near gives under these settings, the lowest of equals, or null."""
    votes = F.transform(F.filter("near", lambda x: (x["rank"] <= v.k) & (x["distance"] <= v.radius)), lambda x: x["vote"])
    counted = F.transform(F.array_distinct(votes), lambda label: F.struct((-F.size(F.filter(votes, lambda x: x == label))).alias("less"), label.alias("label")))
    best = F.array_min(counted)
    agree = -best["less"]
    return F.when((F.size(votes) >= v.support) & (agree >= v.support) & (agree >= v.agreement * F.size(votes)), best["label"])


def vote_moves(near: DataFrame, candidates: list[Votes]) -> DataFrame:
    """contig_id, label, candidates: the noise rows that move, with the numbers of the candidates that move them there."""
    moved = near.select("contig_id", F.explode(F.array(*(F.struct(F.lit(i).alias("candidate"), _winner(v).alias("label")) for i, v in enumerate(candidates)))).alias("m")).where("m.label IS NOT NULL")
    return moved.groupBy("contig_id", "m.label").agg(F.sort_array(F.collect_list("m.candidate")).alias("candidates"))  # a number a candidate


def vote_trials(rows: DataFrame, near: DataFrame, candidates: list[Votes], tolerance: quality.Tolerance = quality.Tolerance()) -> DataFrame:
    """Q7: a row a candidate: candidate, n_moved, first (the lowest candidate with the same labels), n_clusters, calinski_harabasz, assigned_bp_pct, passed, score.

    rows: contig_id, label, length, u. Sums of what is labelled already are made once; rows that the
    same candidates move to the same bin are summed before they are dealt to candidates, so work
    follows the rows, not rows x candidates. The judge compares each candidate with no move.
    """
    every = F.array(*(F.lit(i) for i in range(-1, len(candidates))))  # -1: no move
    slim = rows.select("contig_id", "u", F.col("length").cast("double").alias("length"))
    moves = settled(vote_moves(near, candidates).join(slim, "contig_id"))
    known = rows.where("label >= 0").select("contig_id", "label", every.alias("candidates"), "u", F.col("length").cast("double").alias("length"))
    both = known.unionByName(moves.select(*known.columns))
    square = F.aggregate("u", F.lit(0.0), lambda s, x: s + x * x)
    to = [F.explode("candidates").alias("candidate"), "label"]
    sizes = both.groupBy("label", "candidates").agg(F.count("*").alias("n"), F.sum("length").alias("bp"), F.sum(square).alias("sq")).select(*to, "n", "bp", "sq")
    sizes = sizes.groupBy("candidate", "label").agg(*(F.sum(c).alias(c) for c in ("n", "bp", "sq")))
    places = both.select("label", "candidates", F.posexplode("u").alias("pos", "x")).groupBy("label", "candidates", "pos").agg(F.sum("x").alias("x")).select(*to, "pos", "x")
    places = settled(places.groupBy("candidate", "label", "pos").agg(F.sum("x").alias("x")))
    heavy = places.groupBy("candidate", "label").agg(F.sum(F.col("x") * F.col("x")).alias("norm"))
    whole = places.groupBy("candidate", "pos").agg(F.sum("x").alias("x")).groupBy("candidate").agg(F.sum(F.col("x") * F.col("x")).alias("whole"))
    by = sizes.join(heavy, ["candidate", "label"]).groupBy("candidate").agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum("bp").alias("bp"), F.sum("sq").alias("sq"), F.sum(F.col("norm") / F.col("n")).alias("inner"))
    between, within = F.col("inner") - F.col("whole") / F.col("n"), F.col("sq") - F.col("inner")
    index = F.try_divide(between * (F.col("n") - F.col("k")), within * (F.col("k") - 1))
    total = rows.agg(F.sum(F.col("length").cast("double")).alias("all_bp"))
    x = by.join(whole, "candidate").join(F.broadcast(total)).select("candidate", F.col("k").alias("n_clusters"), index.alias("calinski_harabasz"), (100.0 * F.col("bp") / F.col("all_bp")).alias("assigned_bp_pct"))
    digest = moves.groupBy("candidates").agg(F.count("*").alias("n_moved"), F.sum(F.xxhash64("contig_id", "label").cast("decimal(38,0)")).alias("h")).select(F.explode("candidates").alias("candidate"), "n_moved", "h")
    digest = digest.groupBy("candidate").agg(F.sum("n_moved").alias("n_moved"), F.sum("h").alias("h"))
    x = x.join(digest, "candidate", "left").fillna(0, ["n_moved"])
    metrics = F.create_map(*(y for c in ("n_clusters", "calinski_harabasz", "assigned_bp_pct") for y in (F.lit(c), F.col(c).cast("double"))))
    x = settled(x.withColumn("metrics", metrics))  # a row a candidate
    before = x.where("candidate = -1").select(F.col("metrics").alias("before"))
    pairs = x.where("candidate >= 0").withColumnRenamed("metrics", "after").join(F.broadcast(before))
    same = x.where("candidate >= 0").groupBy("n_moved", "h").agg(F.min("candidate").alias("first"))
    judged = quality.judged(pairs, tolerance)
    out = judged.join(F.broadcast(same), judged["n_moved"].eqNullSafe(same["n_moved"]) & judged["h"].eqNullSafe(same["h"])).drop(same["n_moved"])
    return out.select("candidate", "n_moved", "first", "n_clusters", "calinski_harabasz", "assigned_bp_pct", "passed", "score")
