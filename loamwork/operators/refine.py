"""Refinement stages: a table with labels goes in, a table with labels comes out.

Votes always use the labels from before the stage. Labels of -1 are noise.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamwork.functions import vectors as V
from loamwork.operators import groups
from loamwork.operators.neighbours import knn, votes
from loamwork.plans.workspace import settled

#: What finds neighbours: knn (exact, all blocks meet) or knn_indexed (for large tables).
Search = Callable[..., DataFrame]


def _relabelled(rows: DataFrame, moves: DataFrame) -> DataFrame:
    """rows with the labels of moves (contig_id, new_label)."""
    return rows.join(moves, "contig_id", "left").withColumn("label", F.coalesce("new_label", "label")).drop("new_label")


def _vec(rows: DataFrame, column: str = "u") -> DataFrame:
    return rows.select("contig_id", F.col(column).alias("vec"))


def rescue_by_votes(rows: DataFrame, k: int, radius: float, min_support: int, agreement: float, ref_prob: float, search: Search = knn) -> DataFrame:
    """K4: noise takes the majority label of its trusted neighbours within a radius."""
    refs = rows.where((F.col("label") >= 0) & (F.col("prob") >= ref_prob))
    near = search(_vec(rows.where("label < 0")), _vec(refs), k).where(F.col("distance") <= radius)
    v = votes(near, refs).where((F.col("support") >= min_support) & (F.col("agree") >= min_support) & (F.col("agree") >= agreement * F.col("support")))
    return _relabelled(rows, v.select(F.col("query_id").alias("contig_id"), F.col("winner").alias("new_label")))


def rescue_by_centroid(rows: DataFrame, max_distance: float, margin: float, k: int, radius: float, min_support: int, agreement: float, ref_prob: float, search: Search = knn) -> DataFrame:
    """K3: noise takes the nearest centroid's label if it is near, clearly nearest, and local neighbours agree."""
    refs = rows.where((F.col("label") >= 0) & (F.col("prob") >= ref_prob))
    c = groups.means(refs, "label", "u").select(F.col("label").alias("bin"), V.unit(F.col("mean")).alias("centroid"))
    noise = rows.where("label < 0")
    d = noise.select("contig_id", "u").join(F.broadcast(c)).select("contig_id", "bin", V.distance(F.col("u"), F.col("centroid")).alias("d"))  # bins are few
    order = Window.partitionBy("contig_id").orderBy("d", "bin")
    first = d.withColumn("k", F.row_number().over(order)).withColumn("next", F.lead("d").over(order)).where("k = 1")
    first = first.where((F.col("d") <= max_distance) & (F.col("next").isNull() | (F.col("next") - F.col("d") >= margin)))
    near = search(_vec(noise), _vec(refs), k).where(F.col("distance") <= radius).join(refs.select(F.col("contig_id").alias("ref_id"), F.col("label").alias("vote")), "ref_id")
    local = near.join(first.select(F.col("contig_id").alias("query_id"), "bin"), "query_id").groupBy("query_id", "bin").agg(F.count("*").alias("support"), F.sum((F.col("vote") == F.col("bin")).cast("long")).alias("agree"))
    ok = local.where((F.col("support") >= min_support) & (F.col("agree") >= min_support) & (F.col("agree") >= agreement * F.col("support")))
    return _relabelled(rows, ok.select(F.col("query_id").alias("contig_id"), F.col("bin").alias("new_label")))


def medoid_pass(rows: DataFrame, max_distance: float) -> DataFrame:
    """K5, one pass: rows move to the nearest medoid, the member nearest to its bin's plain mean."""
    binned = rows.where("label >= 0")
    m = groups.means(binned, "label", "u")
    far = binned.join(F.broadcast(m), "label").select("label", "contig_id", "u", V.distance(F.col("u"), F.col("mean")).alias("d"))
    medoids = far.groupBy("label").agg(F.min(F.struct("d", "contig_id", "u")).alias("m")).select(F.col("label").alias("bin"), F.col("m.u").alias("medoid"))
    d = binned.select("contig_id", "label", "u").join(F.broadcast(medoids)).select("contig_id", "label", F.struct(V.distance(F.col("u"), F.col("medoid")).alias("d"), "bin").alias("x"))  # bins are few
    best = d.groupBy("contig_id", "label").agg(F.min("x").alias("x")).where((F.col("x.bin") != F.col("label")) & (F.col("x.d") <= max_distance))
    return _relabelled(rows, best.select("contig_id", F.col("x.bin").alias("new_label")))


def medoid_refinement(rows: DataFrame, max_distance: float, passes: int, converged: float = 0.01) -> DataFrame:
    """K5: passes until fewer than a share of converged rows move; each pass is written out, so lineage stays short."""
    for _ in range(passes):
        new = settled(medoid_pass(rows, max_distance))
        moved = new.join(rows.select("contig_id", F.col("label").alias("old")), "contig_id").agg(F.avg((F.col("label") != F.col("old")).cast("double")).alias("m")).first()["m"]
        rows = new
        if (moved or 0) < converged:
            break
    return rows


def recruit_short(rows: DataFrame, min_length: int, cluster_length: int, k: int, radius: float, min_support: int, agreement: float, search: Search = knn) -> DataFrame:
    """K6: short unlabelled rows take the label of their near neighbours if these agree."""
    short = rows.where((F.col("label") < 0) & (F.col("length") >= min_length) & (F.col("length") < cluster_length))
    refs = rows.where((F.col("label") >= 0) & (F.col("length") >= cluster_length))
    near = search(_vec(short), _vec(refs), k).where(F.col("distance") <= radius)
    v = votes(near, refs).where((F.col("support") >= min_support) & (F.col("agree") >= agreement * F.col("support")))
    return _relabelled(rows, v.select(F.col("query_id").alias("contig_id"), F.col("winner").alias("new_label")))


def consensus_pass(rows: DataFrame, neighbours: DataFrame, k: int, share: float, max_z: float) -> DataFrame:
    """K7, one pass: a row moves to the bin that holds at least a share of its k neighbours and whose coverage shape it fits."""
    binned = rows.where("label >= 0")
    v = votes(neighbours, binned).where(F.col("agree") >= share * k)
    x = binned.join(v, binned.contig_id == v.query_id).where(F.col("winner") != F.col("label"))
    models = groups.shape_models(binned).withColumnRenamed("label", "winner")
    fit = x.join(F.broadcast(models), "winner").where(V.shape_z(F.col("shape"), F.col("median"), F.col("sd")) <= max_z)
    return _relabelled(rows, fit.select("contig_id", F.col("winner").alias("new_label")))


def consensus_reassign(rows: DataFrame, k: int, share: float, max_z: float, passes: int, search: Search = knn) -> DataFrame:
    """K7: passes over neighbours that are found once; ends when nothing moves."""
    near = settled(search(_vec(rows.where("label >= 0")), _vec(rows.where("label >= 0")), k))
    for _ in range(passes):
        new = settled(consensus_pass(rows, near, k, share, max_z))
        same = not new.join(rows.select("contig_id", F.col("label").alias("old")), "contig_id").where("label <> old").limit(1).count()
        rows = new
        if same:
            break
    return rows


def prune_outliers(rows: DataFrame, limit: float, min_bin: int, max_share: float) -> DataFrame:
    """K8: rows with pruned: those beyond the limit, in bins that are large and would lose at most a share of their bp."""
    binned = rows.where("label >= 0")
    z = groups.shape_scores(binned, groups.shape_models(binned)).withColumn("flag", F.col("z") > limit)
    lost = F.sum(F.when(F.col("flag"), F.col("length")).otherwise(0)) / F.greatest(F.sum("length"), F.lit(1))
    allowed = z.groupBy("label").agg(F.count("*").alias("n"), lost.alias("lost")).where((F.col("n") >= min_bin) & (F.col("lost") <= max_share)).select("label")
    pruned = z.where("flag").join(F.broadcast(allowed), "label").select("contig_id", F.lit(True).alias("pruned"))
    x = rows.join(pruned, "contig_id", "left").withColumn("pruned", F.coalesce("pruned", F.lit(False)))
    return x.withColumn("was", F.col("label")).withColumn("label", F.when(F.col("pruned"), -1).otherwise(F.col("label")))


def reassign_pruned(rows: DataFrame, k: int, min_votes: int, max_z: float, search: Search = knn) -> DataFrame:
    """K9: pruned rows go to the best-fitting of the bins that hold enough of their neighbours."""
    refs = rows.where("label >= 0")
    near = search(_vec(rows.where("pruned")), _vec(refs), k).join(refs.select(F.col("contig_id").alias("ref_id"), F.col("label").alias("bin")), "ref_id")
    options = near.groupBy("query_id", "bin").agg(F.count("*").alias("n")).where(F.col("n") >= min_votes)
    x = options.join(rows.select(F.col("contig_id").alias("query_id"), "shape"), "query_id").join(F.broadcast(groups.shape_models(refs).withColumnRenamed("label", "bin")), "bin")
    best = x.groupBy("query_id").agg(F.min(F.struct(V.shape_z(F.col("shape"), F.col("median"), F.col("sd")).alias("z"), "bin")).alias("b")).where(F.col("b.z") <= max_z)
    return _relabelled(rows, best.select(F.col("query_id").alias("contig_id"), F.col("b.bin").alias("new_label")))


def neighbour_jaccard(a: DataFrame, b: DataFrame, k: int, search: Search = knn) -> DataFrame:
    """U4: contig_id, jaccard of its k neighbours in two spaces."""
    sets = lambda x, n: search(x, x, k).groupBy("query_id").agg(F.collect_set("ref_id").alias(n))
    return sets(a, "sa").join(sets(b, "sb"), "query_id").select(F.col("query_id").alias("contig_id"), V.jaccard(F.col("sa"), F.col("sb")).alias("jaccard"))


def te_usefulness(rows: DataFrame, jaccards: DataFrame, min_weight: float = 0.3, min_agreement: float = 0.10) -> DataFrame:
    """Label, use_te, reason of each bin: repeat features help where weights are there and neighbourhoods agree."""
    x = rows.where("label >= 0").join(jaccards, "contig_id", "left").groupBy("label").agg(F.avg((F.col("te_weight") == 0).cast("double")).alias("zero"), F.median("te_weight").alias("weight"), F.avg("jaccard").alias("agreement"))
    reason = F.when(F.col("zero") >= 0.5, "te_weight_zero").when(F.col("weight") < min_weight, "low_te_weight").when(F.coalesce(F.col("agreement") < min_agreement, F.lit(False)), "low_agreement").otherwise("useful")
    return x.select("label", (reason == "useful").alias("use_te"), reason.alias("reason"))


def mixing(rows: DataFrame, a: int, b: int, k: int) -> DataFrame:
    """The observed over the expected share of neighbours in b among those of a's rows."""
    both = rows.where(F.col("label").isin(a, b))
    near = knn(_vec(rows.where(F.col("label") == a)), _vec(both), k).join(both.select(F.col("contig_id").alias("ref_id"), "label"), "ref_id")
    n = both.agg(F.sum((F.col("label") == b).cast("long")).alias("nb"), F.count("*").alias("n"))
    return near.agg(F.avg((F.col("label") == b).cast("double")).alias("observed")).join(n).select((F.col("observed") / (F.col("nb") / (F.col("n") - 1))).alias("mixing"))
