"""Quality of a clustering: indices, neighbour agreement, and the gate's rules."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamwork.functions import vectors as V
from loamwork.operators import groups, sampling
from loamwork.operators.neighbours import knn
from loamwork.plans.workspace import settled

# Which way a metric improves, and whether its change counts relatively or in percentage points.
METRICS = {"calinski_harabasz": (1, "rel"), "davies_bouldin": (-1, "rel"), "silhouette": (1, "rel"), "silhouette_macro": (1, "rel"), "knn_agree@10": (1, "pp"), "knn_agree@30": (1, "pp"), "knn_agree@50": (1, "pp")}
FAIL_METRICS = ("calinski_harabasz", "knn_agree@10", "knn_agree@30", "knn_agree@50")
EPS = 1e-9


def indices(rows: DataFrame) -> DataFrame:
    """Q1: Calinski-Harabasz and Davies-Bouldin of labelled unit vectors, from sums by bin."""
    x = rows.where("label >= 0").select("label", "u")
    centre = groups.means(x.withColumn("all", F.lit(0)), "all", "u").select(F.col("mean").alias("centre"))
    m = groups.means(x, "label", "u")
    d = x.join(F.broadcast(m), "label").groupBy("label").agg(F.count("*").alias("n"), F.avg(V.distance(F.col("u"), F.col("mean"))).alias("spread"), F.sum(F.pow(V.distance(F.col("u"), F.col("mean")), F.lit(2))).alias("within"))
    g = m.join(d, "label").join(F.broadcast(centre))
    s = g.agg(F.sum(F.col("n") * F.pow(V.distance(F.col("mean"), F.col("centre")), F.lit(2))).alias("between"), F.sum("within").alias("within"), F.sum("n").alias("n"), F.count("*").alias("k"))
    ch = F.col("between") * (F.col("n") - F.col("k")) / (F.col("within") * (F.col("k") - 1))
    a, b = (g.select(F.col("label").alias(f"l{i}"), F.col("mean").alias(f"m{i}"), F.col("spread").alias(f"s{i}")) for i in "ab")
    worst = a.join(F.broadcast(b), F.col("la") != F.col("lb")).groupBy("la").agg(F.max((F.col("sa") + F.col("sb")) / V.distance(F.col("ma"), F.col("mb"))).alias("w"))
    return s.select(F.col("k").alias("n_clusters"), ch.alias("calinski_harabasz")).join(worst.agg(F.avg("w").alias("davies_bouldin")))


#: Fixed value: rows that silhouettes look at.
SILHOUETTE_ROWS = 10_000


def silhouettes(rows: DataFrame, sample: int = SILHOUETTE_ROWS) -> DataFrame:
    """Q1: contig_id, label, s of a sample of labelled rows: each row's silhouette within the sample.

    The sample is bounded, so it is broadcast; each row's distances to it are summed by bin in one pass.
    """
    some = sampling.hash_sample(rows.where("label >= 0").select("contig_id", "label", "u"), sample)
    known = some.orderBy("contig_id").toArrow()
    names, own = np.unique(known.column("label").to_numpy(), return_inverse=True) if known.num_rows else (np.zeros(0), np.zeros(0, int))
    shared = rows.sparkSession.sparkContext.broadcast((np.array(known.column("u").to_pylist(), np.float64).reshape(known.num_rows, -1 if known.num_rows else 1), own, len(names), known.column("contig_id").to_numpy(), known.column("label").to_numpy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, bins, k, ids, labels = shared.value
        size = np.bincount(bins, minlength=k)
        for b in batches:
            for at in b.column(0).to_pylist():
                part = slice(at * 512, (at + 1) * 512)
                d = np.sqrt(np.maximum((x[part] ** 2).sum(1)[:, None] + (x**2).sum(1)[None] - 2 * x[part] @ x.T, 0))
                d[np.arange(len(d)), np.arange(at * 512, at * 512 + len(d))] = 0
                total = np.stack([np.bincount(bins, row, k) for row in d]) if len(d) else np.zeros((0, k))
                mine = bins[part]
                here = np.arange(len(d))
                a = total[here, mine] / np.maximum(size[mine] - 1, 1)
                other = total / np.maximum(size, 1)
                other[here, mine] = np.inf
                near = np.where(np.isnan(other), np.inf, other).min(1, initial=np.inf)
                s = np.where((size[mine] > 1) & np.isfinite(near), (near - a) / np.maximum(np.maximum(a, near), 1e-300), 0.0)
                yield pa.RecordBatch.from_pydict({"contig_id": ids[part], "label": labels[part].astype(np.int32), "s": s})

    blocks = -(-known.num_rows // 512)
    return rows.sparkSession.range(0, blocks, 1, max(1, blocks)).mapInArrow(run, "contig_id long, label int, s double")


def silhouette(rows: DataFrame, sample: int = SILHOUETTE_ROWS) -> DataFrame:
    """Q1, Q2: the mean silhouette, and its mean over bins."""
    by = silhouettes(rows, sample).groupBy("label").agg(F.sum("s").alias("t"), F.count("*").alias("n"))
    return by.agg((F.sum("t") / F.sum("n")).alias("silhouette"), F.avg(F.col("t") / F.col("n")).alias("silhouette_macro"))


def silhouette_reasons(rows: DataFrame, sample: int = SILHOUETTE_ROWS) -> DataFrame:
    """Q2: one row with silhouette (null where it isn't defined) and why."""
    n = rows.where("label >= 0").agg(F.count("*").alias("n"), F.count_distinct("label").alias("bins"))
    why = F.when(F.col("bins") == 0, "no labelled rows").when(F.col("bins") == 1, "a single bin").when(F.col("n") <= F.col("bins"), "every bin has one row").otherwise("")
    return n.join(silhouette(rows, sample)).select(F.when(why == "", F.col("silhouette")).alias("silhouette"), why.alias("reason"))


def neighbour_agreement(rows: DataFrame, ks: tuple[int, ...] = (10, 30, 50), search: Callable[..., DataFrame] = knn) -> DataFrame:
    """Q1: the mean share of k neighbours with a row's own label, for each k; neighbours are found once.

    All labelled rows are asked, and all of them are references; search finds the neighbours.
    """
    x = settled(rows.where("label >= 0").select("contig_id", "label", F.col("u").alias("vec")))
    near = search(x, x, max(ks)).join(x.select(F.col("contig_id").alias("ref_id"), F.col("label").alias("theirs")), "ref_id").join(x.select(F.col("contig_id").alias("query_id"), "label"), "query_id")
    same = (F.col("theirs") == F.col("label")).cast("double")
    by = near.groupBy("query_id").agg(*(F.avg(F.when(F.col("rank") <= k, same)).alias(f"a{k}") for k in ks))
    return by.agg(*(F.avg(f"a{k}").alias(f"knn_agree@{k}") for k in ks))


def _finite(values: str, metric: str) -> Column:
    """A metric of a map column; null where it is missing, NaN or infinite."""
    v = F.col(values)[metric]
    return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)


def _change(metric: str, relative: bool = False) -> Column:
    """Q3: the signed change of a metric, more than 0 is better; agreements change in points unless relative."""
    way, kind = METRICS[metric]
    before, after = _finite("before", metric), _finite("after", metric)
    return after - before if kind == "pp" and not relative else way * (after - before) / F.greatest(F.abs(before), F.lit(1e-9))


def changes(candidates: DataFrame) -> DataFrame:
    """Candidates (before, after: maps of metrics) with changes, a map of the metrics that both have."""
    return candidates.withColumn("changes", F.map_filter(F.create_map(*(x for m in METRICS for x in (F.lit(m), _change(m)))), lambda k, v: v.isNotNull()))


@dataclass(frozen=True)
class Tolerance:
    """What a candidate may lose; None switches a rule off."""

    relative: float = 0.10
    points: float = 3.0
    bp_points: float = 2.0
    bins: float | None = 0.30
    bp_weight: float = 0.5
    collective: bool = False
    fail: tuple[str, ...] = FAIL_METRICS


def _rules(t: Tolerance, collective: Column, gain: Column) -> dict[str, Column]:
    """Each rule's name and when it is broken; null counts as kept."""
    least = {"rel": -t.relative - EPS, "pp": -t.points / 100 - EPS}
    rules = {m: _finite("before", m).isNotNull() & F.coalesce(_change(m) < least[kind], F.lit(True)) for m, (_, kind) in METRICS.items() if m in t.fail}
    if t.collective:
        rules["collective"] = collective < -t.relative / 2 - EPS
    rules["assigned_bp"] = _finite("after", "assigned_bp_pct").isNotNull() & (gain < -t.bp_points - EPS)
    if t.bins is not None:
        was, now = (F.coalesce(F.col(c)["n_clusters"], F.lit(0.0)) for c in ("before", "after"))
        rules["bin_collapse"] = (was >= 5) & (now < (1 - t.bins) * was - EPS)
    return rules


def _gain() -> Column:
    return F.coalesce(F.col("after")["assigned_bp_pct"], F.lit(0.0)) - F.coalesce(F.col("before")["assigned_bp_pct"], F.lit(0.0))


def judged(candidates: DataFrame, t: Tolerance = Tolerance()) -> DataFrame:
    """Q4: candidates (before, after: maps of metrics) with passed, score, collective, worst and reasons.

    All metrics that both maps have enter the score; the rules that are broken are the
    reasons. Where metrics were and none is left, the clustering has collapsed.
    """
    x = changes(candidates)
    terms = F.filter(F.array(*(_change(m) if METRICS[m][1] == "rel" else _change(m, relative=True) for m in METRICS)), lambda v: v.isNotNull())
    x = x.withColumn("known", F.size("changes") > 0).withColumn("had", F.coalesce(*(_finite("before", m) for m in METRICS)).isNotNull())
    collective, gain = V.mean(terms), _gain()
    broken = F.filter(F.array(*(F.when(F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in _rules(t, collective, gain).items())), lambda v: v.isNotNull())
    lost = F.col("had") & ~F.col("known")
    # fixed values: what a collapse and nothing to compare are worth
    pick = lambda fine, collapse: F.when(F.col("known"), fine).when(lost, F.lit(collapse)).otherwise(F.lit(0.0))
    reasons = F.when(F.col("known"), broken).when(lost, F.array(F.lit("metrics undefined"))).otherwise(F.array().cast("array<string>"))
    out = x.withColumn("reasons", reasons).withColumn("score", pick(collective + t.bp_weight * gain / 100, -1e6)).withColumn("collective", pick(collective, -1.0)).withColumn("worst", pick(F.array_min(F.map_values("changes")), -1.0))
    return out.withColumn("passed", F.size("reasons") == 0).drop("known", "had", "changes")


def judged_splits(candidates: DataFrame) -> DataFrame:
    """Q5: candidates (before, after, weakest: the agreement of the weakest piece) with passed, score and reasons. A split may not lose bins."""
    was, now = (F.coalesce(F.col(c)["n_clusters"], F.lit(0.0)) for c in ("before", "after"))
    gone = now + EPS < was
    reasons = F.when(gone, F.array(F.lit("bins disappeared"))).otherwise(F.array().cast("array<string>"))
    return candidates.withColumn("reasons", reasons).withColumn("score", F.col("weakest") + 0.5 * _gain() / 100).withColumn("passed", ~gone)


@dataclass(frozen=True)
class Verdict:
    """What the gate says of a candidate."""

    passed: bool
    score: float
    reasons: tuple[str, ...] = ()


def judge(spark: SparkSession, before: dict, after: dict, t: Tolerance = Tolerance()) -> Verdict:
    """judged() of one candidate, a row of metrics that is made already."""
    known = lambda d: {k: float(v) for k, v in d.items() if v is not None}
    row = judged(spark.createDataFrame([(known(before), known(after))], "before map<string,double>, after map<string,double>"), t).first()
    return Verdict(row["passed"], row["score"], tuple(row["reasons"]))
