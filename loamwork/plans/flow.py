"""The whole flow in one call: contigs and coverage to features, features to labels stage by stage under the gate, labels to tables.

Every stage's labels are a table of the run's folder, with the fingerprint of what made
them beside it; a later run of the same folder starts where fingerprints still fit.
"""

from __future__ import annotations

import json
from ast import literal_eval
from collections.abc import Callable
from dataclasses import asdict, dataclass, fields, replace
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamwork.functions import kmers, sequence
from loamwork.functions import vectors as V
from loamwork.operators import assembly, bins, coverage, density, merge, neighbours, quality, refine, split
from loamwork.operators.trials import Votes
from loamwork.plans import runs
from loamwork.plans.search import Gate, tuned_votes
from loamwork.plans.workspace import settled
from loamwork.sources import fasta, sinks

#: Settings that follow length_scale unless they are given.
LENGTHS = ("min_contig_length", "cluster_length", "recruit_length")


@dataclass(frozen=True)
class Settings:
    """Settings of a run; a file or arguments override the defaults."""

    min_contig_length: int = 500
    cluster_length: int = 1000
    recruit_length: int = 500
    length_scale: float = 1.0
    percentile: float = 99.5
    min_cluster: int = 0  # 0: from the number of rows
    min_samples: int = 0
    method: str = "eom"
    epsilon: float = 0.0
    max_cluster: int = 0  # 0: no bound
    min_probability: float = 0.5
    rescue: str = "late"
    rescue_k: int = 15
    rescue_radius: float = 0.6
    rescue_support: int = 3
    rescue_agreement: float = 0.6
    medoid_passes: int = 3
    medoid_distance: float = 1.0
    sub_min_contigs: int = 2000
    sub_min_part_bp: int = 500_000
    prune_z: float = 4.0
    prune_min_bin: int = 30
    prune_max_share: float = 0.2
    merge_separation: float = 1.0
    merge_coverage: float = 2.0
    merge_misfit: float = 0.25
    merge_mixing: float = 0.10
    merge_min_contigs: int = 10
    reassign_votes: int = 5
    consensus_k: int = 15
    consensus_share: float = 0.6
    consensus_passes: int = 3
    recruit_radius: float = 0.5
    bin_contigs: int = 5
    bin_bp: int = 50_000
    bin_n50: int = 1000
    gate: bool = True
    tolerance: float = 0.10
    indexed: bool = False  # neighbours by the index at every size
    tune: bool = False  # votes of the rescue by a search around their settings
    exact_pairs: float = 1e11  # queries x references up to which neighbours are exact, if not indexed


def load_settings(path: str | None = None, **given) -> Settings:
    """Defaults, then a file (JSON, or lines 'name: value' with # comments), then given. Unknown names are errors; length_scale moves lengths that nobody set."""
    found: dict = {}
    if path:
        with open(path, encoding="utf-8") as f:
            text = f.read()
        found = json.loads(text) if text.lstrip().startswith("{") else dict(_line(x) for x in text.splitlines() if x.split("#")[0].strip())
    found |= {k: v for k, v in given.items() if v is not None}
    kinds = {f.name: type(f.default) for f in fields(Settings)}
    if unknown := sorted(set(found) - set(kinds)):
        raise ValueError(f"unknown settings {unknown}")
    s = Settings(**{k: kinds[k](v) for k, v in found.items()})
    return replace(s, **{k: int(getattr(s, k) * s.length_scale) for k in LENGTHS if k not in found})


def _line(text: str) -> tuple[str, object]:
    name, _, value = text.split("#")[0].partition(":")
    value = value.strip()
    try:
        return name.strip(), {"true": True, "false": False}.get(value.lower(), value) if value.lower() in ("true", "false") else literal_eval(value)
    except (ValueError, SyntaxError):
        return name.strip(), value


def features(contigs: DataFrame, depth: DataFrame, s: Settings) -> DataFrame:
    """Rows for clustering from contigs (contig_id string, seq, length) and coverage (contig_id, sample, depth).

    contig_id becomes a number (name keeps the text); u is the unit composition, shape the
    coverage pattern, vec both side by side, pool what is long and covered enough to cluster.
    Repeated sequences and contigs under min_contig_length go.
    """
    c = contigs.where(F.col("length") >= s.min_contig_length).withColumn("ord", F.monotonically_increasing_id())
    c = settled(assembly.first_duplicates(settled(c)).where("duplicate_of = ''").drop("duplicate_of"))
    samples = sorted(r["sample"] for r in depth.select("sample").distinct().collect())  # a name a sample
    values = coverage.matrix(coverage.normalized(depth, s.percentile), samples).withColumnRenamed("vec", "profile")
    x = c.join(kmers.tnf(c).select("contig_id", "features"), "contig_id").join(values, "contig_id", "left")
    none = F.array_repeat(F.lit(0.0), len(samples))
    profile = F.coalesce("profile", none)
    x = x.select(F.col("contig_id").alias("name"), F.col("ord").alias("contig_id"), "length", sequence.gc_share(F.col("seq")).alias("gc"), V.unit(F.col("features")).alias("u"), profile.alias("profile"), F.col("profile").isNotNull().alias("covered"))
    x = x.withColumn("shape", V.shape(V.profile(F.col("profile")))).withColumn("vec", F.concat("u", V.unit(F.col("profile"))))
    return settled(x.withColumn("pool", F.col("covered") & (F.col("length") >= s.cluster_length)).withColumn("eligible", F.col("pool")))


def density_labels(rows: DataFrame, s: Settings) -> DataFrame:
    """01: contig_id, label, prob by density clustering of the pool over its neighbour graph."""
    pool = rows.where("pool").select(F.lit(0).alias("all"), "contig_id", "vec")
    n = pool.count()
    size, samples = density.auto_params(n)
    search = neighbours.knn_indexed if s.indexed or n * n > s.exact_pairs else None
    found = density.cluster(pool, "all", s.min_cluster or size, s.min_samples or samples, s.method, s.epsilon, s.max_cluster, search=search)
    return found.select("contig_id", F.col("part").cast("int").alias("label"), "prob")


def searches(s: Settings) -> Callable[..., DataFrame]:
    """What finds neighbours at the run's size."""
    return neighbours.knn_indexed if s.indexed else neighbours.knn_by_size(s.exact_pairs)


def metrics(rows: DataFrame, search: Callable[..., DataFrame] = neighbours.knn) -> dict:
    """Q1: what the gate compares."""
    pool = rows.where("pool")
    out: dict = {}
    for table in (quality.indices(pool), quality.neighbour_agreement(pool, search=search), quality.silhouette(pool), bins.shares(pool), bins.size_gini("total_bp", bins.bin_sizes(pool))):
        first = table.first()
        out |= {k: None if v is None else float(v) for k, v in (first.asDict() if first else {}).items()}
    return out


def stages(s: Settings, scored: Callable | None = None) -> list[tuple[str, Callable[[DataFrame], DataFrame] | None, bool]]:
    """(name, what it does to labelled rows, whether the gate may refuse it) in their order; None where a stage is off.

    scored values merged bins by an external tool (marker_merges); without it that stage is off.
    """
    search = searches(s)
    limits = merge.Limits(separation=s.merge_separation, coverage=s.merge_coverage, misfit=s.merge_misfit, mixing=s.merge_mixing, reciprocal=True)
    pieces = split.PieceRules(min_contigs=s.sub_min_contigs, min_part_bp=s.sub_min_part_bp, limits=limits)

    def relabelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
        return rows.drop("label").join(labels.select("contig_id", F.col("label").cast("int").alias("label")), "contig_id")

    def rescue(rows: DataFrame) -> DataFrame:
        kept, pool = rows.where("NOT pool OR pruned"), rows.where("pool AND NOT pruned")
        v = Votes(s.rescue_k, s.rescue_radius, s.rescue_support, s.rescue_agreement)
        if s.tune:
            v, _ = tuned_votes(pool, v, s.min_probability, search, quality.Tolerance(relative=s.tolerance))
        return refine.rescue_by_votes(pool, v.k, v.radius, v.support, v.agreement, s.min_probability, search).unionByName(kept)

    def cut(rows: DataFrame) -> DataFrame:
        proposed = split.subcluster(rows, pieces, search).withColumnRenamed("label", "cut")
        return relabelled(rows, split.split_labels(rows.join(proposed, "contig_id")))

    def prune(rows: DataFrame) -> DataFrame:
        return refine.prune_outliers(rows.drop("pruned"), s.prune_z, s.prune_min_bin, s.prune_max_share).drop("was")

    def marked(rows: DataFrame) -> DataFrame:
        _, refused = merge.merge_bins(rows.where("pool AND label >= 0"), replace(limits, gc_difference=0.05))
        names = merge.marker_merges(merge.marker_candidates(refused), scored)
        to = F.create_map(*(F.lit(x) for kv in names.items() for x in kv)) if names else F.create_map().cast("map<int,int>")
        return rows.withColumn("label", F.coalesce(to[F.col("label")].cast("int"), "label"))

    return [
        ("02_probability_filtered", lambda r: bins.probability_filter(r, s.min_probability), True),
        ("03_after_rescue", rescue if s.rescue == "early" else None, True),
        ("04_after_refinement", (lambda r: refine.medoid_refinement(r, s.medoid_distance, s.medoid_passes)) if s.medoid_passes else None, True),
        ("04b_after_subcluster", cut, True),
        ("04c_after_prune", prune, True),
        ("04d_after_binmerge", lambda r: merge.merge_same_genome(r, limits, s.merge_min_contigs), True),
        ("04d1_after_marker_merge", marked if scored else None, True),
        ("04d2_after_reassign", lambda r: refine.reassign_pruned(r, s.consensus_k, s.reassign_votes, s.prune_z, search), True),
        ("04d3_after_tnf_consensus", lambda r: refine.consensus_reassign(r, s.consensus_k, s.consensus_share, s.prune_z, s.consensus_passes, search), True),
        ("04d4_after_late_rescue", rescue if s.rescue == "late" else None, True),
        ("04e_after_recruit", lambda r: refine.recruit_short(r, s.recruit_length, s.cluster_length, s.rescue_k, s.recruit_radius, s.rescue_support, s.rescue_agreement, search), True),
        ("05_after_bin_filter", lambda r: bins.filter_bins(r, s.bin_contigs, s.bin_bp, s.bin_n50).drop("reason"), False),
    ]


class Folder:
    """Stage tables of a run with their fingerprints and what the gate logged, in any file system that Spark writes to."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.reused = spark, path.rstrip("/"), []

    def note(self, name: str) -> dict | None:
        """What was written beside a table."""
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}.print")
        if not place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place):
            return None
        first = self.spark.read.text(place.toString()).first()
        return json.loads(first[0]) if first else None

    def write_note(self, name: str, note: dict) -> None:
        self.spark.createDataFrame([(json.dumps(note, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/{name}.print")

    def table(self, name: str, mark: str, make: Callable[[], DataFrame], log: list[dict] | None = None) -> DataFrame:
        """The stage's table: as it is if its fingerprint is mark, else made anew; the fingerprint is written last.

        What make adds to log is kept with the table and comes back when the table is reused.
        """
        known, log = self.note(name), [] if log is None else log
        if known and known.get("mark") == mark:
            self.reused.append(name)
            log += known["log"]
        else:
            before = len(log)
            make().write.mode("overwrite").parquet(f"{self.path}/{name}")
            self.write_note(name, {"mark": mark, "log": log[before:]})
        return self.spark.read.parquet(f"{self.path}/{name}")


def cluster(rows: DataFrame, s: Settings, out: str, raw: Callable[[DataFrame, Settings], DataFrame] = density_labels, scored: Callable | None = None, mark: str = "") -> tuple[DataFrame, list[dict]]:
    """All clustering stages on features: (rows with their final label, the gate's log). raw gives the first labels and probabilities."""
    folder = Folder(rows.sparkSession, f"{out}/stages")
    mark = runs.fingerprint(mark, asdict(s), getattr(scored, "version", getattr(scored, "__qualname__", None)))
    gate = Gate(partial(metrics, search=searches(s)), enabled=s.gate)
    tolerance = quality.Tolerance(relative=s.tolerance)
    base = rows.drop("label", "prob", "pruned")
    now = folder.table("01_raw", mark, lambda: base.join(raw(base, s), "contig_id", "left").withColumn("label", F.coalesce("label", F.lit(-1))).withColumn("prob", F.coalesce("prob", F.lit(0.0))).withColumn("pruned", F.lit(False)))
    columns = now.columns
    for name, stage, gated in stages(s, scored):
        mark = runs.fingerprint(mark, name)
        if stage is None:
            continue

        def made(before=now, name=name, stage=stage, gated=gated) -> DataFrame:
            return gate.step(name, before, lambda r: settled(stage(r).select(*columns)), gated, tolerance).select(*columns)

        now = folder.table(name, mark, made, gate.log)
    return now, gate.log


def run(spark: SparkSession, contigs_path: str, coverage_path: str, out: str, settings: Settings = Settings(), scored: Callable | None = None) -> dict:
    """The whole flow: reads a FASTA and a coverage TSV (contig_id, sample, depth), clusters, and writes assignments, summary, unclustered contigs, bins as FASTA, the gate's log and provenance below out."""
    contigs = fasta.read_fasta(spark, contigs_path, upper=True)
    if fasta.repeated_ids(contigs).limit(1).count():
        raise ValueError(f"{contigs_path} repeats contig ids")
    depth = spark.read.schema("contig_id string, sample string, depth double").option("sep", "\t").option("header", True).csv(coverage_path)
    bad = {k: v for k, v in coverage.violations(depth).first().asDict().items() if v}
    if bad:
        raise ValueError(f"{coverage_path} can't be used: {bad}")
    read = {"contigs": runs.content(contigs, "contig_id"), "coverage": runs.content(depth, "contig_id")}
    folder, mark = Folder(spark, f"{out}/stages"), runs.fingerprint(read, asdict(settings))
    changes = runs.changed_parts(folder.note("inputs") or {}, read)
    rows = folder.table("00_features", mark, lambda: features(contigs, depth, settings))
    folder.write_note("inputs", read)
    final, log = cluster(rows, settings, out, scored=scored, mark=mark)
    named = final.withColumn("contig_id", F.col("name")).select("contig_id", "label", "length")
    sinks.write_outputs(named, f"{out}/tables")
    sinks.write_bins(named.where("label >= 0"), contigs, f"{out}/bins")
    compared = runs.comparison({"run": named}).first()  # no row where nothing is in a bin
    about = {"settings": asdict(settings), "gate": log, "changed_inputs": changes} | runs.provenance(spark, asdict(settings)) | (compared.asDict() if compared else {"run": "run", "n_bins": 0})
    spark.createDataFrame([(json.dumps(about, sort_keys=True, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(f"{out}/report")
    return about
