"""Adapters that reshape the driver tables into contigs, coverage, hits, latents and calls.

Each adapter is written once as a DataFrame and once as DuckDB common table expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """contig_id, ord, sample, seq, length from the DNA letters of documents."""
    d = table(spark, sf_dir, "documents")
    seq = F.upper(F.regexp_replace("text", "[^ACGTNacgtn]", ""))
    return d.select(F.concat(F.lit("c"), F.col("doc_id")).alias("contig_id"), F.col("doc_id").alias("ord"), F.col("source").alias("sample"), seq.alias("seq")).withColumn("length", F.length("seq").cast("long"))


CONTIGS = """contigs AS (SELECT 'c' || doc_id AS contig_id, doc_id AS ord, source AS sample, upper(regexp_replace(text, '[^ACGTNacgtn]', '', 'g')) AS seq FROM documents),
c AS (SELECT *, CAST(length(seq) AS BIGINT) AS length FROM contigs)"""


def _bases():
    return F.translate(F.regexp_replace(F.lower("text"), "[^a-z]", ""), "abcdefghijklmnopqrstuvwxyz", "ACGTGCATTACGCGTAATGCCATGCA")


def letter_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """name, seq of the benchmark's texts."""
    return table(spark, sf_dir, "benchmark").select(F.concat(F.lit("b"), F.col("item_id")).alias("name"), _bases().alias("seq"))


def letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """contig_id, ord, sample, seq, length with a base for every letter of documents, so that like texts are like sequences."""
    d, seq = table(spark, sf_dir, "documents"), _bases()
    return d.select(F.concat(F.lit("c"), F.col("doc_id")).alias("contig_id"), F.col("doc_id").alias("ord"), F.col("source").alias("sample"), seq.alias("seq")).withColumn("length", F.length("seq").cast("long"))


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """read_id, sample, seq: windows of 100 letters of F11's contigs, every 40; every third comes from the other strand."""
    return reads_of(letters(spark, sf_dir))


def reads_of(c: DataFrame) -> DataFrame:
    """F12 of contigs that are made already."""
    c = c.where("length >= 100")
    # cut once, so that a window costs its own letters, not all letters before it
    x = c.select("contig_id", "sample", "length", F.split("seq", r"(?<=\G.{40})").alias("c"))
    window = "struct(40L * i AS at, substr(concat(c[i], c[i + 1], c[i + 2]), 1, 100) AS seq)"
    x = x.select("contig_id", "sample", F.explode(F.expr(f"transform(sequence(0, cast((length - 100) div 40 AS int)), i -> {window})")).alias("w")).select("contig_id", "sample", "w.*")
    turned = F.reverse(F.translate("seq", "ACGT", "TGCA"))
    return x.select(F.concat_ws("_", "contig_id", "at").alias("read_id"), "sample", F.when(F.col("at") % 3 == 0, turned).otherwise(F.col("seq")).alias("seq"))


def depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """contig_id, sample, depth, breadth from all lines; what lies over 48 adds depth. Every fifth contig has no coverage: its lines count for the one before it.

    Shares are added in the order of the table's rows: many are just at a filter's limit, where another order ends on its other side.
    """
    rows = table(spark, sf_dir, "lineitem").select("*", F.struct("_metadata.file_name", "_metadata.row_index").alias("place"))
    contig, sample = F.expr("l_partkey - if(l_partkey % 5 = 0, 1, 0)"), F.concat("l_returnflag", "l_linestatus")
    over = F.greatest(F.col("l_quantity") - 48, F.lit(0.0))
    shares = F.array_sort(F.collect_list(F.when(F.col("l_discount").isNotNull(), F.struct("place", "l_discount"))))  # a contig's lines in one sample
    breadth = F.when(F.size(shares) > 0, F.aggregate(shares, F.lit(0.0), lambda t, s: t + s["l_discount"]) / F.size(shares) * 10)
    return rows.groupBy(contig.alias("contig_id"), sample.alias("sample")).agg(F.sum(over).alias("depth"), breadth.alias("breadth"))


def part_contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All contig ids of F2 and F3 with their lengths."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("contig_id"), (F.lit(3800) + 100 * F.col("p_size")).cast("long").alias("length"))


DEPTH = """cov AS (SELECT l_partkey - CASE WHEN l_partkey % 5 = 0 THEN 1 ELSE 0 END AS contig_id, l_returnflag || l_linestatus AS sample, sum(greatest(l_quantity - 48, 0)) AS depth, avg(l_discount) * 10 AS breadth FROM lineitem GROUP BY 1, 2),
ids AS (SELECT p_partkey AS contig_id, CAST(3800 + 100 * p_size AS BIGINT) AS length FROM part)"""


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """repeat hits with 1-based inclusive coordinates, some of them reversed."""
    li = table(spark, sf_dir, "lineitem").withColumn("k", F.pmod(F.col("l_orderkey") + F.col("l_linenumber"), F.lit(10)))
    names = ["a#LTR/Gypsy", "b#DNA/hAT", "c#LINE/L1", "d#Unknown", "e#rRNA", "Copia-6_I", "Mariner_7", "JOCKEY_2", "plainname", "f#SINE?/x"]
    target = F.element_at(F.array(*map(F.lit, names)), (F.col("k") + 1).cast("int"))
    lo = F.col("l_suppkey") * 37 + F.col("l_linenumber") * 5
    hi = lo + F.col("l_quantity").cast("int") + 9
    return li.select(F.col("l_partkey").alias("contig_id"), target.alias("target"), (100 - 100 * F.col("l_discount")).alias("pident"), F.when(F.col("l_tax") > 0.04, hi).otherwise(lo).alias("qstart"), F.when(F.col("l_tax") > 0.04, lo).otherwise(hi).alias("qend"))


HITS = """hits AS (SELECT l_partkey AS contig_id,
  list_extract(['a#LTR/Gypsy','b#DNA/hAT','c#LINE/L1','d#Unknown','e#rRNA','Copia-6_I','Mariner_7','JOCKEY_2','plainname','f#SINE?/x'], CAST((l_orderkey + l_linenumber) % 10 + 1 AS INT)) AS target,
  100 - 100 * l_discount AS pident,
  CASE WHEN l_tax > 0.04 THEN l_suppkey*37 + l_linenumber*5 + CAST(floor(l_quantity) AS INT) + 9 ELSE l_suppkey*37 + l_linenumber*5 END AS qstart,
  CASE WHEN l_tax > 0.04 THEN l_suppkey*37 + l_linenumber*5 ELSE l_suppkey*37 + l_linenumber*5 + CAST(floor(l_quantity) AS INT) + 9 END AS qend FROM lineitem),
ids AS (SELECT p_partkey AS contig_id, CAST(3800 + 100 * p_size AS BIGINT) AS length FROM part)"""


def latent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """contig_id, vec, label (-1 is noise), prob, length, gc, profile (five samples)."""
    e, v = table(spark, sf_dir, "embeddings"), F.col("vec_id")
    return e.select(
        v.alias("contig_id"), F.transform("embedding", lambda x: x.cast("double")).alias("vec"),
        F.when(v % 7 == 0, -1).otherwise(F.col("label")).cast("int").alias("label"), (F.pmod(v * 37, F.lit(100)) / 100.0).alias("prob"),
        (F.lit(500) + F.pmod(v * 7919, F.lit(9000))).cast("long").alias("length"), (F.lit(0.3) + F.pmod(v * 31, F.lit(40)) / 100.0).alias("gc"),
        F.transform(F.slice("embedding", 1, 5), lambda x: F.abs(x.cast("double")) * 10).alias("profile"),
    )


LATENT = """lat AS (SELECT vec_id AS contig_id, CAST(embedding AS DOUBLE[]) AS vec, CAST(CASE WHEN vec_id % 7 = 0 THEN -1 ELSE label END AS INT) AS label,
  ((vec_id * 37) % 100) / 100.0 AS prob, CAST(500 + (vec_id * 7919) % 9000 AS BIGINT) AS length, 0.3 + ((vec_id * 31) % 40) / 100.0 AS gc,
  list_transform(CAST(embedding AS DOUBLE[])[1:5], lambda x: abs(x) * 10) AS profile FROM embeddings),
nv AS (SELECT *, list_transform(vec, lambda x: x / (CASE WHEN sqrt(list_dot_product(vec, vec)) = 0 THEN 1 ELSE sqrt(list_dot_product(vec, vec)) END)) AS u FROM lat)"""


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """what two classifiers said about each contig, by rules on doc_id."""
    c, d = contigs(spark, sf_dir), F.col("ord")
    pick = lambda names, by: F.element_at(F.array(*map(F.lit, names)), (F.pmod(by, F.lit(len(names))) + 1).cast("int"))
    out = c.withColumn("stage1", pick(TIARA_STAGE1, d)).withColumn("stage2", pick(TIARA_STAGE2, F.floor(d / 3)))
    out = out.withColumn("whokaryote_raw", pick(WHOKARYOTE, F.floor(d / 5)))
    for i, p in enumerate(("bac", "arc", "euk", "org", "pla", "mit", "unk1")):
        out = out.withColumn(p, (F.pmod(d * (13 + 4 * i), F.lit(100)) / 100.0))
    return out


TIARA_STAGE1 = ["bacteria", "eukarya", "organelle", "prokarya", "n/a", "unknown", "archaea"]
TIARA_STAGE2 = ["n/a", "mitochondrion", "plastid", "n/a", "unknown"]
WHOKARYOTE = ["eukaryote", "prokaryote", "Bacteria", "strange", "euk"]
CALLS = CONTIGS + f""",
calls AS (SELECT *, list_extract({TIARA_STAGE1}, CAST(ord % 7 + 1 AS INT)) AS stage1, list_extract({TIARA_STAGE2}, CAST((ord // 3) % 5 + 1 AS INT)) AS stage2,
  list_extract({WHOKARYOTE}, CAST((ord // 5) % 5 + 1 AS INT)) AS whokaryote_raw,
  {", ".join(f"((ord * {13 + 4 * i}) % 100) / 100.0 AS {p}" for i, p in enumerate(("bac", "arc", "euk", "org", "pla", "mit", "unk1")))} FROM c)"""


def ani_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """an ANI edge list between contigs, from orders."""
    o, n = table(spark, sf_dir, "orders"), table(spark, sf_dir, "documents").agg((F.max("doc_id") + 1).alias("n"))
    k = F.col("o_orderkey")
    x = o.join(F.broadcast(n))
    return x.select(F.concat(F.lit("c"), F.pmod(k * 7, "n")).alias("ref_name"), F.concat(F.lit("c"), F.pmod(k * 13 + 5, "n")).alias("query_name"), (F.lit(97.0) + F.pmod(k, F.lit(31)) / 10.0).alias("ani"), (F.lit(80.0) + F.pmod(k * 3, F.lit(21))).alias("af_ref"), (F.lit(80.0) + F.pmod(k * 11, F.lit(21))).alias("af_query"))


ANI = """ani AS (SELECT 'c' || ((o_orderkey * 7) % n) AS ref_name, 'c' || ((o_orderkey * 13 + 5) % n) AS query_name, 97.0 + (o_orderkey % 31) / 10.0 AS ani,
  80.0 + (o_orderkey * 3) % 21 AS af_ref, 80.0 + (o_orderkey * 11) % 21 AS af_query FROM orders, (SELECT max(doc_id) + 1 AS n FROM documents))"""


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """resource samples, a process for each user: unix seconds and growing counters."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("pid"), F.col("event_type").alias("stage"), F.expr("unix_micros(cast(ts as timestamp))").alias("at_us"), "event_id", F.col("value").alias("counter"))


SAMPLES = "samples AS (SELECT user_id AS pid, event_type AS stage, epoch_us(ts) AS at_us, event_id, value AS counter FROM events)"


def bin_edges(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """F8: (bin, length; a, b, ani, af_a, af_b): suppliers as bins, lines of orders as edges between them."""
    li = table(spark, sf_dir, "lineitem")
    bins = li.groupBy(F.concat(F.lit("bin_"), F.col("l_suppkey")).alias("bin")).agg(F.sum("l_quantity").cast("long").alias("length"))
    n = li.agg(F.max("l_suppkey").alias("n"))
    k = F.col("l_orderkey")
    x = li.join(F.broadcast(n))
    other = F.pmod(F.col("l_partkey") * 7 + k, "n") + 1
    return bins, x.select(F.concat(F.lit("bin_"), F.col("l_suppkey")).alias("a"), F.concat(F.lit("bin_"), other).alias("b"), (F.lit(97.0) + F.pmod(k, F.lit(23)) / 10.0).alias("ani"), (F.lit(70.0) + F.pmod(k * 3, F.lit(31))).alias("af_a"), (F.lit(70.0) + F.pmod(k * 11, F.lit(31))).alias("af_b"))


BIN_EDGES = """bl AS (SELECT 'bin_' || l_suppkey AS bin, CAST(sum(l_quantity) AS BIGINT) AS length FROM lineitem GROUP BY 1),
be AS (SELECT 'bin_' || l_suppkey AS a, 'bin_' || ((l_partkey * 7 + l_orderkey) % n + 1) AS b, 97.0 + (l_orderkey % 23) / 10.0 AS ani, 70.0 + (l_orderkey * 3) % 31 AS af_a, 70.0 + (l_orderkey * 11) % 31 AS af_b
  FROM lineitem, (SELECT max(l_suppkey) AS n FROM lineitem))"""


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """name, before, after (maps of metrics), weakest: what a gate compares, from the lines of each supplier. Some metrics are missing."""
    li = table(spark, sf_dir, "lineitem")
    some = F.pmod(F.col("name"), F.lit(7))
    half = lambda odd: F.pmod(F.col("l_linenumber"), F.lit(2)) == odd
    named = []
    for name, odd in (("before", 1), ("after", 0)):
        v = {
            "calinski_harabasz": F.avg(F.when(half(odd), F.col("l_extendedprice"))), "davies_bouldin": F.avg(F.when(half(odd), F.col("l_quantity"))), "silhouette": F.avg(F.when(half(odd), F.col("l_discount"))),
            "knn_agree@10": 1 - F.avg(F.when(half(odd), F.col("l_tax"))), "knn_agree@30": 1 - 2 * F.avg(F.when(half(odd), F.col("l_tax"))),
            "assigned_bp_pct": 60 + 10 * F.avg(F.when(half(odd), F.col("l_discount") * 10)), "n_clusters": F.count(F.when(half(odd), 1)).cast("double"),
        }
        named.append((name, v))
    x = li.groupBy(F.col("l_suppkey").alias("name")).agg(F.avg("l_tax").alias("weakest"), *(c.alias(f"{name}_{m}") for name, v in named for m, c in v.items()))
    gone = {"before": {"silhouette": some == 1}, "after": {"knn_agree@30": some == 2, "calinski_harabasz": some == 3}}
    all_gone = {"before": some == 4, "after": some.isin(4, 5)}
    def cell(name: str, m: str):
        missing = gone[name].get(m, F.lit(False)) | (all_gone[name] if m not in ("assigned_bp_pct", "n_clusters") else F.lit(False))
        return F.when(~missing, F.col(f"{name}_{m}"))
    maps = [F.create_map(*(y for m in v for y in (F.lit(m), cell(name, m)))).alias(name) for name, v in named]
    return x.select("name", *maps, "weakest")


def _half(odd: int, name: str) -> str:
    w = f"FILTER (l_linenumber % 2 = {odd})"
    return f"""avg(l_extendedprice) {w} AS {name}_ch, avg(l_quantity) {w} AS {name}_db, avg(l_discount) {w} AS {name}_si, 1 - avg(l_tax) {w} AS {name}_k10, 1 - 2 * avg(l_tax) {w} AS {name}_k30,
 60 + 10 * avg(l_discount * 10) {w} AS {name}_bp, CAST(count(*) {w} AS DOUBLE) AS {name}_n"""


CANDIDATES = f"""cr AS (SELECT l_suppkey AS name, avg(l_tax) AS weakest, {_half(1, "b")}, {_half(0, "a")} FROM lineitem GROUP BY 1),
cd AS (SELECT name, weakest, b_bp, a_bp, b_n, a_n, CASE WHEN name % 7 <> 4 THEN b_ch END AS b_ch, CASE WHEN name % 7 NOT IN (3, 4, 5) THEN a_ch END AS a_ch, CASE WHEN name % 7 <> 4 THEN b_db END AS b_db, CASE WHEN name % 7 NOT IN (4, 5) THEN a_db END AS a_db,
 CASE WHEN name % 7 NOT IN (1, 4) THEN b_si END AS b_si, CASE WHEN name % 7 NOT IN (4, 5) THEN a_si END AS a_si, CASE WHEN name % 7 <> 4 THEN b_k10 END AS b_k10, CASE WHEN name % 7 NOT IN (4, 5) THEN a_k10 END AS a_k10,
 CASE WHEN name % 7 <> 4 THEN b_k30 END AS b_k30, CASE WHEN name % 7 NOT IN (2, 4, 5) THEN a_k30 END AS a_k30 FROM cr),
ch AS (SELECT *, (a_ch - b_ch) / greatest(abs(b_ch), 1e-9) AS c_ch, -(a_db - b_db) / greatest(abs(b_db), 1e-9) AS c_db, (a_si - b_si) / greatest(abs(b_si), 1e-9) AS c_si, a_k10 - b_k10 AS c_k10, a_k30 - b_k30 AS c_k30,
 (a_k10 - b_k10) / greatest(abs(b_k10), 1e-9) AS r_k10, (a_k30 - b_k30) / greatest(abs(b_k30), 1e-9) AS r_k30 FROM cd)"""


def contig_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """contig_id, sample, depth, breadth of the contigs of F1 from all lines; what lies over 44 adds depth."""
    n = table(spark, sf_dir, "documents").agg((F.max("doc_id") + 1).alias("n"))
    rows = table(spark, sf_dir, "lineitem").join(F.broadcast(n))
    return rows.groupBy(F.concat(F.lit("c"), F.pmod("l_partkey", "n")).alias("contig_id"), F.concat("l_returnflag", "l_linestatus").alias("sample")).agg(F.sum(F.greatest(F.col("l_quantity") - 44, F.lit(0.0))).alias("depth"), (F.avg("l_discount") * 10).alias("breadth"))


CONTIG_DEPTH = """cdp AS (SELECT 'c' || (l_partkey % n) AS contig_id, l_returnflag || l_linestatus AS sample, sum(greatest(l_quantity - 44, 0)) AS depth, avg(l_discount) * 10 AS breadth FROM lineitem, (SELECT max(doc_id) + 1 AS n FROM documents) GROUP BY 1, 2),
cvv AS (SELECT contig_id, CASE WHEN s > 0 THEN sqrt(greatest(0, (ss - s * s / 6) / 5)) / (s / 6) ELSE 0 END AS cov_cv FROM (SELECT contig_id, sum(depth) AS s, sum(depth * depth) AS ss FROM cdp GROUP BY 1)),
cbs AS (SELECT contig_id, breadth FROM (SELECT *, row_number() OVER (PARTITION BY contig_id ORDER BY depth DESC, sample) AS k FROM cdp WHERE breadth >= 0.473) WHERE k = 1),
cbr AS (SELECT m.contig_id, coalesce(cbs.breadth, most) AS breadth FROM (SELECT contig_id, max(breadth) AS most FROM cdp GROUP BY 1) m LEFT JOIN cbs USING (contig_id))"""
