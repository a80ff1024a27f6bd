"""Queries on contigs: reading, statistics, composition, duplicates and containment."""

from __future__ import annotations

from pyspark.sql import functions as F

from loamwork.functions import kmers, sequence
from loamwork.operators import ani, assembly
from loamwork.plans import fixtures as fx
from loamwork.plans.registry import query
from loamwork.plans.workspace import settled
from loamwork.sources import fasta
from loamwork.plans.workspace import workspace

C = f"WITH {fx.CONTIGS}"
_CUM = """, r AS (SELECT length, sum(length) OVER (ORDER BY length DESC, ord ROWS UNBOUNDED PRECEDING) AS run, row_number() OVER (ORDER BY length DESC, ord) AS k, sum(length) OVER () AS total FROM c)"""


@query(C + " SELECT contig_id, length, md5(seq) AS digest FROM c WHERE length > 0")
def fasta_scan(spark, sf_dir):
    """Contigs written as FASTA of 60 columns and read back."""
    path = f"{workspace(spark)}/contigs"
    fasta.write_fasta(fx.contigs(spark, sf_dir).where("length > 0"), path)
    return fasta.read_fasta(spark, path).select("contig_id", "length", F.md5(F.col("seq").cast("binary")).alias("digest"))


@query(C + " SELECT count(*) AS n FROM c WHERE length > 0")
def fasta_count(spark, sf_dir):
    """A1, A5: records of a FASTA."""
    path = f"{workspace(spark)}/contigs"
    fasta.write_fasta(fx.contigs(spark, sf_dir).where("length > 0"), path, width=0)
    return fasta.read_ids(spark, path).agg(F.count("*").alias("n"))


@query(C + " SELECT contig_id, length FROM c WHERE length >= 200")
def length_filter(spark, sf_dir):
    """Contigs of at least 200 bases."""
    return fx.contigs(spark, sf_dir).where("length >= 200").select("contig_id", "length")


@query(C + " SELECT contig_id FROM c WHERE length < 200 OR length IS NULL")
def removed_by_length(spark, sf_dir):
    """What the length filter takes out, as a set difference."""
    c = fx.contigs(spark, sf_dir)
    return assembly.without(c, c.where("length >= 200")).select("contig_id")


@query(C + _CUM + """ SELECT count(*) AS n_contigs, CAST(sum(c.length) AS BIGINT) AS total_bp, avg(c.length) AS mean_len, median(c.length) AS median_len, max(c.length) AS max_len, min(c.length) AS min_len,
 CAST(sum((c.length < 200)::INT) AS BIGINT) AS lt_200, CAST(sum((c.length < 500)::INT) AS BIGINT) AS lt_500, CAST(sum((c.length < 1000)::INT) AS BIGINT) AS lt_1000,
 (SELECT max(length) FROM r WHERE run >= total / 2.0) AS n50, (SELECT min(k) FROM r WHERE run >= total / 2.0) AS l50 FROM c""")
def assembly_stats(spark, sf_dir):
    """Assembly statistics."""
    s = assembly.assembly_stats(fx.contigs(spark, sf_dir))
    return s


@query(C + """, r AS (SELECT sample, length, sum(length) OVER (PARTITION BY sample ORDER BY length DESC, ord ROWS UNBOUNDED PRECEDING) AS run, row_number() OVER (PARTITION BY sample ORDER BY length DESC, ord) AS k, sum(length) OVER (PARTITION BY sample) AS total FROM c),
n AS (SELECT sample, max(length) AS n50, min(k) AS l50 FROM r WHERE run >= total / 2.0 GROUP BY 1)
SELECT *, CASE WHEN n50 < 1000 THEN 'extremely_fragmented' WHEN n50 < 2000 THEN 'fragmented' WHEN n50 < 5000 THEN 'good' ELSE 'excellent' END AS tier FROM n""")
def sample_n50(spark, sf_dir):
    """N50, L50 and tier of each sample."""
    return assembly.n50(fx.contigs(spark, sf_dir), ["sample"]).withColumn("tier", assembly.n50_tier(F.col("n50")))


@query("SELECT doc_id, source || '_' || regexp_replace(trim(text), '[^A-Za-z0-9_.\\-]', '_', 'g') AS safe_id FROM documents")
def safe_ids(spark, sf_dir):
    """B1: safe identifiers from free text."""
    d = fx.table(spark, sf_dir, "documents")
    return d.select("doc_id", sequence.safe_id(F.col("source"), F.col("text")).alias("safe_id"))


@query("SELECT p_partkey, CASE WHEN regexp_matches(p_brand, '#([0-9])[0-9]') THEN regexp_extract(p_brand, '#([0-9])[0-9]', 1) END AS tag FROM part")
def sample_tags(spark, sf_dir):
    """B2: sample tags by a header pattern."""
    return fx.table(spark, sf_dir, "part").select("p_partkey", sequence.sample_tag(F.col("p_brand"), "#([0-9])[0-9]").alias("tag"))


@query("SELECT c_custkey AS file, c_mktsegment AS name, c_mktsegment || CASE WHEN k = 0 THEN '' ELSE '_' || k END AS unique_name FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) - 1 AS k FROM customer)")
def sample_names(spark, sf_dir):
    """Names of colliding samples."""
    files = fx.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("file"), F.col("c_mktsegment").alias("name"))
    return assembly.numbered_names(files)


@query(C + """ SELECT contig_id, CASE WHEN contig_id <> f THEN f ELSE '' END AS duplicate_of FROM (SELECT contig_id, first_value(contig_id) OVER (PARTITION BY seq ORDER BY ord) AS f FROM c)""")
def exact_duplicates(spark, sf_dir):
    """The first contig with the same sequence."""
    return assembly.first_duplicates(fx.contigs(spark, sf_dir)).select("contig_id", "duplicate_of")


@query(C + """ SELECT contig_id, CASE WHEN length = 0 THEN 0 ELSE length(regexp_replace(seq, '[^GC]', '', 'g')) / CAST(length AS DOUBLE) END AS gc_share,
 length(regexp_replace(seq, '[^GC]', '', 'g')) / CAST(nullif(length(regexp_replace(seq, '[^ACGT]', '', 'g')), 0) AS DOUBLE) AS gc_known, md5(reverse(translate(seq, 'ACGT', 'TGCA'))) AS complement FROM c""")
def gc_and_complement(spark, sf_dir):
    """V1, V5: GC shares and reverse complements."""
    c = fx.contigs(spark, sf_dir)
    return c.select("contig_id", sequence.gc_share(F.col("seq")).alias("gc_share"), sequence.gc_known(F.col("seq")).alias("gc_known"), F.md5(sequence.reverse_complement(F.col("seq")).cast("binary")).alias("complement"))


KMERS = C + """, w AS (SELECT contig_id, substr(seq, CAST(i AS INT), 4) AS x FROM (SELECT contig_id, seq, unnest(range(1, length - 2)) AS i FROM c WHERE length >= 4)),
k AS (SELECT contig_id, least(x, reverse(translate(x, 'ACGT', 'TGCA'))) AS kmer, count(*) AS n FROM w WHERE NOT regexp_matches(x, '[^ACGT]') GROUP BY 1, 2)"""


@query(KMERS + " SELECT contig_id, kmer, n / CAST(sum(n) OVER (PARTITION BY contig_id) AS DOUBLE) AS share FROM k")
def tnf_shares(spark, sf_dir):
    """V2, V3: canonical 4-mer shares that aren't zero."""
    names, _ = kmers.canonical_index()
    x = kmers.tnf(fx.contigs(spark, sf_dir)).select("contig_id", F.posexplode("features").alias("pos", "share")).where("share > 0")
    return x.select("contig_id", F.element_at(F.array(*map(F.lit, names)), F.col("pos") + 1).alias("kmer"), "share")


@query(KMERS + " SELECT kmer, CAST(sum(n) AS BIGINT) AS n FROM k GROUP BY 1")
def tnf_counts(spark, sf_dir):
    """V3: canonical 4-mer counts of the assembly, counted by task and summed."""
    return kmers.kmer_totals(fx.contigs(spark, sf_dir))


@query(KMERS + ", t AS (SELECT contig_id, CAST(sum(n) AS BIGINT) AS n FROM k GROUP BY 1) SELECT contig_id, coalesce(n, 0) AS n_kmers, CASE WHEN coalesce(n, 0) < 50 THEN 0.0::DOUBLE ELSE least(1.0, n / 200.0::DOUBLE) END AS weight FROM c LEFT JOIN t USING (contig_id)")
def tnf_weights(spark, sf_dir):
    """V4: composition confidence."""
    return kmers.tnf(fx.contigs(spark, sf_dir), full=200).select("contig_id", "n_kmers", "weight")


#: Letters of a seed of X2's edges.
_K = 21


def _identities(c):
    """X2's edges between the contigs c that are the first with their sequence."""
    return ani.contig_ani(settled(assembly.first_duplicates(c).where("duplicate_of = ''").select("contig_id", "seq")), least_identity=90.0, k=_K)


@query()
def contig_identities(spark, sf_dir):
    """Identity and aligned fractions of all contigs that are alike, from their sequences; equal ones stand for each other."""
    return _identities(settled(fx.letters(spark, sf_dir))).select("ref_name", "query_name", *(F.round(x, 6).alias(x) for x in ("ani", "af_ref", "af_query")))


@query()
def sequence_containment(spark, sf_dir):
    """K18 on X2's edges: which contigs of one source are contained in a longer one of another.

    A pair's ends stand for all contigs of their source with the same sequence; rows of the link 'copy' name these.
    """
    return contained(fx.letters(spark, sf_dir))


def contained(c):
    """winner, loser, ani, af_short, link: the pairs of K18 ('contained') between the first contigs of a sequence in each sample, and every other contig ('copy') under the one of its sample that stands for it."""
    c = settled(c)
    copies = settled(assembly.sequence_copies(c))
    alike = _identities(c).where("ani >= 98.0 AND greatest(af_ref, af_query) >= 80.0")
    pairs = assembly.containment_pairs(assembly.pairs_of_copies(alike, copies, _K), copies, min_ani=98.0, min_af=80.0).select("winner", "loser", F.round("ani", 6).alias("ani"), F.round("af_short", 6).alias("af_short"), F.lit("contained").alias("link"))
    whole = (F.lit(100.0).alias(x) for x in ("ani", "af_short"))
    return pairs.unionByName(copies.where("contig_id <> nearest").select(F.col("nearest").alias("winner"), F.col("contig_id").alias("loser"), *whole, F.lit("copy").alias("link")))


PAIRS = f"""WITH {fx.CONTIGS}, {fx.ANI},
p AS (SELECT a.*, q.length AS lq, r.length AS lr FROM ani a JOIN c q ON a.query_name = q.contig_id JOIN c r ON a.ref_name = r.contig_id WHERE ani >= 98.0 AND query_name <> ref_name AND q.sample <> r.sample),
s AS (SELECT *, CASE WHEN lq < lr THEN af_query WHEN lq > lr THEN af_ref ELSE least(af_query, af_ref) END AS af_short, (lq > lr OR (lq = lr AND query_name < ref_name)) AS qw FROM p),
pairs AS (SELECT CASE WHEN qw THEN query_name ELSE ref_name END AS winner, CASE WHEN qw THEN ref_name ELSE query_name END AS loser, CASE WHEN qw THEN lq ELSE lr END AS len_winner, CASE WHEN qw THEN lr ELSE lq END AS len_loser, ani, af_short FROM s WHERE af_short >= 90),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY loser ORDER BY len_winner DESC, ani DESC, winner) AS k FROM pairs) WHERE k = 1)"""


def _pairs(spark, sf_dir):
    return assembly.containment_pairs(fx.ani_pairs(spark, sf_dir), fx.contigs(spark, sf_dir), min_ani=98.0, min_af=90.0)


@query(PAIRS + " SELECT winner, loser, len_winner, len_loser, CAST(ani AS DOUBLE) AS ani, CAST(af_short AS DOUBLE) AS af_short FROM pairs")
def containment_pairs(spark, sf_dir):
    """Redundant pairs."""
    return _pairs(spark, sf_dir).withColumn("ani", F.col("ani").cast("double")).withColumn("af_short", F.col("af_short").cast("double"))


@query(PAIRS + " SELECT contig_id FROM c WHERE contig_id NOT IN (SELECT loser FROM pairs)")
def containment_kept(spark, sf_dir):
    """Contigs that no pair removes; every loser goes."""
    lost = _pairs(spark, sf_dir).select(F.col("loser").alias("contig_id"))
    return assembly.without(fx.contigs(spark, sf_dir), lost).select("contig_id")


@query(PAIRS.replace("WITH ", "WITH RECURSIVE ", 1) + """, chain AS (SELECT loser, winner AS final FROM best UNION ALL SELECT chain.loser, best.winner FROM chain JOIN best ON chain.final = best.loser)
SELECT best.loser, winner, final AS final_representative FROM best JOIN chain ON best.loser = chain.loser WHERE final NOT IN (SELECT loser FROM best)""")
def containment_representatives(spark, sf_dir):
    """The best winner of each loser, and who is left at its chain's end."""
    return assembly.final_representatives(assembly.best_winners(_pairs(spark, sf_dir))).select("loser", "winner", "final_representative")


_MASTER = PAIRS + """, m AS (SELECT c.contig_id, c.length, CASE WHEN p.loser IS NOT NULL THEN 'removed_step5' WHEN length < 200 THEN 'removed_step4' WHEN d.duplicate THEN 'removed_step7' ELSE 'retained' END AS final_status,
 CASE WHEN p.loser IS NOT NULL THEN 'contained' WHEN length < 200 THEN 'short' WHEN d.duplicate THEN 'duplicate' ELSE '' END AS reason
 FROM c LEFT JOIN (SELECT DISTINCT loser FROM pairs) p ON c.contig_id = p.loser LEFT JOIN (SELECT contig_id, contig_id <> first_value(contig_id) OVER (PARTITION BY seq ORDER BY ord) AS duplicate FROM c) d ON c.contig_id = d.contig_id)"""


def _master(spark, sf_dir):
    c = fx.contigs(spark, sf_dir)
    steps = [
        ("step5", _pairs(spark, sf_dir).select(F.col("loser").alias("contig_id"), F.lit("contained").alias("reason"))),
        ("step4", c.where("length < 200").select("contig_id", F.lit("short").alias("reason"))),
        ("step7", assembly.first_duplicates(c).where("duplicate_of <> ''").select("contig_id", F.lit("duplicate").alias("reason"))),
    ]
    return assembly.master_table(c.select("contig_id", "length"), steps)


@query(_MASTER + " SELECT * FROM m")
def master_decisions(spark, sf_dir):
    """The audit table."""
    return _master(spark, sf_dir)


@query(_MASTER + " SELECT final_status, count(*) AS n, CAST(sum(length) AS BIGINT) AS bp, 100.0 * count(*) / CAST((SELECT count(*) FROM m) AS DOUBLE) AS pct_n, 100.0 * sum(length) / CAST((SELECT sum(length) FROM m) AS DOUBLE) AS pct_bp FROM m GROUP BY 1")
def funnel_summary(spark, sf_dir):
    """The funnel of all steps."""
    return assembly.funnel(_master(spark, sf_dir))


@query(f"""WITH {fx.CONTIGS}, cut AS (SELECT contig_id, seq, length, CAST(ord % 50 AS BIGINT) AS lo, CAST(ord % 50 + 20 + ord % 30 AS BIGINT) AS hi FROM c WHERE length >= 200)
SELECT contig_id, md5(substr(seq, 1, lo) || repeat('N', CAST(hi - lo AS INT)) || substr(seq, CAST(hi + 1 AS INT))) AS digest, hi - lo AS masked_bp FROM cut""")
def masked_sequences(spark, sf_dir):
    """Features (two that overlap) masked by N after merging."""
    from loamwork.operators.intervals import merged_spans

    c, k = fx.contigs(spark, sf_dir).where("length >= 200"), F.col("ord")
    a = c.select("contig_id", (k % 50).alias("lo"), (k % 50 + 15).alias("hi"))
    b = c.select("contig_id", (k % 50 + 10).alias("lo"), (k % 50 + 20 + k % 30).alias("hi"))
    x = c.join(merged_spans(a.union(b)), "contig_id")
    size = F.aggregate("spans", F.lit(0).cast("long"), lambda s, r: s + r["hi"] - r["lo"])
    return x.select("contig_id", F.md5(sequence.masked(F.col("seq"), F.col("spans")).cast("binary")).alias("digest"), size.alias("masked_bp"))


@query(C + """, r AS (SELECT sample, length AS n, 20 + ord % 25 AS q FROM c WHERE length > 0), s AS (SELECT sample, avg(n) AS mean_length, avg(q) AS mean_quality FROM r GROUP BY 1)
SELECT *, CASE WHEN mean_length < 500 THEN 'short' WHEN mean_quality >= 30 AND mean_length >= 5000 THEN 'hifi' ELSE 'ont' END AS read_type FROM s""")
def read_types(spark, sf_dir):
    """Read types from sequence lengths and Phred qualities."""
    from loamwork.sources.fastq import read_type

    c = fx.contigs(spark, sf_dir).where("length > 0")
    quality = F.expr("repeat(char(cast(33 + 20 + ord % 25 as int)), cast(length as int))")
    return read_type(c.select("sample", "seq", quality.alias("quality")))


@query(C + """ SELECT contig_id, length, md5(seq) AS digest, md5(repeat(chr(CAST(53 + ord % 25 AS INT)), CAST(length AS INT))) AS quality FROM c WHERE length > 0""")
def fastq_reads(spark, sf_dir):
    """Contigs written as FASTQ and read back by byte ranges; a quality may begin with '@'."""
    from loamwork.sources import fastq

    path = f"{workspace(spark)}/reads"
    c = fx.contigs(spark, sf_dir).where("length > 0")
    fastq.write_fastq(c.select(F.col("contig_id").alias("read_id"), "seq", F.expr("repeat(char(cast(53 + ord % 25 as int)), cast(length as int))").alias("quality")), path)
    x = fastq.read_fastq(spark, path, columns="read_id string, seq string, quality string")
    return x.select(F.col("read_id").alias("contig_id"), F.length("seq").cast("long").alias("length"), F.md5(F.col("seq").cast("binary")).alias("digest"), F.md5(F.col("quality").cast("binary")).alias("quality"))


@query("SELECT vec_id, CAST(len(embedding) AS INT) AS width, CAST(list_sum(list_transform(embedding, lambda x: round(CAST(x AS DOUBLE) * 16777216))) AS BIGINT) AS total FROM embeddings")
def npy_rows(spark, sf_dir):
    """Embeddings, each behind its id, written as matrices and read back by ranges of rows."""
    from loamwork.sources import npy

    path = f"{workspace(spark)}/vectors"
    e = fx.table(spark, sf_dir, "embeddings")
    npy.write_npy(e.select(F.concat(F.array(F.col("vec_id").cast("double")), F.col("embedding").cast("array<double>")).alias("vec")), path)
    x = npy.read_npy(spark, path)
    values = F.expr("slice(vec, 2, size(vec) - 1)")
    total = F.aggregate(values, F.lit(0).cast("long"), lambda s, v: s + F.round(v * 16777216).cast("long"))
    return x.select(F.get("vec", F.lit(0)).cast("long").alias("vec_id"), F.size(values).alias("width"), total.alias("total"))
