"""What the third review found."""

import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from loamwork.functions import kmers
from loamwork.operators import ani, bins, mapping, merge, neighbours
from loamwork.plans import fixtures, q_coverage


def test_reconcile_takes_all_contigs(spark, sf):
    sides = {r.contig_id: r.side for r in q_coverage.coverage_reconcile(spark, sf).collect()}
    parts = {r.p_partkey for r in spark.read.parquet(f"{sf}/part.parquet").collect()}
    assert parts <= set(sides)
    assert {sides[c] for c in parts if c % 5 == 0} == {"contigs_only"}


def test_shares_are_added_in_the_order_of_rows(spark, tmp_path):
    rnd = random.Random(5)
    lines = [(rnd.randrange(1, 40), rnd.randrange(11) / 100) for _ in range(2000)]
    (tmp_path / "lineitem.parquet").mkdir()
    for i in range(8):
        part, share = zip(*lines[250 * i : 250 * i + 250], strict=True)
        same = lambda v: [v] * 250
        pq.write_table(pa.table({"l_partkey": part, "l_returnflag": same("A"), "l_linestatus": same("F"), "l_quantity": same(50.0), "l_discount": share}), tmp_path / "lineitem.parquet" / f"part-{i}.parquet")
    expected = {}
    for part, share in lines:
        t, n = expected.get(part - (part % 5 == 0), (0.0, 0))
        expected[part - (part % 5 == 0)] = (t + share, n + 1)
    got = {r.contig_id: r.breadth for r in fixtures.depth(spark, str(tmp_path)).collect()}
    assert got == {c: t / n * 10 for c, (t, n) in expected.items()}


def test_home_share_is_a_decimal(spark):
    n = spark.createDataFrame([(1, 1, 102), (1, 2, 98), (1, 3, 100), (1, 4, 100), (1, 5, 100), (1, 6, 100)], "piece long, bin int, n long")
    d = n.selectExpr("piece", "bin", "0.05D AS d")
    assert [(r.piece, r.bin) for r in merge.best_home(n, d, 0.17, 1.1).collect()] == [(1, 1)]


def test_nearest_of_many_copies_are_exact_and_few(spark):
    rnd = np.random.default_rng(3)
    vec = np.round(rnd.normal(size=(900, 3)))
    vec[rnd.permutation(900)[:300]] = 0
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vec)], "contig_id long, vec array<double>").repartition(5)
    d = np.sqrt(((vec[:, None] - vec[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    expected = {(i, int(j), k + 1) for i, row in enumerate(d) for k, j in enumerate(np.lexsort((np.arange(900), row))[:6])}
    for got in (neighbours.knn(df, df, 6, query_blocks=3, ref_blocks=50), neighbours.knn_distinct(df, 6)):
        assert {(r.query_id, r.ref_id, r["rank"]) for r in got.collect()} == expected


def test_a_task_keeps_the_best_of_the_blocks_it_meets(spark):
    df = spark.range(640).selectExpr("id AS contig_id", "array(cast(id AS double), 1D) AS vec")
    plan = neighbours.knn(df, df, 4, ref_blocks=40)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in text and "Broadcast" not in text and "row_number" not in text


def test_covers_compare_few_pairs_whole(spark):
    rnd = random.Random(9)
    sets = {s: set(rnd.sample(range(60), rnd.choice([1, 2, 3, 8, 12]))) for s in range(40)}
    sets[40] = {1000}  # in no set of after
    outs = {o: sets[o] | sets[o + 20] if o % 2 else set(rnd.sample(range(60), 20)) for o in range(20)}
    table = lambda x, n: spark.createDataFrame([(i, c) for i, m in x.items() for c in m], f"{n} long, contig_id long")
    held = {o: [s for s in sets if sets[s] <= outs[o]] for o in outs}
    expected = {(o, len(h), sum(len(sets[s]) for s in h) == len(outs[o])) for o, h in held.items() if h}
    found = bins.merge_covers(table(sets, "set_id"), table(outs, "out_id"))
    assert set(map(tuple, found.collect())) == expected


def test_kmers_are_summed_in_tasks(spark):
    rnd = random.Random(2)
    rows = [(f"c{i}", "".join(rnd.choice("ACGTN" if i % 3 else "ACGT") for _ in range(rnd.randrange(30)))) for i in range(200)] + [("gone", None)]
    df = spark.createDataFrame(rows, "contig_id string, seq string")
    expected = {r.kmer: r.n for r in kmers.kmer_rows(df).groupBy("kmer").sum("n").toDF("kmer", "n").collect()}
    assert {r.kmer: r.n for r in kmers.kmer_totals(df).collect()} == expected


def _brute_places(reads, contigs):
    """The place of each read that most seeds vote for, by all votes of all contigs."""
    most, out = np.uint64((1 << 64) // mapping.EVERY - 1), {}
    index = {c: dict(zip(h.tolist(), zip(p.tolist(), b.tolist(), strict=True), strict=True)) for c, s in contigs.items() for h, p, b in [mapping._contig_seeds(s, mapping.K, most)]}
    for name, seq in reads.items():
        h, place, back = mapping._contig_seeds(seq, mapping.K, most)
        best = None
        for c, seeds in index.items():
            bins = {}
            for x, at, b in zip(h.tolist(), place.tolist(), back.tolist(), strict=True):
                if x in seeds:
                    p, other = seeds[x]
                    start = p - (len(seq) - mapping.K - at if other != b else at)
                    bins.setdefault((other != b, start // mapping.SLACK), []).append(start)
            for (turned, i), starts in bins.items():
                found = (-len(starts) - len(bins.get((turned, i + 1), [])), c, min(starts), turned)
                best = found if best is None or found < best else best
        if best and -best[0] >= mapping.VOTES:
            lo, hi = max(best[2], 0), min(best[2] + len(seq), len(contigs[best[1]]))
            if lo < hi:
                out[name] = (best[1], best[3], lo, hi, -best[0])
    return out


def test_reads_meet_few_contigs_and_keep_their_places(spark, monkeypatch):
    rnd = random.Random(8)
    dna = lambda n: "".join(rnd.choice("ACGT") for _ in range(n))
    common, contigs = dna(400), {}
    for i in range(40):
        at, mine = rnd.randrange(300), list(dna(rnd.randrange(50, 300)) + common + dna(200))
        for j in rnd.sample(range(len(mine)), 5):
            mine[j] = rnd.choice("ACGTN")
        contigs[f"c{i}"] = "".join(mine) + (mine and "".join(mine[at : at + 150]) if i % 3 else "")
    contigs |= {"d": contigs["c7"], "b": contigs["c9"], "short": "ACGT", "empty": ""}
    reads = {}
    for i, (name, seq) in enumerate(contigs.items()):
        for at in range(0, max(len(seq) - 100, 0), 30):
            read = list(seq[at : at + rnd.randrange(80, 100)])
            for j in rnd.sample(range(len(read)), i % 4):
                read[j] = rnd.choice("ACGT")
            read = "".join(read)
            reads[f"{name}_{at}"] = read[::-1].translate(str.maketrans("ACGT", "TGCA")) if at % 4 else read
    reads |= {"stranger": dna(90), "odd": "ACG\u00e9" * 20, "none": ""}
    met, voted = [], mapping._voted

    def counted(rows, *how):
        met.append(rows.where("packed IS NOT NULL AND contig_id IS NOT NULL").count())
        return voted(rows, *how)

    monkeypatch.setattr(mapping, "_voted", counted)
    table = lambda x, n: spark.createDataFrame(list(x.items()), f"{n} string, seq string")
    r, c = table(reads, "read_id"), table(contigs, "contig_id")
    got = {h.read_id: (h.contig_id, h.back, h.lo, h.hi, h.seeds) for h in mapping.mapped(r, c).collect()}
    assert got == _brute_places(reads, contigs)
    named = lambda x, n: ani.seeds(x.selectExpr(f"{n} AS name", "seq", "0 AS begin"), mapping.K, mapping.EVERY).select("hash")
    votes = named(r, "read_id").join(named(c, "contig_id"), "hash").count()
    assert met[0] < votes / 20 and sum(met) < votes / 2
