"""The whole flow on made genomes, its folder, and its settings."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamwork import __main__ as cli
from loamwork.plans import flow


@pytest.fixture(scope="module")
def genomes(tmp_path_factory):
    """Four genomes with their own composition and coverage pattern, 60 contigs each, some short ones and a repeated one."""
    rnd, folder, fa, cov = np.random.default_rng(8), tmp_path_factory.mktemp("genomes"), [], ["contig_id\tsample\tdepth"]
    for g in range(4):
        table = rnd.dirichlet(np.full(4, 0.7), 64)
        level = rnd.uniform(2, 40, 5)
        for k in range(60):
            n = int(rnd.integers(2500, 5000)) if k < 55 else 700
            s = list(rnd.integers(0, 4, 3))
            u = rnd.random(n)
            for i in range(n):
                s.append(int(np.searchsorted(np.cumsum(table[s[-3] * 16 + s[-2] * 4 + s[-1]]), u[i]).clip(0, 3)))
            fa.append(f">g{g}_{k}\n" + "".join("ACGT"[x] for x in s))
            cov += [f"g{g}_{k}\ts{j}\t{max(0.1, d * rnd.normal(1, 0.05)):.3f}" for j, d in enumerate(level)]
    fa.append(">copy\n" + fa[0].split("\n")[1])
    (folder / "c.fa").write_text("\n".join(fa) + "\n")
    (folder / "c.tsv").write_text("\n".join(cov) + "\n")
    return folder


def test_flow_finds_the_genomes(spark, genomes, tmp_path, capsys):
    (tmp_path / "config.yaml").write_text("# settings\nmin_cluster: 15\nmin_samples: 5\nbin_contigs: 10\nsub_min_contigs: 500\n")
    args = ["run", "--contigs", str(genomes / "c.fa"), "--coverage", str(genomes / "c.tsv"), "--out", str(tmp_path / "out"), "--config", str(tmp_path / "config.yaml"), "--set", "rescue_radius=0.8", "--set", "tune=true"]
    cli.main(args)
    about = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert about["n_bins"] == 4 and about["settings"]["rescue_radius"] == 0.8 and about["settings"]["bin_contigs"] == 10
    assert [x["stage"] for x in about["gate"]][-1] == "05_after_bin_filter" and len(about["gate"]) == 10
    bins = {}
    for r in spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "out/tables/assignments")).collect():
        bins.setdefault(r.bin_id, []).append(r.contig_id)
    assert all(len({c[:2] for c in members}) == 1 and len(members) > 50 for members in bins.values()) and "copy" not in sum(bins.values(), [])
    fasta = spark.read.text(str(tmp_path / "out/bins")).where("value like '>%'").count()
    assert fasta == sum(map(len, bins.values()))


def test_flow_starts_where_it_stopped(spark, genomes, tmp_path, monkeypatch):
    rows = flow.features(flow.fasta.read_fasta(spark, str(genomes / "c.fa"), upper=True), spark.read.option("sep", "\t").option("header", True).schema("contig_id string, sample string, depth double").csv(str(genomes / "c.tsv")), flow.Settings())
    assert rows.count() == 240 and rows.where("pool").count() == 220
    s, seen, whole = flow.Settings(min_cluster=15, min_samples=5, gate=False, sub_min_contigs=500), [], flow.Folder.table

    def table(self, name, mark, make, log=None):
        out = whole(self, name, mark, make, log)
        seen.append((name, name in self.reused))
        return out

    monkeypatch.setattr(flow.Folder, "table", table)
    final, log = flow.cluster(rows, s, str(tmp_path))
    first = {r.contig_id: r.label for r in final.collect()}
    assert not any(reused for _, reused in seen) and len(set(first.values()) - {-1}) == 4
    seen.clear()
    final, again = flow.cluster(rows, s, str(tmp_path))
    assert {r.contig_id: r.label for r in final.collect()} == first and all(reused for _, reused in seen) and again == log and len(log) == 10
    seen.clear()
    flow.cluster(rows, flow.replace(s, bin_contigs=1000), str(tmp_path))
    assert not any(reused for _, reused in seen)


def test_settings(tmp_path):
    (tmp_path / "a.json").write_text('{"length_scale": 2.0, "cluster_length": 1500}')
    s = flow.load_settings(str(tmp_path / "a.json"), rescue="early")
    assert (s.min_contig_length, s.cluster_length, s.recruit_length, s.rescue) == (1000, 1500, 1000, "early")
    with pytest.raises(ValueError, match="unknown settings"):
        flow.load_settings(None, colour=1)


def test_changed_inputs_are_seen(spark, tmp_path, monkeypatch):
    """The same paths, sizes and row numbers, another content. Clustering itself is left out."""
    monkeypatch.setattr(flow, "cluster", lambda rows, *_, **__: (rows.withColumn("label", F.lit(-1)), []))
    rnd = np.random.default_rng(3)
    seqs = {f"c{n}": "".join("ACGT"[x] for x in rnd.integers(0, 4, 1500)) for n in range(60)}

    def write(seqs, depth=2):
        (tmp_path / "c.fa").write_text("".join(f">{n}\n{s}\n" for n, s in seqs.items()))
        (tmp_path / "c.tsv").write_text("contig_id\tsample\tdepth\n" + "".join(f"{n}\ts{j}\t{depth + j + k % 3}.5\n" for k, n in enumerate(seqs) for j in range(3)))

    s = flow.Settings(min_cluster=10, min_samples=3, sub_min_contigs=500)
    go = lambda: flow.run(spark, str(tmp_path / "c.fa"), str(tmp_path / "c.tsv"), str(tmp_path / "out"), s)
    table = lambda: spark.read.parquet(str(tmp_path / "out/stages/00_features"))
    write(seqs)
    assert go()["changed_inputs"] == go()["changed_inputs"] == {} and table().count() == 60
    write(seqs | {"c7": seqs["c7"][:700] + ("A" if seqs["c7"][700] != "A" else "C") + seqs["c7"][701:]})
    assert go()["changed_inputs"] == {"contigs": 1}
    write(seqs, depth=3)
    assert go()["changed_inputs"]["coverage"] > 30
    write(seqs | {f"d{n}": "ACGTTGCAAC" * 150 for n in range(3)})
    assert go()["changed_inputs"].keys() == {"contigs", "coverage"} and table().count() == 61
