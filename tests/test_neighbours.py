"""The index against exact search: recall, and how much it looks at."""

import numpy as np
import pytest

from loamwork.operators import neighbours, quality
from loamwork.plans.q_bins import rows


def _recall(spark, x, asked, k=10):
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "contig_id long, vec array<double>").repartition(4).cache()
    index = neighbours.fit_cells(table, k)
    got = neighbours.knn_indexed(table.where(f"contig_id % {asked} = 0"), table, k, index).collect()
    d = ((x[::asked, None] - x[None]) ** 2).sum(2)
    d[np.arange(len(d)), np.arange(0, len(x), asked)] = np.inf
    want = {(asked * q, int(r)) for q, near in enumerate(np.argsort(d, axis=1, kind="stable")[:, :k]) for r in near}
    cell = index.nearest(x, 1)[:, 0]
    size = np.bincount(cell, minlength=len(index.centres))
    seen = size[index.nearest(x[::asked], index.visits)].sum() / (len(d) * len(x))
    assert all(abs(r.distance - np.sqrt(d[r.query_id // asked, r.ref_id])) < 1e-9 for r in got) and max(r["rank"] for r in got) == k
    return len({(r.query_id, r.ref_id) for r in got} & want) / len(want), seen


def test_index_on_grouped_vectors(spark):
    rnd = np.random.default_rng(1)
    x = rnd.normal(size=(60, 24))[rnd.integers(0, 60, 6000)] * 3 + rnd.normal(size=(6000, 24))
    recall, seen = _recall(spark, x, 50)
    assert recall >= 0.9 and seen < 0.15


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.1"])
def test_index_on_embeddings(spark, sf):
    x = np.array([r.vec for r in rows(spark, sf).select("contig_id", "vec").orderBy("contig_id").collect()])
    recall, seen = _recall(spark, x, 50)
    assert recall >= 0.9 and seen < 0.95


def test_silhouettes_are_brute_force(spark):
    rnd = np.random.default_rng(2)
    x, label = rnd.normal(size=(700, 5)), rnd.integers(-1, 4, 700)
    label[0] = 9  # a bin of one
    table = spark.createDataFrame([(i, int(k), v.tolist()) for i, (k, v) in enumerate(zip(label, x, strict=True))], "contig_id long, label int, u array<double>")
    got = {r.contig_id: r.s for r in quality.silhouettes(table).collect()}
    for i in np.flatnonzero(label >= 0):
        d = np.linalg.norm(x - x[i], axis=1)
        mean = {k: d[(label == k) & (np.arange(700) != i)].mean() for k in set(label[label >= 0]) if ((label == k) & (np.arange(700) != i)).any()}
        own = mean.pop(label[i], None)
        want = 0.0 if own is None else (min(mean.values()) - own) / max(own, min(mean.values()))
        assert abs(got[i] - want) < 1e-6
    assert quality.silhouettes(table, 100).count() == 100
    assert quality.silhouette_reasons(table.where("label = 1")).first().reason == "a single bin" and quality.silhouette_reasons(table.where("label < 0")).first().reason == "no labelled rows"


def test_size_decides_between_exact_and_indexed(spark, monkeypatch):
    rows = spark.range(40).selectExpr("id AS contig_id", "array(double(id), double(id % 7)) AS vec")
    seen = []
    monkeypatch.setattr(neighbours, "knn_indexed", lambda q, r, k: seen.append(k) or neighbours.knn(q, r, k))
    exact = neighbours.knn_by_size(1600)(rows, rows, 3).count()
    assert not seen and neighbours.knn_by_size(1599)(rows, rows, 3).count() == exact == 120 and seen == [3]
