"""Density clustering on tables against brute force over all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamwork.operators import density, forest, neighbours
from tests import density_twin


def groups():
    """Blobs in noise, one blob, a lattice with many equal distances, too few points, equal points."""
    rnd = np.random.default_rng(5)
    blobs = np.concatenate([rnd.normal(c, 0.2, (25, 3)) for c in (0, 1.5, 3)] + [rnd.uniform(-2, 5, (20, 3))])
    return [blobs, rnd.normal(0, 1, (70, 3)), np.round(rnd.normal(0, 1, (60, 2))) @ np.ones((2, 3)), rnd.normal(0, 1, (3, 3)), np.zeros((12, 3))]


def table(spark, xs):
    rows = [(g, 1000 * g + i, v.tolist()) for g, x in enumerate(xs) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "g int, contig_id long, vec array<double>")


def same_parts(a, b):
    """Equal but for the names of clusters."""
    return len(set(a)) == len(set(b)) == len(set(zip(a, b, strict=True))) and [x < 0 for x in a] == [x < 0 for x in b]


@pytest.mark.parametrize("how", [{"method": "eom"}, {"method": "leaf"}, {"method": "eom", "max_cluster": 30}, {"method": "leaf", "epsilon": 0.6}], ids=str)
def test_all_groups_at_once_are_brute_force(spark, how):
    xs = groups()
    got = {r.contig_id: (r.part, r.prob) for r in density.cluster(table(spark, xs), "g", 5, 3, neighbours=100, **how).collect()}
    assert len(got) == sum(map(len, xs))
    for g, x in enumerate(xs):
        part, prob = zip(*(got[1000 * g + i] for i in range(len(x))), strict=True)
        want, want_prob = density_twin.labels(x, 5, 3, **how)
        assert same_parts(part, want.tolist()), g
        np.testing.assert_allclose(prob, want_prob, atol=1e-9)


def test_few_neighbours_and_pieces_far_apart(spark):
    """The neighbour graph falls into pieces, which are tied by the nearest points outside."""
    rnd = np.random.default_rng(6)
    x = np.concatenate([rnd.normal(c, 0.3, (40, 2)) for c in ((0, 0), (9, 0), (0, 30), (50, 50))])
    points, edges = density.reach_graph(table(spark, [x]), "g", 4, neighbours=6)
    tree = {(r.x, r.y): r.w for r in forest.spanning_forest(points, edges).collect()}
    want = density_twin.tree_edges(x, 4)
    assert len(tree) == len(x) - 1 and sum(tree.values()) == pytest.approx(sum(w for w, _, _ in want), rel=0.01)
    assert sorted(tree.values())[-3:] == pytest.approx([w for w, _, _ in want][-3:])
    got = [r.part for r in density.cluster(table(spark, [x]), "g", 10, 4, "eom", neighbours=6).orderBy("contig_id").collect()]
    assert same_parts(got, density_twin.labels(x, 10, 4)[0].tolist())


def test_search_by_the_index(spark):
    rnd = np.random.default_rng(7)
    x = np.concatenate([rnd.normal(c, 0.3, (60, 4)) for c in (0, 3, 6)])
    got = [r.part for r in density.cluster(table(spark, [x]), "g", 10, 4, "eom", search=neighbours.knn_indexed).orderBy("contig_id").collect()]
    assert all(len({p for p in got[i * 60 : i * 60 + 60] if p >= 0}) == 1 for i in range(3)) and len(set(got) - {-1}) == 3


def test_neighbours_inside_groups(spark, monkeypatch):
    xs = groups()[:2]
    monkeypatch.setattr(neighbours, "BLOCK", 16)
    df = table(spark, xs)
    got = {}
    for r in neighbours.knn_within(df, "g", 4, df.where("contig_id % 3 = 0")).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.ref_id))
    for g, x in enumerate(xs):
        for i in range(0, len(x)):
            if (1000 * g + i) % 3 == 0:
                d = np.linalg.norm(x - x[i], axis=1)
                d[i] = np.inf
                assert [ref for _, ref in sorted(got[1000 * g + i])] == [1000 * g + int(j) for j in np.argsort(d, kind="stable")[:4]]


def test_roots_of_long_paths(spark):
    links = spark.range(1, 300).select(F.col("id").alias("comp"), (F.col("id") - 1).alias("parent"))
    assert {(r.comp, r.root) for r in forest.roots(links).collect()} == {(i, 0) for i in range(1, 300)}


def test_no_rows_and_lone_points(spark):
    assert density.cluster(table(spark, []), "g", 5, 3).count() == 0
    assert {r.part for r in density.cluster(table(spark, [np.zeros((1, 2)), np.ones((1, 2))]), "g", 2, 1).collect()} == {-1}


def test_parameters():
    assert density.auto_params(100) == (5, 2) and density.auto_params(10**6) == (50, 20)
