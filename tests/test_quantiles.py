"""Exact quantiles by narrowing, against sorted arrays and Spark's own."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamwork.operators import coverage, groups, quantiles

SHARES = {"low": 0.0, "quarter": 0.25, "half": 0.5, "most": 0.995, "top": 1.0}


def made():
    rnd = np.random.default_rng(2)
    return {
        ("a", 1): rnd.normal(0, 1e3, 1001), ("a", 2): np.round(rnd.normal(0, 2, 500)), ("b", 1): np.array([3.5]), ("b", 2): np.array([1.0, 2.0]), (None, 1): rnd.lognormal(0, 9, 777), ("c", 1): np.zeros(300),
        ("c", 2): np.concatenate([np.full(200, 7.0), rnd.normal(7, 1e-12, 200)]), ("d", 1): np.array([-0.0, 0.0, -1e-320, 1e-320, -5.0]), ("d", 2): np.array([np.inf, -np.inf, 1.0]),
    }


def test_narrowing_is_sorting(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "SMALL", 0)
    rows = [(*k, float(x)) for k, xs in made().items() for x in xs] + [("a", 1, None)]
    df = spark.createDataFrame(rows, "g string, h int, x double").repartition(5)
    out = quantiles.quantiles(df.where("g IS NOT NULL"), ["g", "h"], "x", SHARES)
    assert "percentile" not in out._jdf.queryExecution().toString() and "median" not in out._jdf.queryExecution().toString()
    got = {(r.g, r.h): r for r in out.collect()}
    for k, xs in made().items():
        if k[0] is not None and np.isfinite(xs).all():
            np.testing.assert_allclose([got[k][s] for s in SHARES], np.quantile(xs, list(SHARES.values())), rtol=1e-12, atol=0)
    assert [got["d", 2][s] for s in ("low", "half", "top")] == [-np.inf, 1.0, np.inf]


def test_both_ways_agree_in_their_users(spark, monkeypatch):
    rnd = np.random.default_rng(3)
    cov = spark.createDataFrame([(i, f"s{j}", float(max(0, rnd.normal(3, 4)))) for i in range(300) for j in range(3)], "contig_id long, sample string, depth double")
    rows = spark.createDataFrame([(i % 4, rnd.normal(0, 1, 3).tolist(), rnd.normal(0, 1, 5).tolist()) for i in range(200)], "label int, u array<double>, shape array<double>")

    def both():
        one = sorted(tuple(r) for r in coverage.caps(cov, 90.0).collect())
        two = sorted((r.label, *r.median, *r.sd) for r in groups.shape_models(rows).collect())
        three = sorted((r.label, r.radius) for r in groups.centroids(rows).collect())
        return one, two, three

    small = both()
    monkeypatch.setattr(quantiles, "SMALL", 0)
    for a, b in zip(small, both(), strict=True):
        assert [x[0] for x in a] == [x[0] for x in b]
        np.testing.assert_allclose([x[1:] for x in a], [x[1:] for x in b], rtol=1e-12)


@pytest.mark.parametrize("n", [0, 1])
def test_few_rows(spark, monkeypatch, n):
    monkeypatch.setattr(quantiles, "SMALL", -1)
    df = spark.range(n).select(F.lit("k").alias("k"), F.col("id").cast("double").alias("x"))
    assert [tuple(r) for r in quantiles.quantiles(df, ["k"], "x", {"half": 0.5}).collect()] == [("k", 0.0)] * n
