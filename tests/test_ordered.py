"""Places, running sums and statistics of a whole order against plain Python."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from loamwork.operators import assembly, bins
from loamwork.operators.ordered import running


def test_running_sums_are_brute_force(spark):
    rnd = random.Random(1)
    values = rnd.sample(range(10_000), 700)
    rows = spark.createDataFrame([(v, v % 7) for v in values], "v long, w long").repartition(5)
    got = {r.v: (r.place, r.run) for r in running(rows, [F.desc("v")], {"place": F.lit(1), "run": F.col("w")}).collect()}
    run, want = 0, {}
    for k, v in enumerate(sorted(values, reverse=True), 1):
        run += v % 7
        want[v] = (k, run)
    assert got == want


def test_no_rows(spark):
    none = spark.createDataFrame([], "length long, label int")
    assert running(none, [F.asc("length")], {"place": F.lit(1)}).count() == 0
    assert assembly.assembly_stats(none).count() == 0
    assert bins.size_gini("length", none).first()[0] == 0.0


@pytest.mark.parametrize("n", [1, 2, 200, 201])
def test_statistics_are_brute_force(spark, n):
    rnd = random.Random(n)
    lengths = [rnd.choice([150, 400, 400, rnd.randint(0, 3000)]) for _ in range(n)]
    got = assembly.assembly_stats(spark.createDataFrame([(x,) for x in lengths], "length long")).first()
    run, l50 = 0, 0
    for l50, x in enumerate(sorted(lengths, reverse=True), 1):
        run += x
        if run * 2 >= sum(lengths):
            break
    assert (got.n50, got.l50, got.n_contigs, got.total_bp) == (x, l50, n, sum(lengths))
    assert got.median_len == statistics.median(lengths) and got.lt_500 == sum(v < 500 for v in lengths)


def test_gini_with_ties(spark):
    sizes = [5, 5, 5, 9, 1, 1, 30]
    got = bins.size_gini("s", spark.createDataFrame([(x,) for x in sizes], "s long")).first()[0]
    pairs = sum(abs(a - b) for a in sizes for b in sizes) / (2 * len(sizes) * sum(sizes))
    assert got == pytest.approx(pairs)


def test_no_window_over_all_rows(spark):
    rows = spark.createDataFrame([(3, 1), (4, 2)], "length long, label int")
    for table in (assembly.n50(rows, []), bins.dense_ids(rows)):
        plan = table._jdf.queryExecution().executedPlan().toString()
        assert plan.count("SinglePartition") <= 3  # totals of ranges, one-row aggregates
