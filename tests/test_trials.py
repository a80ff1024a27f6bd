"""Settings of the vote stage tried together give what they give one by one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamwork.operators import quality, refine
from loamwork.operators.trials import Votes, vote_moves, vote_neighbours, vote_trials
from loamwork.plans.search import coarse_then_fine, search_rounds, tuned_votes
from loamwork.plans.workspace import settled

FIELDS = "contig_id long, label int, prob double, length long, u array<double>"
MIDDLE = Votes(6, 0.6, 2, 0.6)


@pytest.fixture(scope="module")
def rows(spark):
    rnd, out = np.random.default_rng(5), []
    centres = rnd.normal(size=(4, 6))
    for i in range(160):
        u = centres[i % 4] + rnd.normal(size=6) * 0.7
        out.append((i, -1 if i % 3 == 0 else i % 4, float(rnd.random()), int(rnd.integers(500, 5000)), (u / np.linalg.norm(u)).tolist()))
    return settled(spark.createDataFrame(out, FIELDS))


def _alone(rows, v):
    """Labels, metrics and verdict of one candidate by the stage itself."""
    after = refine.rescue_by_votes(rows, v.k, v.radius, v.support, v.agreement, 0.3)
    metrics = []
    for x in (rows, after):
        first = quality.indices(x).first()
        bp = x.agg(100 * F.sum(F.when(F.col("label") >= 0, F.col("length")).otherwise(0)) / F.sum("length")).first()[0]
        metrics.append({"n_clusters": first["n_clusters"], "calinski_harabasz": first["calinski_harabasz"], "assigned_bp_pct": bp})
    return {r.contig_id: r.label for r in after.collect()}, metrics[1], quality.judge(rows.sparkSession, *metrics)


def test_together_as_one_by_one(spark, rows):
    many = [MIDDLE, Votes(3, 0.9, 1, 0.5), Votes(6, 0.3, 2, 0.6), Votes(6, 0.6, 50, 0.6), MIDDLE]
    near = vote_neighbours(rows, 6, 0.3)
    moved = {(r.contig_id, c): r.label for r in vote_moves(near, many).collect() for c in r.candidates}
    got = {r.candidate: r for r in vote_trials(rows, near, many).collect()}
    assert got.keys() == set(range(5)) and got[4]["first"] == 0 and got[3].n_moved == 0 and got[3].score == pytest.approx(0, abs=1e-9)
    old = {r.contig_id: r.label for r in rows.collect()}
    for i, v in enumerate(many):
        labels, metrics, verdict = _alone(rows, v)
        assert labels == {k: moved.get((k, i), label) for k, label in old.items()}
        assert got[i].n_moved == sum(labels[k] != old[k] for k in old)
        for name, value in metrics.items():
            assert got[i][name] == pytest.approx(value)
        assert got[i].passed == verdict.passed and got[i].score == pytest.approx(verdict.score)
    assert got[0].n_moved > 0 and got[1].n_moved > got[2].n_moved


def test_nothing_to_move(spark, rows):
    for x in (rows.where("label >= 0"), rows.where("label < 0"), rows.limit(0)):
        near = vote_neighbours(x, 6, 0.3)
        assert near.count() == 0 and all(r.n_moved == 0 for r in vote_trials(x, near, [MIDDLE, MIDDLE]).collect())


def test_the_search_tries_rounds(spark, rows):
    best, table = tuned_votes(rows, MIDDLE, 0.3, budget=12)
    tried = [Votes(*(r[k] for k in ("k", "radius", "support", "agreement"))) for r in table]
    assert len(set(tried)) == len(tried) == 12 and tried[0] == MIDDLE
    value = lambda r: (r["passed"], r["score"])
    assert value(table[tried.index(best)]) == max(map(value, table))
    assert all(isinstance(r["at_boundary"], list) for r in table)


def test_rounds_are_few_and_find_what_single_calls_find():
    space, calls = {"a": [1, 2, 3, 4, 5], "b": [0.1, 0.5, 0.9], "c": [True, False]}, []
    f = lambda s: -((s["a"] - 2) ** 2) - (s["b"] - 0.3) ** 2 - s["c"]

    def together(many):
        calls.append(len(many))
        return list(map(f, many))

    best, score, trials = search_rounds(space, together)
    assert best == {"a": 2, "b": 0.3, "c": False} and score == pytest.approx(0) and len(calls) == 3 and sum(calls) == len(trials)
    assert coarse_then_fine(space, f)[:2] == (best, score)
    assert len(search_rounds(space, together, seconds=-1.0)[2]) == calls[3] and len(search_rounds(space, together, budget=1)[2]) == 1
