"""The quality gate over stages, and the search of stage parameters under it."""

from __future__ import annotations

import hashlib
import itertools
import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamwork.operators.neighbours import knn
from loamwork.operators.quality import Tolerance, Verdict, judge
from loamwork.operators.trials import Votes, vote_neighbours, vote_trials


def label_key(rows: DataFrame) -> str:
    """A digest of a label vector that doesn't depend on row order: counts and hash sums by label."""
    s = rows.agg(F.count("*").alias("n"), F.sum(F.xxhash64("contig_id", "label").cast("decimal(38,0)")).alias("h")).first()
    return hashlib.sha256(f"{s['n']}:{s['h']}".encode()).hexdigest()


@dataclass
class Gate:
    """Q8: a stage's labels are accepted if the judge passes them, else the labels from before stay.

    metrics(rows) gives the metric columns; equal label vectors are measured once.
    """

    metrics: Callable[[DataFrame], dict]
    enabled: bool = True
    cache: dict[str, dict] = field(default_factory=dict)
    log: list[dict] = field(default_factory=list)

    def measure(self, rows: DataFrame) -> dict:
        key = label_key(rows)
        if key not in self.cache:
            self.cache[key] = self.metrics(rows)
        return self.cache[key]

    def step(self, name: str, before: DataFrame, stage: Callable[[DataFrame], DataFrame], gated: bool = True, tolerance: Tolerance = Tolerance()) -> DataFrame:
        after = stage(before)
        v: Verdict = judge(before.sparkSession, self.measure(before), self.measure(after), tolerance)
        use = v.passed or not (gated and self.enabled)
        self.log.append({"stage": name, "passed": v.passed, "used": use, "score": v.score, "reasons": "; ".join(v.reasons)})
        return after if use else before


def search_rounds(space: dict[str, list], evaluate: Callable[[list[dict]], list[float]], budget: int = 40, seconds: float = 2400.0, combos: int = 8) -> tuple[dict, float, list[tuple[dict, float]]]:
    """Q7: (best settings, score, all trials), where evaluate scores all new settings of a round at once.

    Three rounds: one parameter at a time in turn around the middle; the value between the
    best two of each; a grid of the best two. Neither budget nor time is passed; the middle
    is always tried. Of equal scores the first tried wins.
    """
    start, tried, trials = time.monotonic(), {}, []
    name = lambda settings: tuple(sorted(settings.items()))
    middle = {k: v[len(v) // 2] for k, v in space.items()}

    def go(wanted: Iterable[dict]) -> None:
        fresh = list({name(x): x for x in wanted if name(x) not in tried}.values())[: max(0, budget - len(trials)) if trials else max(1, budget)]
        if fresh and (not trials or time.monotonic() - start <= seconds):
            for settings, score in zip(fresh, evaluate(fresh), strict=True):
                tried[name(settings)] = score
                trials.append((dict(settings), score))

    score = lambda k, v: tried.get(name(middle | {k: v}), float("-inf"))
    ranked = lambda: {k: sorted(values[k], key=lambda v: -score(k, v)) for k in space}
    values = {k: list(v) for k, v in space.items()}
    deepest = max(map(len, space.values()), default=0)
    go([middle, *(middle | {k: v[level]} for level in range(deepest) for k, v in space.items() if level < len(v))])  # in turn, so that a budget is shared
    for k, (a, b) in ((k, v[:2]) for k, v in ranked().items() if len(v) > 1):
        if all(isinstance(x, (int, float)) and not isinstance(x, bool) for x in (a, b)):
            half = (a + b) / 2
            values[k].append(int(half) if isinstance(a, int) and isinstance(b, int) else half)
    go(middle | {k: v[-1]} for k, v in values.items())
    go(dict(zip(space, v, strict=True)) for v in itertools.islice(itertools.product(*(v[:2] for v in ranked().values())), combos))
    best = max(trials, key=lambda t: t[1])
    return *best, trials


def coarse_then_fine(space: dict[str, list], evaluate: Callable[[dict], float], budget: int = 40, seconds: float = 2400.0, combos: int = 8) -> tuple[dict, float, list[tuple[dict, float]]]:
    """Q7: search_rounds() for what can only score one setting at a time."""
    return search_rounds(space, lambda many: [evaluate(x) for x in many], budget, seconds, combos)


def tuned_votes(rows: DataFrame, middle: Votes, ref_prob: float, search: Callable[..., DataFrame] = knn, tolerance: Tolerance = Tolerance(), budget: int = 40) -> tuple[Votes, list[dict]]:
    """Q7: the settings of the vote stage that the judge scores best, and the table of all trials.

    Every round is one plan over the same neighbours. Settings that fail the judge rank
    behind all others, and a round's settings that give the same labels are scored as one.
    """
    space = {"k": _spread(middle.k), "radius": [0.8 * middle.radius, middle.radius, 1.25 * middle.radius], "support": _spread(middle.support), "agreement": sorted({max(0.05, middle.agreement - 0.15), middle.agreement, min(1.0, middle.agreement + 0.15)})}
    near, table = vote_neighbours(rows, max(space["k"]), ref_prob, search), []

    def evaluate(many: list[dict]) -> list[float]:
        got = {r["candidate"]: r.asDict() for r in vote_trials(rows, near, [Votes(**x) for x in many], tolerance).collect()}  # a row a candidate
        scores = []
        for i, settings in enumerate(many):
            row = got.get(i) or {"passed": False, "score": float("-inf"), "first": i}
            table.append(settings | row | {"at_boundary": at_boundary(settings, space)})
            scores.append(row["score"] if row["passed"] else row["score"] - 1e9)
        return scores

    best, _, _ = search_rounds(space, evaluate, budget)
    return Votes(**best), table


def _spread(value: int) -> list[int]:
    return sorted({max(1, value // 2), value, 2 * value})


def at_boundary(settings: dict, space: dict[str, list]) -> list[str]:
    """Q7: parameters whose best value is an end of their range."""
    return [k for k, v in settings.items() if len(space[k]) > 1 and v in (min(space[k]), max(space[k]))]


def stage_table(log: Iterable[dict]) -> list[dict]:
    """Q8: the gate's log with the change of each stage's score."""
    out, before = [], 0.0
    for row in log:
        out.append(row | {"change": row["score"] - before})
        before = row["score"]
    return out
