"""Quality rules: statistics of each text, and a decision list learned from labelled statistics.

The learner covers low-quality rows one rule at a time. It grows a conjunction of
thresholds by FOIL gain on two thirds of the labelled rows, prunes it on the rest, and
keeps it while it is precise there. The list becomes one ordered Spark expression.
"""

from __future__ import annotations

import itertools
import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamwork.llm.common import append_columns, check_columns, map_slices, texts_of

SYMBOLS = "#*$%&|<>"
_UPPER = re.compile("[A-ZÀ-ÖØ-ÞΑ-ΩА-Я]")
_WHITE = " \t\n\x0b\x0c\r"
#: Labelled rows that the learner sees at most, by lowest hash of doc_id.
MAX_ROWS = 20_000
#: A rule stands only with this share of low-quality rows among those it covers, pruning rows alone.
MIN_PRECISION = 0.8
MAX_RULES = 12
STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long, n_distinct long, n_marks long"
#: Ratios that rules may test: name, numerator, denominator.
RATIOS = {"symbol_ratio": ("n_symbols", "n_words"), "word_length": ("word_chars", "n_words"), "dup_line_ratio": ("n_dup_lines", "n_lines"), "repeat_ratio": ("n_repeat_words", "n_words"), "upper_ratio": ("n_upper", "word_chars"), "distinct_ratio": ("n_distinct", "n_words"), "mark_ratio": ("n_marks", "n_words"), "words": ("n_words", None)}


class TextStats:
    """Statistics of texts; words are numbered by a memo that is bounded by starting afresh."""

    def __init__(self, limit: int = 200_000):
        self.limit = limit
        self.memo: dict[bytes, int] = {}

    def repeat_words(self, words: list[bytes]) -> int:
        """Words inside three-word windows that occur at least twice."""
        n = len(words)
        if n < 4:
            return 0
        memo = self.memo
        if len(memo) > self.limit:
            memo.clear()
        ids = np.fromiter((memo.setdefault(w, len(memo)) for w in words), np.int64, n)
        if len(memo) >= 1 << 21:  # a text with millions of words: number its own, and its pairs
            ids = np.unique(ids, return_inverse=True)[1]
            key = np.unique(ids[:-2] << 31 | ids[1:-1], return_inverse=True)[1] << 31 | ids[2:]
        else:
            key = ids[:-2] << 42 | ids[1:-1] << 21 | ids[2:]
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        same = sorted_key[1:] == sorted_key[:-1]
        if not same.any():
            return 0
        twice = np.zeros(len(key), bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        covered = np.zeros(n, bool)
        for shift in range(3):
            covered[shift : shift + len(twice)] |= twice
        return int(covered.sum())

    def __call__(self, text: str) -> tuple[int, ...]:
        words = text.encode().split()  # bytes.split parts at exactly x20 and x09-x0d
        lines = [x for x in text.split("\n") if x.strip(_WHITE)]
        chars = len(text) - sum(map(text.count, _WHITE))
        upper = len(_UPPER.findall(text))
        return len(words), chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), self.repeat_words(words), len(lines), upper, len(set(words)), text.count("!")


@dataclass(frozen=True)
class Test:
    """One threshold test on a ratio."""

    name: str
    above: bool
    threshold: float

    def holds(self, rows: dict[str, np.ndarray]) -> np.ndarray:
        return rows[self.name] > self.threshold if self.above else rows[self.name] <= self.threshold

    def column(self, prefix: str = "") -> Column:
        value = ratio(self.name, prefix)
        return value > F.lit(self.threshold) if self.above else value <= F.lit(self.threshold)


def ratio(name: str, prefix: str = "") -> Column:
    """A ratio of statistics; with an empty denominator 0."""
    top, below = RATIOS[name]
    if below is None:
        return F.col(prefix + top).cast("double")
    return F.when(F.col(prefix + below) == 0, F.lit(0.0)).otherwise(F.col(prefix + top) / F.col(prefix + below))


def _covered(rule: list[Test], rows: dict[str, np.ndarray], size: int) -> np.ndarray:
    out = np.ones(size, bool)
    for t in rule:
        out &= t.holds(rows)
    return out


def _grow(rows: dict[str, np.ndarray], bad: np.ndarray, cuts: int = 48) -> list[Test]:
    rule: list[Test] = []
    inside = np.ones(len(bad), bool)
    while len(rule) < 4:
        p0, n0 = int((inside & bad).sum()), int((inside & ~bad).sum())
        if not p0 or not n0:
            break
        base, best = math.log2(p0 / (p0 + n0)), (0.0, None, None)
        for name, above in itertools.product(RATIOS, (True, False)):
            values = np.unique(rows[name][inside])
            at = np.unique(np.quantile(values, np.linspace(0, 1, cuts))) if len(values) > cuts else values
            for threshold in ((at[:-1] + at[1:]) / 2).tolist():
                test = Test(name, above, float(threshold))
                now = inside & test.holds(rows)
                p = int((now & bad).sum())
                gain = p * (math.log2(p / int(now.sum())) - base) if p else 0.0
                if gain > best[0] + 1e-9:
                    best = (gain, test, now)
        if best[1] is None:
            break
        rule.append(best[1])
        inside = best[2]
    return rule


def _worth(rule: list[Test], rows: dict[str, np.ndarray], bad: np.ndarray) -> tuple[float, int]:
    inside = _covered(rule, rows, len(bad))
    p, n = int((inside & bad).sum()), int((inside & ~bad).sum())
    return ((p - n) / (p + n) if p + n else -1.0), p


def learn(rows: dict[str, np.ndarray], bad: np.ndarray, order: np.ndarray) -> list[list[Test]]:
    """The rules of a decision list for bad rows; order is a hash that deals rows to growing and pruning."""
    rules: list[list[Test]] = []
    growing = order % 3 != 0
    left = np.ones(len(bad), bool)
    while len(rules) < MAX_RULES:
        g, v = left & growing, left & ~growing
        if not (bad & g).any():
            break
        rule = _grow({k: x[g] for k, x in rows.items()}, bad[g])
        check, truth = {k: x[v] for k, x in rows.items()}, bad[v]
        options = [rule[:k] for k in range(len(rule), 0, -1)]
        if not options:
            break
        rule = max(options, key=lambda r: (_worth(r, check, truth), -len(r)))
        value, hits = _worth(rule, check, truth)
        if not hits or (value + 1) / 2 < MIN_PRECISION:
            break
        rules.append(rule)
        left &= ~_covered(rule, rows, len(bad))
    return rules


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> pa.Table:
    """dealt, quality and ratios of at most max_rows labelled rows that pass the base rules, those with the lowest hashes.

    Rows that repeat an id share its label; the bound is one of rows.
    """
    sample = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sample = sample.withColumn("dealt", F.xxhash64("doc_id")).orderBy("dealt", "doc_id").limit(max_rows)
    known = statistics(docs.select("doc_id", "text").join(F.broadcast(sample.select("doc_id")), "doc_id"))
    names = [c.split()[0] for c in STATS.split(", ")]
    rows = known.where(~base_failed()).join(F.broadcast(sample), "doc_id").orderBy("dealt", "doc_id", *names).limit(max_rows)
    return rows.select("dealt", "quality", *(ratio(r).alias(r) for r in RATIOS)).toArrow()


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> list[list[Test]]:
    """Learns a list from at most max_rows labelled rows.

    labels has doc_id and quality (0: low); of several labels of a document the lowest
    counts. Without labels of both kinds the list is empty.
    """
    rows = training_rows(docs, labels, max_rows)
    if not rows.num_rows:
        return []
    return learn({r: rows.column(r).to_numpy() for r in RATIOS}, rows.column("quality").to_numpy() == 0, rows.column("dealt").to_numpy())


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of each whole text; null counts as empty."""
    check_columns(docs, "doc_id", "text")

    def make():
        stats, names = TextStats(), [c.split()[0] for c in STATS.split(",")]

        def apply(part):
            found = list(zip(*map(stats, texts_of(part)), strict=True)) or [()] * len(names)
            return {"doc_id": part.column("doc_id")} | dict(zip(names, found, strict=True))

        return apply

    return map_slices(docs.select("doc_id", "text"), make, f"doc_id long, {STATS}")


def base_failed(prefix: str = "") -> Column:
    """Too few words, or most of them in repeated windows."""
    words, repeated = F.col(prefix + "n_words"), F.col(prefix + "n_repeat_words")
    return (words < 50) | (100 * repeated > 50 * words)


def verdict(rules: list[list[Test]], prefix: str = "") -> Column:
    """The list as one ordered conditional expression: true keeps."""
    out = F.lit(True)
    for rule in reversed(rules):
        condition = F.lit(True)
        for t in rule:
            condition &= t.column(prefix)
        out = F.when(condition, F.lit(False)).otherwise(out)
    return out


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Statistics, base_failed and kept of every document.

    Null and empty texts have no words and fail the base rules; repeated rows are judged
    one by one; other columns are ignored; an empty table gives no rows.
    """
    kept = ~base_failed() & verdict(fit(docs, labels))
    return statistics(docs).withColumn("base_failed", base_failed()).withColumn("kept", kept)


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that base rules and the learned list keep, with all their columns; nothing is shuffled.

    All columns pass through, whatever their names. Null and empty texts go; an empty table stays empty.
    """
    rules, prefix = fit(docs, labels), "q_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix += "_"
    names = [prefix + c.split()[0] for c in STATS.split(", ")]
    added = ", ".join(f"{n} long" for n in names)

    def make():
        stats = TextStats()

        def apply(part):
            found = list(zip(*map(stats, texts_of(part)), strict=True)) or [()] * len(names)
            return dict(zip(names, found, strict=True))

        return apply

    kept = ~base_failed(prefix) & verdict(rules, prefix)
    return append_columns(docs, make, added).where(kept).select(*docs.columns)
