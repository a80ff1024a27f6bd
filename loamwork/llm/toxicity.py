"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamwork.llm.common import check_columns, map_slices, texts_of, tidy

BITS = 20
#: Labelled rows that the model is fitted on at most, by lowest hash of doc_id.
MAX_ROWS = 12_000
EPOCHS = 4
#: L1 strengths to choose from.
PENALTIES = (2.0, 5.0, 10.0, 20.0, 40.0, 80.0, 160.0)
_WORD = re.compile(r"\w+")


class WordHash(dict):
    """32-bit hashes of lower-cased words; bounded by starting afresh."""

    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        h = self[word] = zlib.crc32(word.encode())
        return h


def features(text: str, memo: WordHash, bits: int = BITS) -> np.ndarray:
    """The distinct slots of a text's words, word pairs, and pairs with one word between."""
    words = _WORD.findall(text.lower())
    h = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    one = h * np.uint64(0x9E3779B97F4A7C15)
    two, three = h * np.uint64(0xC2B2AE3D27D4EB4F), h * np.uint64(0x165667B19E3779F9)
    every = np.concatenate([one, one[:-1] ^ two[1:], one[:-2] ^ three[2:]])
    every ^= every >> np.uint64(29)
    return np.unique((every * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - bits)).astype(np.uint32))


class Ftrl:
    """Per-coordinate FTRL-proximal: w is zero where |z| stays under l1."""

    def __init__(self, bits: int = BITS, alpha: float = 0.3, beta: float = 1.0, l1: float = 1.5, l2: float = 0.5):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z = self.z[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, at: np.ndarray, label: int, weight: float = 1.0) -> None:
        at = np.append(at, len(self.z) - 1)  # the last coordinate is the bias
        w = self.weights(at)
        g = weight * (1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label)
        self.z[at] += g - (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha * w
        self.n[at] += g * g


def _train(examples: list[tuple[np.ndarray, int]], l1: float, bits: int, epochs: int) -> tuple[np.ndarray, np.ndarray, float]:
    model, positive = Ftrl(bits, l1=l1), sum(y for _, y in examples)
    heavy = min(8.0, (len(examples) - positive) / max(1, positive))
    for epoch in range(epochs):
        for i in np.random.default_rng(epoch).permutation(len(examples)):
            at, label = examples[i]
            model.learn(at, label, heavy if label else 1.0)
    w = model.weights(slice(None))
    slots = np.flatnonzero(w[:-1])
    return slots.astype(np.uint32), w[slots], float(w[-1])


def _loss(model: tuple[np.ndarray, np.ndarray, float], examples: list[tuple[np.ndarray, int]], bits: int) -> float:
    dense = np.zeros(1 << bits)
    dense[model[0]] = model[1]
    total = np.array([model[2] + dense[at].sum() for at, _ in examples])
    label = np.array([y for _, y in examples])
    return float(np.logaddexp(0, np.where(label == 1, -total, total)).mean())


def fit(examples: list[tuple[np.ndarray, int]], bits: int = BITS, epochs: int = EPOCHS, spark: SparkSession | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """(slots, weights, bias) of the coordinates that are not zero. Without both labels the bias alone decides.

    The L1 strength comes from PENALTIES by log loss on every fourth example; with spark,
    each strength is tried in a task of its own.
    """
    positive = sum(y for _, y in examples)
    if not positive or positive == len(examples):
        return np.zeros(0, np.uint32), np.zeros(0), 4.0 if positive else -4.0
    losses = _losses(spark, examples, bits, epochs) if spark else [_validated(examples, l1, bits, epochs) for l1 in PENALTIES]
    return _train(examples, PENALTIES[int(np.argmin(losses))], bits, epochs)


def _validated(examples: list[tuple[np.ndarray, int]], l1: float, bits: int, epochs: int) -> float:
    """The log loss on every fourth example of a model of the others."""
    return _loss(_train([x for i, x in enumerate(examples) if i % 4], l1, bits, epochs), examples[::4], bits)


def _losses(spark: SparkSession, examples: list[tuple[np.ndarray, int]], bits: int, epochs: int) -> list[float]:
    """_validated() of each of PENALTIES, a task each; the examples are as bounded as the training rows."""
    shared = spark.sparkContext.broadcast((np.concatenate([x for x, _ in examples]), [len(x) for x, _ in examples], [y for _, y in examples]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, sizes, labels = shared.value
            known = list(zip(np.split(flat, np.cumsum(sizes)[:-1]), labels, strict=True))
            for k in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_pydict({"id": [k], "loss": [_validated(known, PENALTIES[k], bits, epochs)]})

    found = spark.range(0, len(PENALTIES), 1, len(PENALTIES)).mapInArrow(tidy(run), "id long, loss double").collect()
    shared.unpersist()
    return [r["loss"] for r in sorted(found, key=lambda r: r["id"])]


def held_out(doc: str = "doc_id"):
    """crc32 of the decimal doc_id modulo five is zero."""
    return F.crc32(F.col(doc).cast("string").cast("binary")) % 5 == 0


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> list[tuple[np.ndarray, int]]:
    """Features and labels of at most max_rows labelled rows that are not held out, in hash order; rows that repeat an id share its label."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = known.withColumn("dealt", F.xxhash64("doc_id")).orderBy("dealt", "doc_id").limit(max_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample.select("doc_id")), "doc_id")

    def make():
        memo = WordHash()
        return lambda part: {"doc_id": part.column("doc_id"), "slots": [features(t, memo).tobytes() for t in texts_of(part)]}

    found = map_slices(rows, make, "doc_id long, slots binary").join(F.broadcast(sample), "doc_id").orderBy("dealt", "doc_id", "slots").limit(max_rows).select("slots", "toxic").toArrow()
    return [(np.frombuffer(s, np.uint32), int(y)) for s, y in zip(found.column("slots").to_pylist(), found.column("toxic").to_pylist(), strict=True)]


def score(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted of every document.

    Only words make features. Null and empty texts get the score of the bias. A document
    without a label is scored all the same; repeated rows get equal scores; an empty
    table gives no rows.
    """
    check_columns(docs, "doc_id", "text")
    shared = docs.sparkSession.sparkContext.broadcast(fit(training_rows(docs, labels, max_rows), spark=docs.sparkSession))

    def make():
        slots, weights, bias = shared.value
        dense, memo = np.zeros(1 << BITS), WordHash()
        dense[slots] = weights

        def apply(part):
            total = [bias + float(dense[features(t, memo)].sum()) for t in texts_of(part)]
            return {"doc_id": part.column("doc_id"), "score": 1 / (1 + np.exp(-np.clip(np.array(total), -35, 35)))}

        return apply

    out = map_slices(docs.select("doc_id", "text"), make, "doc_id long, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
