"""Encoders of one modality, their fusion, and the influence of each modality."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import groupby, islice
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamwork.functions import vectors as V
from loamwork.operators import groups as G

_STATE = "modality string, state binary"


def hidden_width(d: int) -> int:
    """M1: hidden units for d inputs."""
    return int(np.clip(4 * d, 32, 512))


@dataclass
class Vae:
    """M1-M3: one hidden layer (linear, layer norm, ReLU), Gaussian latent, linear decoder; Adam, cosine rate, KL annealing."""

    latent: int = 8
    epochs: int = 30
    batch: int = 256
    rate: float = 1e-3
    beta: float = 0.1
    anneal: int = 10
    free_bits: float = 0.01
    seed: int = 0

    def start(self, mean: np.ndarray) -> Vae:
        """Parameters before training, for rows of that mean."""
        d = len(mean)
        h, k, self.rng = hidden_width(d), self.latent, np.random.default_rng(self.seed)
        init = lambda i, o: self.rng.normal(0, np.sqrt(2 / i), (i, o))
        self.p = {"w1": init(d, h), "b1": np.zeros(h), "g": np.ones(h), "s": np.zeros(h), "wm": init(h, k) * 0.5, "bm": np.zeros(k), "wv": init(h, k) * 0.1, "bv": np.zeros(k), "wd": init(k, d) * 0.5, "bd": mean.astype(float)}
        self.m, self.v = ({a: np.zeros_like(b) for a, b in self.p.items()} for _ in range(2))
        self.t = 0
        return self

    def steps(self, n: int) -> int:
        return max(1, -(-n // self.batch)) * self.epochs

    def step(self, x: np.ndarray, w: np.ndarray, epoch: int, steps: int) -> None:
        """One batch of an epoch; steps is the number of all batches of all epochs."""
        grads = self._gradients(x, w, self.beta * min(1.0, (epoch + 1) / max(1, self.anneal)), self.rng)
        size = np.sqrt(sum((g**2).sum() for g in grads.values()))
        self.t += 1
        rate = self.rate * 0.5 * (1 + np.cos(np.pi * self.t / steps))
        for a, g in grads.items():
            g = g / max(1.0, size)  # clipped to norm one
            self.m[a] = 0.9 * self.m[a] + 0.1 * g
            self.v[a] = 0.999 * self.v[a] + 0.001 * g * g
            self.p[a] -= rate * (self.m[a] / (1 - 0.9**self.t)) / (np.sqrt(self.v[a] / (1 - 0.999**self.t)) + 1e-8)

    def fit(self, x: np.ndarray, w: np.ndarray | None = None) -> Vae:
        n = len(x)
        w = np.ones(n) if w is None else w
        self.start(x.mean(0))
        for epoch in range(self.epochs):
            order = self.rng.permutation(n)
            for at in range(0, n, self.batch):
                i = order[at : at + self.batch]
                self.step(x[i], w[i], epoch, self.steps(n))
        return self

    def _hidden(self, x: np.ndarray):
        a = x @ self.p["w1"] + self.p["b1"]
        sd = np.sqrt(a.var(1, keepdims=True) + 1e-5)
        z = (a - a.mean(1, keepdims=True)) / sd
        y = z * self.p["g"] + self.p["s"]
        return z, sd, y, np.maximum(y, 0)

    def _gradients(self, x, w, beta, rng) -> dict[str, np.ndarray]:
        p, n = self.p, len(x)
        z, sd, y, h = self._hidden(x)
        mu, raw = h @ p["wm"] + p["bm"], h @ p["wv"] + p["bv"]
        lv = np.clip(raw, -10, 10)
        eps, std = rng.normal(size=mu.shape), np.exp(0.5 * lv)
        q = mu + eps * std
        diff = (q @ p["wd"] + p["bd"] - x) * w[:, None] * 2 / (n * x.shape[1])
        dq = diff @ p["wd"].T
        kl = 0.5 * (mu**2 + np.exp(lv) - lv - 1)
        active = (kl.mean(0) > self.free_bits) * beta / n
        dmu = dq + active * mu
        dlv = (dq * eps * 0.5 * std + active * 0.5 * (np.exp(lv) - 1)) * (np.abs(raw) < 10)
        dy = (dmu @ p["wm"].T + dlv @ p["wv"].T) * (y > 0)
        dz = dy * p["g"]
        da = (dz - dz.mean(1, keepdims=True) - z * (dz * z).mean(1, keepdims=True)) / sd
        return {"wd": q.T @ diff, "bd": diff.sum(0), "wm": h.T @ dmu, "bm": dmu.sum(0), "wv": h.T @ dlv, "bv": dlv.sum(0), "g": (dy * z).sum(0), "s": dy.sum(0), "w1": x.T @ da, "b1": da.sum(0)}

    def encode(self, x: np.ndarray) -> np.ndarray:
        return self._hidden(x)[3] @ self.p["wm"] + self.p["bm"]

    def loss(self, x: np.ndarray) -> float:
        return float(((self.encode(x) @ self.p["wd"] + self.p["bd"] - x) ** 2).mean())


def train(rows: DataFrame, model: Vae, train_rows: int | None = None) -> dict[str, Vae]:
    """M3, M4: a model of each modality (rows: modality, contig_id, vec), trained by batches of all its rows.

    An epoch is a pass in an order of its own; a modality's rows stream through one task,
    which holds a batch. train_rows, where given, takes only so many rows, by lowest hash.
    """
    rows = rows.select("modality", "contig_id", "vec")
    if train_rows is not None:
        order = Window.partitionBy("modality").orderBy(F.xxhash64("contig_id"), "contig_id")
        rows = rows.withColumn("k", F.row_number().over(order)).where(F.col("k") <= train_rows).drop("k")
    n = {r["modality"]: r["n"] for r in rows.groupBy("modality").agg(F.count("*").alias("n")).collect()}
    models = {r["modality"]: replace(model).start(np.array(r["mean"])) for r in G.means(rows, "modality").collect()}

    def one(epoch: int) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            stream = (r for b in batches for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
            for name, group in groupby(stream, itemgetter(0)):
                m = models[name]
                while part := [v for _, v in islice(group, m.batch)]:
                    m.step(np.array(part, float), np.ones(len(part)), epoch, m.steps(n[name]))
                yield pa.RecordBatch.from_arrays([pa.array([name], pa.string()), pa.array([pickle.dumps(m)], pa.binary())], names=["modality", "state"])

        return rows.repartition("modality").sortWithinPartitions("modality", F.xxhash64(F.lit(epoch), "contig_id"), "contig_id").select("modality", "vec").mapInArrow(run, _STATE)

    for epoch in range(model.epochs):
        models = {r["modality"]: pickle.loads(r["state"]) for r in one(epoch).collect()}
    return models


def encode(rows: DataFrame, model: Vae, train_rows: int | None = None, vec: str = "vec") -> DataFrame:
    """M3: contig_id, mu: a model trained on all rows (contig_id, vec), or on train_rows of them, and applied to all."""
    trained = train(rows.select(F.lit("").alias("modality"), "contig_id", F.col(vec).alias("vec")), model, train_rows)
    model.__dict__ |= vars(trained.get("", model))
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                mu = shared.value.encode(np.array(b.column(1).to_pylist(), float))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(mu.tolist(), pa.list_(pa.float64()))], names=["contig_id", "mu"])

    return rows.select(F.col("contig_id").cast("long").alias("contig_id"), vec).mapInArrow(run, "contig_id long, mu array<double>")


def principal_components(rows: DataFrame, k: int, vec: str = "vec") -> DataFrame:
    """A linear baseline behind the same interface: contig_id, mu by PCA of all rows."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    v = rows.select("contig_id", array_to_vector(vec).alias("v"))
    return PCA(k=k, inputCol="v", outputCol="m").fit(v).transform(v).select("contig_id", vector_to_array("m").alias("mu"))


def gates(reliabilities: dict[str, Column], scores: dict[str, Column] | None = None) -> dict[str, Column]:
    """M5: each modality's share: softmax of its score plus the log of its reliability; a modality of reliability 0 gets nothing."""
    raw = {m: F.exp((scores or {}).get(m, F.lit(0.0))) * F.greatest(r, F.lit(0.0)) for m, r in reliabilities.items()}
    total = sum(raw.values(), F.lit(0.0))
    return {m: F.when(total > 0, x / total).otherwise(1.0 / len(raw)) for m, x in raw.items()}


def fused(vectors: dict[str, Column], shares: dict[str, Column]) -> Column:
    """M5: the gated sum of projected modalities of equal width."""
    out = None
    for m, v in vectors.items():
        scaled = F.zip_with(v, F.array_repeat(shares[m], F.size(v)), lambda a, b: a * b)
        out = scaled if out is None else F.zip_with(out, scaled, lambda a, b: a + b)
    return out


def influence(rows: DataFrame, vectors: dict[str, str], reliabilities: dict[str, str]) -> DataFrame:
    """M7: modality, influence: how far the fused vector moves without it, over its mean length, as shares of one."""
    col = lambda d: {m: F.col(c) for m, c in d.items()}
    whole = fused(col(vectors), gates(col(reliabilities)))
    x = rows.withColumn("whole", whole)
    moved = []
    for m in vectors:
        rest = {k: v for k, v in vectors.items() if k != m}
        without = fused(col(rest), gates({k: F.col(reliabilities[k]) for k in rest}))
        moved.append((F.avg(V.distance(F.col("whole"), without)) / F.avg(V.norm(F.col("whole")))).alias(m))
    total = sum((F.col(m) for m in vectors), F.lit(0.0))
    return x.agg(*moved).select(F.explode(F.array(*(F.struct(F.lit(m).alias("modality"), (F.col(m) / total).alias("influence")) for m in vectors))).alias("r")).select("r.*")


def split_coverage(features: Column, n_samples_as_feature: bool = False) -> tuple[Column, Column]:
    """(weight, features) of a coverage row [valid_mask, n_samples_present, mean_dist, std_dist, cov...]."""
    first = 2 if n_samples_as_feature else 3
    return F.element_at(features, 1), F.slice(features, first, F.size(features) - (first - 1))


def encode_modalities(rows: DataFrame, model: Vae, train_rows: int | None = None) -> DataFrame:
    """M4: modality, contig_id, mu: each modality (rows: modality, contig_id, vec) is trained in a task of its own.

    All rows train it, or train_rows of each modality; its parameters then encode all rows.
    """
    models = train(rows, model, train_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            mus = [models[m].encode(np.array([v], float))[0].tolist() for m, v in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.string()), b.column(1), pa.array(mus, pa.list_(pa.float64()))], names=["modality", "contig_id", "mu"])

    return rows.select("modality", F.col("contig_id").cast("long").alias("contig_id"), "vec").mapInArrow(run, "modality string, contig_id long, mu array<double>")


def learn_gates(mus: dict[str, np.ndarray], reliabilities: dict[str, np.ndarray], steps: int = 100, rate: float = 0.5, entropy: float = 0.01) -> dict[str, float]:
    """M6: global gate scores on frozen latents: each modality is read back from the fused vector by ridge regression.

    The loss is the reliability-weighted squared error less an entropy bonus; scores
    follow its numerical gradient, which has one entry a modality.
    """
    names = sorted(mus)
    scores = np.zeros(len(names))
    x = np.stack([mus[m] for m in names])
    r = np.stack([np.clip(reliabilities[m], 0, None) for m in names])

    def loss(s: np.ndarray) -> float:
        g = np.exp(s)[:, None] * r
        g = g / np.maximum(g.sum(0), 1e-12)
        z = (g[:, :, None] * x).sum(0)
        inverse = np.linalg.inv(z.T @ z + np.eye(z.shape[1]))
        error = sum((w[:, None] * (z @ (inverse @ (z.T @ y)) - y) ** 2).mean() for y, w in zip(x, r, strict=True))
        p = np.exp(s) / np.exp(s).sum()
        return float(error + entropy * (p * np.log(p + 1e-12)).sum())

    for _ in range(steps):
        base = loss(scores)
        gradient = np.array([(loss(scores + 1e-4 * e) - base) / 1e-4 for e in np.eye(len(names))])
        scores = np.clip(scores - rate * gradient, -10, 10)
    return dict(zip(names, (scores - scores.mean()).tolist(), strict=True))
