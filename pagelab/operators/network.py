"""Mini-batch ReLU networks, trained data-parallel in one barrier stage.

Rows are dealt to ``workers`` tasks by the hash of their key; each task keeps its share
as a matrix and takes Adam steps over mini-batches of it. Every ``sync_every`` steps, and
at the end of each epoch, ``allGather`` hands all weights and Adam moments to all tasks,
which go on from their mean, weighted by the rows behind them (parameter averaging: a
barrier of Spark takes a second, so gradients of single steps are not exchanged). With
one worker, which up to ``rows_per_worker`` rows have, it is plain mini-batch Adam.
Orders, dropout masks and first weights follow from the seed, so a stage that Spark runs
again after a lost task gives the same network.

A synchronisation sends three times the weights' size from and to each task, which bounds
``workers`` to tens; the rows of a task must fit its memory (4 bytes a number).
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import BarrierTaskContext
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelab.operators.forest import _matrix

EPSILON, MOMENTUM = 1e-3, 0.99  # of batch normalisation


@dataclass(frozen=True)
class Layer:
    """A dense ReLU layer; then normalised over the batch, then thinned out."""
    units: int
    normalise: bool = False
    dropout: float = 0.0


class Net:
    """Weights of dense layers and one sigmoid output as one flat vector."""

    def __init__(self, width: int, layers: list[Layer], seed: int = 42):
        self.width, self.layers = width, list(layers)
        self.shapes, n = [], width
        for x in self.layers:
            self.shapes += [(n, x.units), (x.units,)] + ([(x.units,), (x.units,)] if x.normalise else [])
            n = x.units
        self.shapes += [(n, 1), (1,)]
        rng, parts = np.random.default_rng(seed), []
        for s in self.shapes:
            if len(s) == 2:  # Glorot's uniform range
                parts.append(rng.uniform(-1, 1, s) * np.sqrt(6 / sum(s)))
            else:
                parts.append(np.zeros(s))
        i = 0
        for x in self.layers:
            if x.normalise:
                parts[i + 2] = np.ones(x.units)
            i += 4 if x.normalise else 2
        self.weights = np.concatenate([p.ravel() for p in parts])
        self.moments = [(np.zeros(x.units), np.ones(x.units)) for x in self.layers if x.normalise]

    def parts(self, flat: np.ndarray) -> list[np.ndarray]:
        out, at = [], 0
        for s in self.shapes:
            n = int(np.prod(s))
            out.append(flat[at:at + n].reshape(s))
            at += n
        return out

    def forward(self, x: np.ndarray, training: bool = False, rng: np.random.Generator | None = None):
        """(P(class 1), what the backward pass needs, batch moments of the normalised layers)."""
        w, held, moments, i, m = self.parts(self.weights), [], [], 0, 0
        for layer in self.layers:
            z = x @ w[i] + w[i + 1]
            a = np.maximum(z, 0.0)
            scale = unit = None
            if layer.normalise:
                mean, var = (a.mean(axis=0), a.var(axis=0)) if training else self.moments[m]
                scale = 1 / np.sqrt(var + EPSILON)
                unit = (a - mean) * scale
                a = unit * w[i + 2] + w[i + 3]
                moments.append((mean, var))
                m += 1
            mask = None
            if training and layer.dropout and rng is not None:
                mask = (rng.random(a.shape) >= layer.dropout) / (1 - layer.dropout)
                a = a * mask
            held.append((x, z, unit, scale, mask, i))
            x, i = a, i + (4 if layer.normalise else 2)
        out = 1 / (1 + np.exp(-np.clip((x @ w[i] + w[i + 1])[:, 0], -500, 500)))
        return out, (held, x, i), moments

    def gradient(self, x: np.ndarray, y: np.ndarray, rng: np.random.Generator | None = None):
        """(sum over the rows of the gradients of the cross entropy, batch moments)."""
        p, (held, last, i), moments = self.forward(x, True, rng)
        w = self.parts(self.weights)
        grads = [np.zeros(s) for s in self.shapes]
        d = (p - y)[:, None]
        grads[i], grads[i + 1] = last.T @ d, d.sum(axis=0)
        d = d @ w[i].T
        for layer, (below, z, unit, scale, mask, i) in zip(reversed(self.layers), reversed(held)):
            if mask is not None:
                d = d * mask
            if layer.normalise:
                grads[i + 2], grads[i + 3] = (d * unit).sum(axis=0), d.sum(axis=0)
                g = d * w[i + 2]
                d = scale * (g - g.mean(axis=0) - unit * (g * unit).mean(axis=0))
            d = d * (z > 0)
            grads[i], grads[i + 1] = below.T @ d, d.sum(axis=0)
            d = d @ w[i].T
        return np.concatenate([g.ravel() for g in grads]), moments


class Adam:
    def __init__(self, size: int, rate: float):
        self.rate, self.m, self.v, self.t = rate, np.zeros(size), np.zeros(size), 0

    def step(self, weights: np.ndarray, g: np.ndarray) -> np.ndarray:
        self.t += 1
        self.m += 0.1 * (g - self.m)
        self.v += 0.001 * (g * g - self.v)
        return weights - self.rate * (self.m / (1 - 0.9 ** self.t)) / (np.sqrt(self.v / (1 - 0.999 ** self.t)) + 1e-7)


def train(net: Net, x: np.ndarray, y: np.ndarray, epochs: int, batch: int, rate: float, seed: int, sync_every: int = 256,
          rank: int = 0, workers: int = 1, gather=None) -> Net:
    """Train on this worker's rows; ``gather`` hands every worker's text to all, in order."""
    adam = Adam(len(net.weights), rate)
    longest = max(int(n) for n in gather(str(len(x)))) if workers > 1 else len(x)
    steps = -(-longest // batch)
    for epoch in range(epochs):
        order, used = np.random.default_rng([seed, epoch, rank]).permutation(len(x)), 0
        for step in range(steps):
            rows = order[step * batch:(step + 1) * batch]
            if len(rows):
                g, moments = net.gradient(x[rows].astype(np.float64), y[rows], np.random.default_rng([seed, epoch, rank, step]))
                net.weights = adam.step(net.weights, g / len(rows))
                net.moments = [(MOMENTUM * a + (1 - MOMENTUM) * c, MOMENTUM * b + (1 - MOMENTUM) * d)
                               for (a, b), (c, d) in zip(net.moments, moments)]
                used += len(rows)
            if workers > 1 and ((step + 1) % sync_every == 0 or step + 1 == steps):
                _average(net, adam, used, gather)
                used = 0
    return net


def _average(net: Net, adam: Adam, used: int, gather) -> None:
    """Weights and moments become the mean over all workers, weighted by the rows they used."""
    state = [net.weights, adam.m, adam.v, *(v for pair in net.moments for v in pair)]
    flat = np.concatenate([*state, [adam.t]]) * used
    text = base64.b64encode(np.append(flat, used).astype("<f4").tobytes()).decode()
    total = np.sum([np.frombuffer(base64.b64decode(t), "<f4").astype(np.float64) for t in gather(text)], axis=0)
    if total[-1] == 0:
        return
    mean, at, out = total[:-1] / total[-1], 0, []
    for v in state:
        out.append(mean[at:at + len(v)])
        at += len(v)
    net.weights, adam.m, adam.v = out[:3]
    net.moments = list(zip(out[3::2], out[4::2]))
    adam.t = int(round(mean[-1]))


class ReluNetwork:
    """Estimator with the setters that the other learners of this package have."""

    def __init__(self, layers: list[Layer], epochs: int = 15, batch: int = 128, rate: float = 0.001, workers: int = 4,
                 rows_per_worker: int = 20_000, sync_every: int = 256, seed: int = 42, key: str = "page_id"):
        self.layers, self.epochs, self.batch, self.rate = list(layers), epochs, batch, rate
        self.workers, self.rows_per_worker, self.sync_every = workers, rows_per_worker, sync_every
        self.seed, self.key = seed, key
        self.features, self.label = "features", "label"

    def setFeaturesCol(self, c):
        self.features = c
        return self

    def setLabelCol(self, c):
        self.label = c
        return self

    def fit(self, df: DataFrame) -> "ReluNetworkModel":
        x = df.select(F.col(self.key).cast("string").alias("k"), F.col(self.label).cast("double").alias("y"),
                      vector_to_array(F.col(self.features)).alias("x"))
        head = x.select(F.size("x").alias("n")).first()
        if head is None:
            raise ValueError("no rows to fit")
        width, net = head["n"], Net(head["n"], self.layers, self.seed)
        workers = max(1, min(self.workers, -(-x.count() // self.rows_per_worker)))
        options = (self.epochs, self.batch, self.rate, self.seed, self.sync_every)

        def run(rows: Iterator) -> Iterator[tuple]:
            context = BarrierTaskContext.get()
            mine = sorted(rows, key=lambda r: (r["k"] is None, r["k"], r["y"], r["x"]))  # an order that a rerun repeats
            m = np.array([r["x"] for r in mine], np.float32).reshape(-1, width)
            done = train(net, m, np.array([r["y"] for r in mine]), *options, context.partitionId(), workers, context.allGather)
            if context.partitionId() == 0:
                yield 0, (done.weights, done.moments)

        # as many partitions as asked for: a plain hash partitioning, which is not coalesced. A barrier
        # stage can run again only if it feeds a shuffle, so the one result takes one.
        trained = x.repartition(workers, "k").rdd.barrier().mapPartitions(run).partitionBy(1)
        weights, moments = trained.values().collect()[0]
        net.weights, net.moments = weights, moments
        return ReluNetworkModel(net, self.features)


class ReluNetworkModel:
    def __init__(self, net: Net, features: str):
        self.net, self.features = net, features

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with the probability vector and the prediction (0.5 goes to class 0)."""
        shared, width = df.sparkSession.sparkContext.broadcast(self.net), self.net.width

        @F.pandas_udf(T.DoubleType())
        def of(v: pd.Series) -> pd.Series:
            return pd.Series(shared.value.forward(_matrix(v, width))[0])

        x = df.withColumn("_p", of(vector_to_array(F.col(self.features))))
        x = x.withColumn("probability", array_to_vector(F.array(1 - F.col("_p"), F.col("_p"))))
        return x.withColumn("prediction", (F.col("_p") > 0.5).cast("double")).drop("_p")

    def save(self, spark, path: str) -> None:
        """Weights and layers as one line of text (their size is the network's)."""
        n = self.net
        state = {"width": n.width, "layers": [[x.units, x.normalise, x.dropout] for x in n.layers], "weights": n.weights.tolist(),
                 "moments": [[a.tolist(), b.tolist()] for a, b in n.moments], "features": self.features}
        spark.createDataFrame([(json.dumps(state),)], "value string").write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark, path: str) -> "ReluNetworkModel":
        s = json.loads(spark.read.parquet(path).first()["value"])
        net = Net(s["width"], [Layer(*x) for x in s["layers"]])
        net.weights, net.moments = np.array(s["weights"]), [(np.array(a), np.array(b)) for a, b in s["moments"]]
        return cls(net, s["features"])
