"""Tree ensembles as flat arrays: scoring, and exact interventional Shapley values.

A forest is a handful of parallel node arrays; its output is ``base`` plus the sum,
over trees, of the value of the leaf that a row reaches. It comes from the booster
(``boost``) or from a fitted Spark ML tree model, is small (its size follows from the
number of trees and their depth, not from the data) and travels to tasks by broadcast.

Shapley values (interventional: features outside a coalition take a background
row's values). For a row x and a background row b a leaf is reached under
coalition S iff every feature on its path has its condition met by x (if the feature
is in S) or by b (if not). Features that both meet do not matter; p features that
only x meets must be in S, q that only b meets must not. The leaf's value v then
adds v (p-1)! q! / (p+q)! to each of the first and takes v p! (q-1)! / (p+q)! from
each of the others; no coalition is scored. For a row and a background row a walk
goes down each tree, parts where they disagree on a feature for the first time, and so
visits only the leaves that some coalition reaches, a number that depends on the depth.
Contributions of a row add up to its output less the mean output of the background.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CELLS = 1 << 21  # of one working array
WAYS = 1 << 16  # walked at once
ROWS = 256  # explained at once


@dataclass(frozen=True)
class Forest:
    feature: np.ndarray  # of each node; -1 is a leaf
    threshold: np.ndarray  # a row goes left where its value is <= threshold
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray  # of leaves
    roots: np.ndarray
    base: float = 0.0

    def score(self, x: np.ndarray) -> np.ndarray:
        """Output of every row of ``x``."""
        out = np.full(len(x), self.base)
        step = max(1, CELLS // max(1, len(self.roots)))
        for at in range(0, len(x), step):
            part = x[at:at + step]
            node = np.tile(self.roots, len(part))
            row, way = np.repeat(np.arange(len(part)), len(self.roots)), np.arange(len(node))
            while len(way):  # the ways that have not reached a leaf yet
                here = node[way]
                f = self.feature[here]
                way, here, row, f = (a[f >= 0] for a in (way, here, row, f))
                node[way] = np.where(part[row, f] <= self.threshold[here], self.left[here], self.right[here])
            node = node.reshape(len(part), -1)
            out[at:at + step] += self.value[node].sum(axis=1)
        return out

    def depth(self) -> int:
        """Splits on the longest path."""
        at, n = self.roots, 0
        while len(at := at[self.feature[at] >= 0]):
            at, n = np.concatenate((self.left[at], self.right[at])), n + 1
        return n

    def walks(self) -> "Walks":
        """The forest as :class:`Walks` reads it."""
        n = len(self.feature)
        inner = np.flatnonzero(self.feature >= 0)
        parent, is_left = np.full(n, -1), np.zeros(n, bool)
        parent[self.left[inner]] = parent[self.right[inner]] = inner
        is_left[self.left[inner]] = True
        low, high = np.full(n, -np.inf), np.full(n, np.inf)
        at, above = inner, inner
        while len(at):  # all nodes look one ancestor higher
            went_left, above = is_left[above], parent[above]
            kept = above >= 0
            at, above, went_left = at[kept], above[kept], went_left[kept]
            same = self.feature[above] == self.feature[at]
            a, b = same & went_left, same & ~went_left
            high[at[a]] = np.minimum(high[at[a]], self.threshold[above[a]])
            low[at[b]] = np.maximum(low[at[b]], self.threshold[above[b]])
        child = np.stack((self.right, self.left), axis=1).astype(np.int32).ravel()
        order = inner[np.lexsort((self.threshold[inner], self.feature[inner]))]
        f, t = self.feature[order], self.threshold[order]
        new = np.concatenate(([True], (f[1:] != f[:-1]) | (t[1:] != t[:-1])))[:len(order)]
        f, t = f[new], t[new]  # all cuts, feature by feature
        width = int(f.max(initial=-1)) + 1
        first = np.searchsorted(f, np.arange(width + 1))
        edges = [t[a:z] for a, z in zip(first, first[1:])]
        kind = np.uint8 if max(map(len, edges), default=0) < 255 else np.uint16
        cut, least, most = (np.zeros(n, kind) for _ in range(3))
        f_in = self.feature[order]
        cut[order] = np.cumsum(new) - 1 - first[f_in]
        most[:] = np.iinfo(kind).max
        for j in range(width):
            mine = order[f_in == j]
            lo, hi = low[mine], high[mine]
            least[mine] = np.where(lo == -np.inf, 0, np.searchsorted(edges[j], lo) + 1)
            most[mine[hi < np.inf]] = np.searchsorted(edges[j], hi[hi < np.inf])
        return Walks(self.feature.astype(np.int16), cut, least, most, edges, child, self.value, self.roots.astype(np.int32), self.depth())

    def leaves(self) -> "Leaves":
        """Every leaf's path as intervals, one for each feature on it."""
        feature, low, high, size, value = [], [], [], [], []
        todo = [(int(r), {}) for r in self.roots]
        while todo:
            i, box = todo.pop()
            f = int(self.feature[i])
            if f < 0:
                if self.value[i] != 0.0:
                    feature += box.keys()
                    low += [b[0] for b in box.values()]
                    high += [b[1] for b in box.values()]
                    size.append(len(box))
                    value.append(float(self.value[i]))
                continue
            a, b = box.get(f, (-math.inf, math.inf))
            t = float(self.threshold[i])
            todo.append((int(self.left[i]), {**box, f: (a, min(b, t))}))
            todo.append((int(self.right[i]), {**box, f: (max(a, t), b)}))
        return Leaves(np.array(feature, np.int64), np.array(low), np.array(high), np.array(size, np.int64), np.array(value))

    def importance(self, gain: np.ndarray, n_features: int) -> np.ndarray:
        """Shares of the nodes' ``gain`` by feature."""
        inner = self.feature >= 0
        total = np.bincount(self.feature[inner], gain[inner], n_features)
        return total / total.sum() if total.sum() else total


@dataclass(frozen=True)
class Leaves:
    feature: np.ndarray  # of each path entry, leaf after leaf
    low: np.ndarray  # the entry holds where low < value <= high
    high: np.ndarray
    size: np.ndarray  # path entries of each leaf
    value: np.ndarray

    def shapley(self, x: np.ndarray, background: np.ndarray) -> np.ndarray:
        """[row, feature]: mean over the background rows of the exact contributions."""
        n_features = x.shape[1]
        out = np.zeros((len(x), n_features))
        plus, minus = _coalition_weights(int(self.size.max(initial=0)) + 1)
        ends = np.cumsum(self.size)
        whole = self.size > 0  # a tree that is one leaf adds nothing
        for first in _parts(self.size, CELLS // 16):
            leaf = np.arange(*first)[whole[first[0]:first[1]]]
            if not len(leaf):
                continue
            a, b = int(ends[leaf[0]] - self.size[leaf[0]]), int(ends[leaf[-1]])
            feature, starts = self.feature[a:b], (ends - self.size)[leaf] - a
            of_leaf = np.repeat(np.arange(len(leaf)), self.size[leaf])
            holds = lambda rows: (rows[:, feature] > self.low[a:b]) & (rows[:, feature] <= self.high[a:b])
            order = np.argsort(feature, kind="stable")
            groups = np.flatnonzero(np.diff(feature[order], prepend=-1))
            step = max(1, CELLS // (b - a))
            for at in range(0, len(x), step):
                mine = holds(x[at:at + step])
                for theirs in holds(background):
                    p = np.add.reduceat(mine & ~theirs, starts, axis=1, dtype=np.int64)
                    q = np.add.reduceat(~mine & theirs, starts, axis=1, dtype=np.int64)
                    dead = np.add.reduceat(~mine & ~theirs, starts, axis=1, dtype=np.int64) > 0
                    v = np.where(dead, 0.0, self.value[leaf])
                    add = (v * plus[p, q])[:, of_leaf] * (mine & ~theirs) - (v * minus[p, q])[:, of_leaf] * (~mine & theirs)
                    out[at:at + step, feature[order][groups]] += np.add.reduceat(add[:, order], groups, axis=1)
        return out / max(1, len(background))


@dataclass(frozen=True)
class Walks:
    """Shapley values by walks of (row, background row) pairs down the trees. A walk parts in two where
    the pair disagrees on a feature for the first time, so it comes only to leaves that a coalition reaches.
    Values are compared by their places among the cuts of their feature, in a byte or two. What leaves add
    is summed up along the way back, once for each feature that parted ways."""
    feature: np.ndarray
    cut: np.ndarray  # place of the node's threshold among ``edges``
    least: np.ndarray  # a node is reached with least <= place of the value of its feature <= most
    most: np.ndarray
    edges: list  # the cuts of each feature
    child: np.ndarray  # right and left child of each node
    value: np.ndarray
    roots: np.ndarray
    depth: int

    def _places(self, x: np.ndarray) -> np.ndarray:
        """How many cuts of its feature each value is above (NaN: all)."""
        out = np.zeros(x.shape, self.cut.dtype)
        for j, cuts in enumerate(self.edges):
            if len(cuts):
                out[:, j] = np.searchsorted(cuts, x[:, j], side="left")
        return out.ravel()

    def shapley(self, x: np.ndarray, background: np.ndarray) -> np.ndarray:
        """[row, feature]: mean over the background rows of the exact contributions."""
        if len(x) > ROWS:  # a bounded number of entries at once
            return np.concatenate([self.shapley(x[at:at + ROWS], background) for at in range(0, len(x), ROWS)])
        n_back, out = len(background), np.zeros(x.size)
        plus, minus = _coalition_weights(self.depth + 1)
        weight, deep = (plus - 1j * minus).ravel(), len(plus)
        here, back = self._places(x), self._places(background)
        pairs = np.arange(len(x) * n_back, dtype=np.int32)
        step = max(1, WAYS // max(1, 32 * len(pairs)))
        trees = self.roots[self.feature[self.roots] >= 0]  # a tree that is one leaf adds nothing
        for at in range(0, len(trees) if len(pairs) else 0, step):  # neighbouring ways are of one tree
            roots = trees[at:at + step]
            row, of = (np.tile(a, len(roots)) * np.int32(x.shape[1]) for a in (pairs // n_back, pairs % n_back))
            log, node = _Log(), np.repeat(roots, len(pairs))
            todo = [(row, of, node, self.feature[node], np.full(len(row), -1, np.int32), np.zeros(len(row), np.int32))]
            while todo:
                now = todo.pop()
                if len(now[0]) > WAYS:  # a bounded number of ways at once
                    half = len(now[0]) // 2
                    todo += [tuple(a[half:] for a in now), tuple(a[:half] for a in now)]
                    continue
                now = self._stepped(here, back, now, log, weight, deep)
                if len(now[0]):
                    todo.append(now)
            log.add_up(out)
        return out.reshape(x.shape) / max(1, n_back)

    def _stepped(self, x, background, ways, log: "_Log", weight, deep):
        """All ways one node on; those that come to leaves log their value and end. Of each way: first cells of
        its row and background row, node and its feature, newest entry of the log, and p * deep + q."""
        row, of, node, feature, last, many = ways
        cut, a, b = self.cut[node], x[row + feature], background[of + feature]
        mine, theirs = a <= cut, b <= cut
        after = self.child[2 * node + mine]
        part = np.flatnonzero(mine != theirs)
        at, a, b = node[part], a[part], b[part]
        least, most = self.least[at], self.most[at]
        by_x = (a >= least) & (a <= most)  # the way to here: x may have gone it
        by_b = (b >= least) & (b <= most)
        over = self.child[2 * at + theirs[part]]
        other = by_b & ~by_x
        after[part[other]] = over[other]
        both = np.flatnonzero(by_x & by_b)
        fork = part[both]
        if len(fork):
            entry = log.add(last[fork], row[fork], feature[fork])
            new = (row[fork], of[fork], over[both], entry + np.int32(len(fork)), many[fork] + np.int32(1))
            last[fork], many[fork] = entry, many[fork] + np.int32(deep)
            row, of, after, last, many = (np.concatenate(pair) for pair in zip((row, of, after, last, many), new))
        feature = self.feature[after]
        ends = feature < 0
        done = np.flatnonzero(ends & (last >= 0))
        if len(done):
            log.leave(last[done], self.value[after[done]] * weight[many[done]])
        on = np.flatnonzero(~ends)
        return tuple(a[on] for a in (row, of, after, feature, last, many))


class _Log:
    """Features that parted ways: the entries of the ways of x and, behind them, of the background rows. Each
    gathers what the leaves below it add to a feature of x (real) and to one of the background row (imaginary)."""

    def __init__(self):
        self.n, size = 0, 1 << 16
        self.before, self.cell, self.sum = np.zeros(size, np.int32), np.zeros(size, np.int32), np.zeros(size, complex)
        self.blocks: list[tuple[int, int, int]] = []

    def add(self, before: np.ndarray, row: np.ndarray, feature: np.ndarray) -> np.ndarray:
        """Entries of the ways of x; those of the background rows follow them."""
        k, n = len(before), self.n
        while n + 2 * k > len(self.before):
            self.before, self.cell, self.sum = (np.concatenate((a, np.zeros_like(a))) for a in (self.before, self.cell, self.sum))
        self.before[n:n + k] = self.before[n + k:n + 2 * k] = before
        self.cell[n:n + k] = self.cell[n + k:n + 2 * k] = row + feature
        self.blocks.append((n, n + k, n + 2 * k))
        self.n += 2 * k
        return np.arange(n, n + k, dtype=np.int32)

    def leave(self, entry: np.ndarray, add: np.ndarray) -> None:
        """Leaves below different entries: no entry is the newest of two ways."""
        self.sum[entry] += add

    def add_up(self, out: np.ndarray) -> None:
        """Sums of later entries go to those before them, then all to the cells of ``out``."""
        add = np.empty(self.n)
        for a, middle, z in reversed(self.blocks):
            add[a:middle], add[middle:z] = self.sum[a:middle].real, self.sum[middle:z].imag
            above = self.before[a:middle]  # the two ways of a fork have the same entry before
            on = np.flatnonzero(above >= 0)
            self.sum[above[on]] += (self.sum[a:middle] + self.sum[middle:z])[on]
        out += np.bincount(self.cell[:self.n], add, len(out))


def _parts(size: np.ndarray, cells: int) -> list[tuple[int, int]]:
    """Ranges of leaves with about ``cells`` path entries each."""
    part = np.cumsum(size) // max(1, cells)
    cut = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(size)]
    return [(a, b) for a, b in zip(cut, cut[1:]) if b > a]


def _coalition_weights(deep: int) -> tuple[np.ndarray, np.ndarray]:
    """Weight of one of the p (plus) or q (minus) features, by [p, q]."""
    fact = [math.factorial(k) for k in range(deep + 1)]
    plus = np.array([[fact[p - 1] * fact[q] / fact[p + q] if 0 < p and p + q <= deep else 0.0 for q in range(deep)] for p in range(deep)])
    minus = np.array([[fact[p] * fact[q - 1] / fact[p + q] if 0 < q and p + q <= deep else 0.0 for q in range(deep)] for p in range(deep)])
    return plus, minus


def of_spark(spark: SparkSession, model, path: str) -> Forest:
    """The forest of a fitted Spark ML tree classifier or regressor, read from the node table that
    its writer stores below ``path``. A forest's output is its probability of class 1;
    boosted trees give half the margin that Spark's probability doubles."""
    model.write().overwrite().save(path)
    meta = spark.read.parquet(f"{path}/data")
    many = "treeID" in meta.columns
    nodes = meta.select(F.col("treeID") if many else F.lit(0).alias("treeID"), *(["nodeData.*"] if many else ["*"]))
    rows = nodes.select("treeID", "id", "prediction", "impurityStats", "leftChild", "rightChild",
                        F.col("split.featureIndex").alias("f"), F.col("split.leftCategoriesOrThreshold").alias("t"),
                        F.col("split.numCategories").alias("c")).toPandas()  # the model: bounded by trees and depth
    if (rows["c"] > 0).any():
        raise ValueError("splits on categories are not supported")
    rows = rows.sort_values(["treeID", "id"], kind="stable").reset_index(drop=True)
    first = rows.groupby("treeID")["id"].idxmin()
    start = rows["treeID"].map(first).to_numpy()  # ids of a tree count from 0 without gaps
    inner = (rows["leftChild"] >= 0).to_numpy()
    weights = list(getattr(model, "treeWeights", [1.0]))
    boosted = type(model).__name__.startswith("GBT")
    if boosted:
        value = rows["prediction"].to_numpy(float) * np.array(weights)[rows["treeID"].to_numpy()]
    else:
        value = np.array([s[1] / sum(s) if len(s) > 1 and sum(s) else p for s, p in zip(rows["impurityStats"], rows["prediction"])]) / len(first)
    return Forest(np.where(inner, rows["f"], -1).astype(np.int64),
                  np.array([t[0] if k else 0.0 for t, k in zip(rows["t"], inner)]),
                  np.where(inner, start + rows["leftChild"], 0).astype(np.int64),
                  np.where(inner, start + rows["rightChild"], 0).astype(np.int64),
                  np.where(inner, 0.0, value), first.to_numpy().astype(np.int64))


def _matrix(values: pd.Series, width: int) -> np.ndarray:
    return np.stack(values.to_numpy()).astype(np.float64) if len(values) else np.zeros((0, width))


def scored(df: DataFrame, forest: Forest, features: str, out: str, width: int) -> DataFrame:
    """``df`` with the forest's output of the vector column ``features``, one Arrow batch at a time."""
    shared = df.sparkSession.sparkContext.broadcast(forest)

    @F.pandas_udf(T.DoubleType())
    def of(v: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score(_matrix(v, width)))

    return df.withColumn(out, of(vector_to_array(F.col(features))))


def tree_shapley(df: DataFrame, forest: Forest, names: list[str], background: list[list[float]], key: str = "page_id",
                 features: str = "features", only: list[str] | None = None) -> DataFrame:
    """(key, feature, contribution, base_value): exact contributions of every row to the forest's
    output against the background rows; ``only`` keeps those of some features. No shuffle."""
    kept = [names.index(n) for n in (only or names)]
    back = np.array(background, float).reshape(-1, len(names))
    base = float(forest.score(back).mean()) if len(back) else forest.base
    shared = df.sparkSession.sparkContext.broadcast((forest.walks(), back))

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def of(v: pd.Series) -> pd.Series:
        walks, b = shared.value
        return pd.Series(list(walks.shapley(_matrix(v, len(names)), b)[:, kept]))

    x = df.select(key, of(vector_to_array(F.col(features))).alias("_phi"))
    labels = F.array(*[F.lit(names[k]) for k in kept])
    pairs = F.arrays_zip(labels.alias("feature"), F.col("_phi").alias("contribution"))
    return x.select(key, F.explode(pairs).alias("_z")).select(key, "_z.feature", "_z.contribution", F.lit(base).alias("base_value"))
