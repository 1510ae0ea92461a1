"""Random forests on binned features, all trees grown together as Spark jobs.

Columns are cut into at most 32 bins at quantiles and stored in blocks (``boost``). A tree
sees every row as often as a Poisson(1) draw from a hash of the row's place and the tree says; each
node tries ceil(sqrt(columns)) random columns and takes the cut with the largest drop of the
Gini impurity; a node without a drop is a leaf. Two leaves of one parent that predict the same
class are merged. These are the rules of Spark ML's forest. What differs is where the work runs:

* Nodes of more than ``region_rows`` rows are split by sums over the blocks, level by level and all
  trees in one pass. There are few such nodes, so the sums stay small and only splits reach the driver.
* Then each row is sent to the nodes it has reached, and every node's subtree is grown by one task
  from its own rows, at most ``region_rows``. No sums of small nodes are ever sent. (Spark ML sums
  every node of every level over all partitions, which in deep trees costs more than the rows themselves.)

The fitted forest holds 18 bytes a node on the driver; scoring broadcasts it.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import (HasFeaturesCol, HasLabelCol, HasPredictionCol, HasProbabilityCol, HasRawPredictionCol,
                                     HasSeed)
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, \
    MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelab.operators.boost import Tree, _mixed, _node_of, _unpack, cut_points, stored_blocks
from pagelab.operators.forest import Forest, scored

BINS = 32
REGION_ROWS = 65_536  # rows of which one task grows a subtree
BLOCK_ROWS = 5_000
CELLS = 1 << 20  # histogram cells worked on at once
LEAST = 1e-12  # drops of impurity below are rounding
POISSON = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(12)])
PACK = float(1 << 26)  # two counts in one number: all + PACK * ones


def _times(block: int, rows: int, seed: int, tree: int) -> np.ndarray:
    """How often the tree sees each row of a block."""
    place = np.arange(rows, dtype=np.uint64) + np.uint64(block * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    return np.searchsorted(POISSON, _mixed(place, seed * 1_000_003 + tree), side="right").astype(np.uint8)


def _tried(seed: int, tree: int, node: int, width: int) -> np.ndarray:
    """The columns that a node of the upper levels tries."""
    return np.sort(np.random.default_rng([seed, tree, node]).choice(width, math.ceil(math.sqrt(width)), replace=False))


def _sums(bins: np.ndarray, rows: np.ndarray, packed: np.ndarray, node: np.ndarray, tried: np.ndarray) -> np.ndarray:
    """[node, tried column, bin] of packed counts of the rows, which lie in nodes numbered from 0."""
    k = tried.shape[1]
    code = (node[:, None] * k + np.arange(k)) * BINS + bins[rows[:, None], tried[node]]
    return np.bincount(code.ravel(), np.repeat(packed, k), len(tried) * k * BINS).reshape(len(tried), k, BINS)


def _best(sums: np.ndarray, least_rows: int = 1) -> tuple[np.ndarray, ...]:
    """Of each node: drop of impurity, place of the tried column, bin, (all, ones) left of the cut and of the node."""
    run = np.cumsum(sums, axis=2)
    ones = np.floor(run / PACK)
    n = run - ones * PACK
    n_all, n_ones = n[:, 0, -1], ones[:, 0, -1]
    m, m_ones = n_all[:, None, None] - n, n_ones[:, None, None] - ones
    with np.errstate(divide="ignore", invalid="ignore"):
        kept = (ones * ones + (n - ones) ** 2) / n + (m_ones * m_ones + (m - m_ones) ** 2) / m
    kept[(n < least_rows) | (m < least_rows)] = -np.inf
    at = kept.reshape(len(sums), -1).argmax(axis=1)
    line = np.arange(len(sums))
    column, cut = at // BINS, at % BINS
    drop = (kept[line, column, cut] - (n_ones ** 2 + (n_all - n_ones) ** 2) / n_all) / n_all
    return drop, column, cut, n[line, column, cut], ones[line, column, cut], n_all, n_ones


def _subtree(bins: np.ndarray, times: np.ndarray, ones: np.ndarray, depth: int, least_rows: int, rng) -> tuple[np.ndarray, ...]:
    """A tree of the given rows, level by level: feature (-1: leaf), bin, left child (the right one
    is its neighbour), share of ones, and the drop of impurity times the rows."""
    width = bins.shape[1]
    k = math.ceil(math.sqrt(width))
    packed = times + PACK * times * ones
    rows, node, n_nodes, made = np.arange(len(bins)), np.zeros(len(bins), np.int64), 1, 1
    levels = []
    for level in range(depth + 1):
        total = np.bincount(node, packed[rows], n_nodes)
        n_ones = np.floor(total / PACK)
        n = total - n_ones * PACK
        feature, cut, left, drop = np.full(n_nodes, -1, np.int16), np.zeros(n_nodes, np.uint8), np.zeros(n_nodes, np.int32), np.zeros(n_nodes)
        levels.append((feature, cut, left, n_ones, n, drop))
        live = np.flatnonzero((n_ones > 0) & (n_ones < n))
        if level == depth or not len(live):
            break
        tried = np.sort(np.argpartition(rng.random((len(live), width), np.float32), k - 1, axis=1)[:, :k], axis=1)
        new = np.full(n_nodes, -1)
        new[live] = np.arange(len(live))
        on = new[node] >= 0
        rows, node = rows[on], new[node[on]]
        order = np.argsort(node, kind="stable")
        rows, node = rows[order], node[order]
        step = max(1, CELLS // (k * BINS))
        for a in range(0, len(live), step):
            z = min(len(live), a + step)
            lo, hi = np.searchsorted(node, (a, z))
            mine = rows[lo:hi]
            d, c, b, *_ = _best(_sums(bins, mine, packed[mine], node[lo:hi] - a, tried[a:z]), least_rows)
            good = np.flatnonzero(d > LEAST)
            at = live[a:z][good]
            feature[at], cut[at] = tried[a + good, c[good]], b[good]
            drop[at] = d[good] * n[at]
        split = np.flatnonzero(feature >= 0)
        left[split] = made + 2 * np.arange(len(split))
        made += 2 * len(split)
        own = live[node]
        on = feature[own] >= 0
        rows, own = rows[on], own[on]
        child = np.full(n_nodes, -1)
        child[split] = 2 * np.arange(len(split))
        node = child[own] + (bins[rows, feature[own]] > cut[own])
        n_nodes = 2 * len(split)
        if not n_nodes:
            break
    return _merged(*[np.concatenate(a) for a in zip(*levels)], [len(x[0]) for x in levels])


def _merged(feature, cut, left, n_ones, n, drop, sizes):
    """The tree without leaves whose sibling is a leaf of the same prediction."""
    says = n_ones > n - n_ones
    ends = np.cumsum(sizes)
    for a, z in zip((ends - sizes)[::-1], ends[::-1]):
        at = a + np.flatnonzero(feature[a:z] >= 0)
        low = left[at]
        at = at[(feature[low] < 0) & (feature[low + 1] < 0) & (says[low] == says[low + 1])]
        feature[at] = -1
    seen = np.zeros(len(feature), bool)
    seen[0] = True
    for a, z in zip(ends - sizes, ends):
        low = left[a:z][seen[a:z] & (feature[a:z] >= 0)]
        seen[low] = seen[low + 1] = True
    place = np.cumsum(seen) - 1
    left = np.where(feature >= 0, place[left], 0).astype(np.int32)
    drop[feature < 0] = 0
    return feature[seen], cut[seen], left[seen], (n_ones / n)[seen], drop[seen]


class _ForestParams(HasFeaturesCol, HasLabelCol, HasPredictionCol, HasProbabilityCol, HasRawPredictionCol, HasSeed):
    numTrees = Param(Params._dummy(), "numTrees", "trees", TypeConverters.toInt)
    maxDepth = Param(Params._dummy(), "maxDepth", "levels of splits", TypeConverters.toInt)
    minInstancesPerNode = Param(Params._dummy(), "minInstancesPerNode", "least rows of a child", TypeConverters.toInt)
    regionRows = Param(Params._dummy(), "regionRows", "rows of which one task grows a subtree", TypeConverters.toInt)

    def setFeaturesCol(self, c): return self._set(featuresCol=c)  # noqa: E704
    def setLabelCol(self, c): return self._set(labelCol=c)  # noqa: E704
    def setPredictionCol(self, c): return self._set(predictionCol=c)  # noqa: E704
    def setProbabilityCol(self, c): return self._set(probabilityCol=c)  # noqa: E704
    def setRawPredictionCol(self, c): return self._set(rawPredictionCol=c)  # noqa: E704
    def setSeed(self, s): return self._set(seed=s)  # noqa: E704
    def getNumTrees(self): return self.getOrDefault("numTrees")  # noqa: E704
    def getMaxDepth(self): return self.getOrDefault("maxDepth")  # noqa: E704


class BaggedForest(Estimator, _ForestParams, DefaultParamsReadable, DefaultParamsWritable):
    """Random forest for labels 0 and 1."""

    @keyword_only
    def __init__(self, *, numTrees=20, maxDepth=5, minInstancesPerNode=1, seed=42, regionRows=REGION_ROWS, featuresCol="features",
                 labelCol="label"):
        super().__init__()
        self._setDefault(numTrees=20, maxDepth=5, minInstancesPerNode=1, seed=42, regionRows=REGION_ROWS)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> "BaggedForestModel":
        from pagelab.session import scratch_path
        spark, g = df.sparkSession, self.getOrDefault
        sc, seed, n_trees, deepest, least = spark.sparkContext, g("seed"), g("numTrees"), g("maxDepth"), g("minInstancesPerNode")
        features, label, region_rows = g("featuresCol"), g("labelCol"), g("regionRows")
        head = df.select(F.size(vector_to_array(F.col(features))).alias("n")).first()
        if head is None:
            raise ValueError("no rows to fit")
        width = head["n"]
        cuts = cut_points(df, width, features, BINS)
        table = stored_blocks(df, cuts, scratch_path(spark, f"bagged_{uuid.uuid4().hex}"), label, features, label, None, BLOCK_ROWS)
        blocks = table.rdd.map(lambda r: _unpack(r, width, np.uint8)).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            rows, other = blocks.map(lambda b: (len(b[2]), int(((b[2] != 0) & (b[2] != 1)).sum()))).reduce(
                lambda a, b: (a[0] + b[0], a[1] + b[1]))
            if other:
                raise ValueError("labels must be 0 or 1")
            upper = _Upper(n_trees, rows, region_rows, deepest)
            while upper.open():
                asked = sc.broadcast(upper.open())
                parts = max(1, min(sc.defaultParallelism, len(asked.value)))

                def sums(block):
                    number, bins, ones, *_ = block
                    for t, (tree, nodes) in asked.value.items():
                        times = _times(number, len(bins), seed, t)
                        on = np.flatnonzero(times)
                        place = np.full(len(tree[0]), -1)
                        place[nodes] = np.arange(len(nodes))
                        at = place[_node_of(tree, bins[on])]
                        on, at = on[at >= 0], at[at >= 0]
                        tried = np.stack([_tried(seed, t, int(i), width) for i in nodes])
                        yield t, _sums(bins, on, times[on] * (1 + PACK * ones[on]), at, tried)

                found = blocks.flatMap(sums).reduceByKey(np.add, parts).mapValues(lambda s: _best(s, least)).collect()
                upper.take(found, lambda t, i: _tried(seed, t, i, width))
        finally:
            blocks.unpersist()
        return self._copyValues(BaggedForestModel(*self._grown(table, upper, cuts, width, seed, least)))

    def _grown(self, table: DataFrame, upper: "_Upper", cuts, width: int, seed: int, least: int):
        """The forest and its columns' importance: subtrees of all regions, hung below the upper levels."""
        spark = table.sparkSession
        shared = spark.sparkContext.broadcast([(t.packed(), upper.regions[i], upper.groups(i)) for i, t in enumerate(upper.trees)])

        def deal(batches):
            for b in batches:
                for row in b.to_pylist():
                    number, bins, ones, *_ = _unpack(row, width, np.uint8)
                    for t, (tree, regions, groups) in enumerate(shared.value):
                        times = _times(number, len(bins), seed, t)
                        on = np.flatnonzero(times)
                        at = _node_of(tree, bins[on])
                        sent = [(r, on[at == r]) for r in regions]
                        sent = [(r, i) for r, i in sent if len(i)]
                        if sent:
                            yield pa.RecordBatch.from_arrays(
                                [pa.array([t] * len(sent), pa.int32()), pa.array([groups[r] for r, _ in sent], pa.int32()),
                                 pa.array([r for r, _ in sent], pa.int32()),
                                 pa.array([regions[r] for r, _ in sent], pa.int32()),
                                 *[pa.array([x[i].tobytes() for _, i in sent], pa.binary()) for x in (bins, times, ones.astype(np.uint8))]],
                                names=["tree", "part", "region", "depth", "bins", "times", "ones"])

        def grow(part: pa.Table) -> pa.Table:
            held, out = {}, []
            for r in part.to_pylist():
                held.setdefault((r["tree"], r["region"], r["depth"]), []).append(r)
            for (t, region, depth), rows in held.items():
                bins, times, ones = (np.frombuffer(b"".join(r[c] for r in rows), np.uint8) for c in ("bins", "times", "ones"))
                rng = np.random.default_rng([seed, t, region, 1])
                f, c, left, value, drop = _subtree(bins.reshape(-1, width), times.astype(float), ones.astype(float), depth, least, rng)
                worth = np.bincount(f[f >= 0], drop[f >= 0], width)
                out.append((t, region, *(x.tobytes() for x in (f, c, left, value, worth))))
            return pa.table(list(map(pa.array, zip(*out))), names=["tree", "region", "feature", "cut", "left", "value", "worth"]).cast(shape)

        shape = pa.schema([("tree", pa.int32()), ("region", pa.int32()),
                           *[(c, pa.binary()) for c in ("feature", "cut", "left", "value", "worth")]])
        dealt = table.mapInArrow(deal, "tree int, part int, region int, depth int, bins binary, times binary, ones binary")
        parts = min(4 * spark.sparkContext.defaultParallelism, len(upper.trees))
        done = dealt.repartition(parts, "tree", "part").groupBy("tree", "part").applyInArrow(
            grow, "tree int, region int, feature binary, cut binary, left binary, value binary, worth binary")
        below = {(r["tree"], r["region"]): r for r in done.collect()}  # the model: bounded by trees and depth
        return upper.joined(below, cuts, width), upper.importance(below, width), width


class _Upper:
    """The upper levels of all trees: nodes of more rows than a region may have."""

    def __init__(self, n_trees: int, rows: int, region_rows: int, deepest: int):
        self.trees, self.region_rows, self.deepest = [Tree() for _ in range(n_trees)], region_rows, deepest
        self.depth = [[0] for _ in range(n_trees)]
        self.rows = [[0.0] for _ in range(n_trees)]  # of nodes that were split: times seen
        self.ones = [[0.0] for _ in range(n_trees)]
        small = rows <= region_rows
        self.todo = [[] if small else [0] for _ in range(n_trees)]
        self.regions = [{0: deepest} if small else {} for _ in range(n_trees)]  # node -> levels left

    def open(self) -> dict:
        return {t: (self.trees[t].packed(), np.array(todo)) for t, todo in enumerate(self.todo) if todo}

    def take(self, found, tried) -> None:
        for t, (drop, column, cut, n, ones, n_all, n_ones) in found:
            tree, nodes, self.todo[t] = self.trees[t], self.todo[t], []
            for j, i in enumerate(nodes):
                self.rows[t][i], self.ones[t][i] = n_all[j], n_ones[j]
                tree.value[i] = float(n_ones[j] / n_all[j])
                if self.depth[t][i] >= self.deepest or not drop[j] > LEAST:
                    continue
                children = tree.split(i, int(tried(t, i)[column[j]]), int(cut[j]), float(drop[j] * n_all[j]))
                for child, m, m_ones in zip(children, (n[j], n_all[j] - n[j]), (ones[j], n_ones[j] - ones[j])):
                    deep = self.depth[t][i] + 1
                    self.depth[t].append(deep)
                    self.rows[t].append(m)
                    self.ones[t].append(m_ones)
                    tree.value[child] = float(m_ones / m)
                    if m <= self.region_rows:
                        self.regions[t][child] = self.deepest - deep
                    elif deep < self.deepest:
                        self.todo[t].append(child)

    def groups(self, t: int) -> dict:
        """Number of the group of each region of a tree: together they have at most ``region_rows`` rows."""
        out, number, held = {}, 0, 0.0
        for i in self.regions[t]:
            if held and held + self.rows[t][i] > self.region_rows:
                number, held = number + 1, 0.0
            out[i], held = number, held + self.rows[t][i]
        return out

    def _merge(self, below) -> None:
        """Upper nodes whose two children are leaves that say the same become leaves."""
        for t, tree in enumerate(self.trees):
            for i in range(len(tree.feature) - 1, -1, -1):
                if tree.feature[i] < 0:
                    continue
                pair = (tree.left[i], tree.left[i] + 1)
                leaf = [tree.feature[c] < 0 and ((t, c) not in below or len(below[t, c]["feature"]) == 2) for c in pair]
                if all(leaf) and (tree.value[pair[0]] > 0.5) == (tree.value[pair[1]] > 0.5):
                    tree.feature[i], tree.gain[i] = -1, 0.0
                    for c in pair:
                        below.pop((t, c), None)

    def joined(self, below, cuts, width: int) -> Forest:
        self._merge(below)
        edges = np.zeros((width, BINS))
        for j, c in enumerate(cuts):
            edges[j, :len(c)] = c
        feature, number, left, roots, at = [], [], [], [], 0
        for t, tree in enumerate(self.trees):
            seen, todo = [], [0]  # upper nodes, neighbours first
            while todo:
                i = todo.pop()
                seen.append(i)
                if tree.feature[i] >= 0:
                    todo += [tree.left[i] + 1, tree.left[i]]
            # a region's root takes its upper node's place, the rest of it follows the upper nodes
            f, c, low, v = (np.array(x) for x in (tree.feature, tree.bin, tree.left, tree.value))
            parts, end = [], len(f)
            for i in seen:
                r = below.get((t, i))
                if r is None or f[i] >= 0:
                    continue
                rf, rc, rl, rv = (np.frombuffer(r[k], d) for k, d in (("feature", np.int16), ("cut", np.uint8), ("left", np.int32), ("value", float)))
                rl = np.where(rf >= 0, rl + end - 1, 0)
                f[i], c[i], low[i], v[i] = rf[0], rc[0], rl[0], rv[0]
                parts.append((rf[1:], rc[1:], rl[1:], rv[1:]))
                end += len(rf) - 1
            f, c, low, v = (np.concatenate([a, *x]) for a, x in zip((f, c, low, v), list(zip(*parts)) or [()] * 4))
            roots.append(at)
            feature.append(f.astype(np.int16))
            number.append(np.where(f >= 0, edges[np.maximum(f, 0), c], v / len(self.trees)))
            left.append((low + at).astype(np.int32))
            at += len(f)
        left = np.concatenate(left)
        number = np.concatenate(number)  # thresholds of inner nodes, values of leaves
        return Forest(np.concatenate(feature), number, left, left + np.int32(1), number, np.array(roots, np.int64))

    def importance(self, below, width: int) -> np.ndarray:
        """Mean over the trees of each column's share of the drops in impurity."""
        out = np.zeros((len(self.trees), width))
        for (t, _), r in below.items():
            out[t] += np.frombuffer(r["worth"])
        for t, tree in enumerate(self.trees):
            for f, g in zip(tree.feature, tree.gain):
                if f >= 0:
                    out[t, f] += g
        total = out.sum(axis=1, keepdims=True)
        mean = np.divide(out, total, out=np.zeros_like(out), where=total > 0).sum(axis=0)
        return mean / mean.sum() if mean.sum() else mean


class BaggedForestModel(Model, _ForestParams, MLWritable, MLReadable):
    def __init__(self, forest: Forest | None = None, importance: np.ndarray | None = None, width: int = 0):
        super().__init__()
        self.forest, self.importance, self.width = forest, importance, width

    @property
    def featureImportances(self) -> DenseVector:
        return DenseVector(self.importance)

    @property
    def totalNumNodes(self) -> int:
        return len(self.forest.feature)

    def _transform(self, df: DataFrame) -> DataFrame:
        """``df`` with votes, probabilities and the prediction (ties go to class 0)."""
        g = self.getOrDefault
        x = scored(df, self.forest, g("featuresCol"), "_share", self.width)
        share, n = F.least(F.col("_share"), F.lit(1.0)), float(len(self.forest.roots))
        x = x.withColumn(g("rawPredictionCol"), array_to_vector(F.array((1 - share) * n, share * n)))
        x = x.withColumn(g("probabilityCol"), array_to_vector(F.array(1 - share, share)))
        return x.withColumn(g("predictionCol"), (share > 0.5).cast("double")).drop("_share")

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)


class _Writer(MLWriter):
    def __init__(self, model: BaggedForestModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        m, f = self.model, self.model.forest
        DefaultParamsWriter.saveMetadata(m, path, self.sparkSession, extraMetadata={"width": m.width})
        ends = np.append(f.roots[1:], len(f.feature))
        rows = [(t, f.feature[a:z].tobytes(), f.threshold[a:z].tobytes(), (f.left[a:z] - a).astype(np.int32).tobytes())
                for t, (a, z) in enumerate(zip(f.roots.tolist(), ends.tolist()))]
        self.sparkSession.createDataFrame(rows, "tree int, feature binary, number binary, left binary").write.parquet(f"{path}/trees")
        self.sparkSession.createDataFrame([(m.importance.tolist(),)], "importance array<double>").write.parquet(f"{path}/importance")


class _Reader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> BaggedForestModel:
        meta = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        rows = self.sparkSession.read.parquet(f"{path}/trees").orderBy("tree").collect()  # the model: bounded by trees and depth
        feature = [np.frombuffer(r["feature"], np.int16) for r in rows]
        roots = np.cumsum([0, *map(len, feature)])[:-1]
        left = np.concatenate([np.frombuffer(r["left"], np.int32) + np.int32(a) for r, a in zip(rows, roots)])
        number = np.concatenate([np.frombuffer(r["number"]) for r in rows])
        importance = np.array(self.sparkSession.read.parquet(f"{path}/importance").first()["importance"])
        forest = Forest(np.concatenate(feature), number, left, left + np.int32(1), number, roots.astype(np.int64))
        m = self.cls(forest, importance, meta["width"])
        m._resetUid(meta["uid"])
        DefaultParamsReader.getAndSetParams(m, meta)
        return m
