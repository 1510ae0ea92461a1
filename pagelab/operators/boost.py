"""Second-order boosted trees on binned features, many models in the same passes.

Each feature is cut once into at most ``bins`` bins at quantiles of a mergeable
sketch; rows become bytes, stored in blocks in the shared folder. Trees grow level
by level. A pass over the blocks adds up, for every open node of every model, the
gradients and hessians of the logistic loss per (feature, bin); the sums are reduced
per group of features, where the best split of each node is found, and only these
splits reach the driver. So a level costs one pass whatever the number of models:
the folds and experts of a stack, or the trials of a search, are fitted together.
Nodes of at most ``region_rows`` rows are not summed up: their rows go to one task, which
grows the whole subtree by the same steps, in one job for all such nodes of a round. So
a round costs a pass for each level of large nodes and one more, whatever the depth.
A table that is one block (``block_rows`` rows) or has at most ``TASK_CELLS`` binned values needs no
sums of others: there the models are dealt out among tasks, the longest first, which grow them by
the same steps, in one job.

A task that has all rows of a node, of a table of more than one block, sums up the smaller child of a
split only; the other's sums are the parent's less these. For that, gradients and hessians count in
whole steps of 2^-32: sums of two million rows are exact, and so are differences. (Leaves take them as they are.)

    gain = (GL^2/(HL + l) + GR^2/(HR + l) - G^2/(H + l)) / 2 - gamma,  leaf = -rate G/(H + l)

Splits need ``min_hessian`` on both sides; ties go to the first feature, then the
lowest cut. With ``second_order=False`` nodes split by the gradients' squared means
over row counts (at least one row a side, no l in the gain) and only leaves take the
Newton step: first-order boosting.

Rows and columns of a tree are sampled by hashes of (row, seed, round). A task keeps
the margins of the blocks that it has seen (a bounded number); a worker without them,
new or after a loss, recomputes them from the trees, which are broadcast, so a retried
task gives the same sums. NaN counts as larger than all values.
"""

from __future__ import annotations

import json
import math
import uuid
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelab.operators.forest import Forest, scored

SKETCH = 2_048  # weighted values that a feature's sketch keeps
BLOCK_ROWS = 20_000
CELLS = 1 << 22  # histogram cells (nodes x bins) of one pass and task
GROUP_CELLS = 1 << 16  # of one group of columns, so that its sums stay in the processor's cache
REGION_ROWS = 1 << 16  # a node of so many rows or fewer is grown on by one task
TASK_CELLS = 1 << 27  # binned values (bytes) of a table of which one task grows a whole model
CACHED = 1 << 13  # rows whose numbers stay in the processor's cache
EXACT = float(1 << 32)  # steps of gradients and hessians in 1
HELD_MARGINS = 1 << 24  # numbers a worker keeps


@dataclass(frozen=True)
class Settings:
    rounds: int = 200
    depth: int = 5
    rate: float = 0.1
    reg_lambda: float = 1.0
    gamma: float = 0.0
    min_hessian: float = 1.0
    row_share: float = 1.0
    column_share: float = 1.0
    second_order: bool = True
    seed: int = 42


@dataclass(frozen=True)
class Spec:
    """One model: its settings, the columns it sees, and the fold it leaves out (None: no fold)."""
    settings: Settings
    columns: tuple[int, ...]
    without_fold: int | None = None


# ------------------------------------------------------------------ bins
def _compress(value: np.ndarray, weight: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values with summed weights; over ``size`` of them, those at even steps of weight
    (the least and the greatest stay)."""
    order = np.argsort(value, kind="stable")
    value, weight = value[order], weight[order]
    first = np.flatnonzero(np.concatenate(([True], value[1:] != value[:-1]))) if len(value) else np.zeros(0, np.int64)
    value, weight = value[first], np.add.reduceat(weight, first) if len(first) else weight[:0]
    if len(value) <= size:
        return value, weight
    total = np.cumsum(weight)
    at = np.unique(np.concatenate(([0], np.searchsorted(total, total[-1] * np.arange(1, size + 1) / size))))
    at = np.minimum(at, len(value) - 1)
    return value[at], np.diff(total[at], prepend=0.0)


def _dense(lists: pa.Array, width: int) -> np.ndarray:
    """The rows of an Arrow column of vectors as a matrix."""
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, width)


def cut_points(df: DataFrame, width: int, features: str = "features", bins: int = 256) -> list[np.ndarray]:
    """Cuts of each column: midpoints between neighbours where there are at most ``bins`` distinct
    values, else about ``bins`` steps of equal weight. Sketches are merged in two rounds."""
    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(np.zeros(0), np.zeros(0))] * width
        for b in batches:
            x = _dense(b.column(0), width)
            for j in range(width):
                v = x[:, j][~np.isnan(x[:, j])]
                held[j] = _compress(np.concatenate((held[j][0], v)), np.concatenate((held[j][1], np.ones(len(v)))), SKETCH)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(width), pa.int32()), pa.array([v.tolist() for v, _ in held], pa.list_(pa.float64())),
             pa.array([w.tolist() for _, w in held], pa.list_(pa.float64()))], names=["j", "v", "w"])

    def merge(parts: pd.DataFrame) -> pd.DataFrame:
        v, w = np.zeros(0), np.zeros(0)
        for a, b in zip(parts["v"], parts["w"]):
            v, w = _compress(np.concatenate((v, a)), np.concatenate((w, b)), SKETCH)
        return pd.DataFrame({"j": [int(parts["j"].iloc[0])], "v": [v.tolist()], "w": [w.tolist()]})

    shape = "j int, v array<double>, w array<double>"
    made = df.select(vector_to_array(F.col(features))).mapInArrow(summarise, shape)
    made = made.withColumn("_s", F.spark_partition_id() % 64).groupBy("j", "_s").applyInPandas(merge, shape)
    made = made.groupBy("j").applyInPandas(merge, shape)
    cuts = [np.zeros(0)] * width
    for r in made.collect():  # a bounded sketch a column
        v, w = np.array(r["v"]), np.array(r["w"])
        if len(v) > bins:
            total = np.cumsum(w)
            at = np.unique(np.searchsorted(total, total[-1] * np.arange(1, bins) / bins))
            at = at[at < len(v) - 1]
        else:
            at = np.arange(max(0, len(v) - 1))
        cuts[r["j"]] = np.unique((v[at] + v[at + 1]) / 2) if len(at) else np.zeros(0)
    return cuts


# ------------------------------------------------------------------ trees under growth
@dataclass
class Tree:
    """Nodes in lists; node i goes left where its bin is <= ``bin[i]``; children are neighbours."""
    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])
    gain: list[float] = field(default_factory=lambda: [0.0])

    def split(self, i: int, feature: int, cut: int, gain: float) -> tuple[int, int]:
        self.feature[i], self.bin[i], self.left[i], self.gain[i] = feature, cut, len(self.feature), gain
        for _ in range(2):
            self.feature.append(-1)
            self.bin.append(0)
            self.left.append(0)
            self.value.append(0.0)
            self.gain.append(0.0)
        return self.left[i], self.left[i] + 1

    def graft(self, i: int, below: "Tree") -> None:
        """Node ``i``, a leaf, becomes the root of ``below``."""
        at = len(self.feature) - 1  # node k of ``below`` comes to at + k, its root to i
        for mine, other in ((self.feature, below.feature), (self.bin, below.bin), (self.value, below.value), (self.gain, below.gain)):
            mine[i] = other[0]
            mine.extend(other[1:])
        left = [at + x if x else 0 for x in below.left]
        self.left[i] = left[0]
        self.left.extend(left[1:])

    def packed(self) -> tuple[np.ndarray, ...]:
        return (np.array(self.feature, np.int32), np.array(self.bin, np.int32), np.array(self.left, np.int32),
                np.array(self.value))


def _node_of(tree, bins: np.ndarray) -> np.ndarray:
    feature, cut, left, _ = tree
    node = np.zeros(len(bins), np.int32)
    rows = np.arange(len(bins))
    while (inner := feature[node] >= 0).any():
        f = feature[node]
        node = np.where(inner, left[node] + (bins[rows, f] > cut[node]), node)
    return node


def _mixed(key: np.ndarray, salt: int) -> np.ndarray:
    """Uniform numbers in [0, 1) from row hashes and a salt (the finaliser of splitmix64)."""
    z = key + np.uint64(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def _tree_columns(spec: Spec, round_: int) -> np.ndarray:
    s, cols = spec.settings, np.array(spec.columns)
    if s.column_share >= 1:
        return cols
    rng = np.random.default_rng([s.seed, round_, len(cols)])
    return np.sort(rng.choice(cols, max(1, int(len(cols) * s.column_share)), replace=False))


#: (run, block) -> (rounds applied, margins [models, rows]); least used go first.
_MARGINS: OrderedDict = OrderedDict()


def _margins(run: str, block: int, bins: np.ndarray, base: np.ndarray, done) -> np.ndarray:
    """Margins after all finished rounds; what this worker has not applied yet is applied now."""
    rounds, margin = _MARGINS.pop((run, block), (0, None))
    if margin is None:
        margin = np.repeat(base[:, None], len(bins), axis=1)
    flat = [r for part in done for r in (part.value if hasattr(part, "value") else part)]
    for trees in flat[rounds:]:
        for m, tree in trees:
            margin[m] += tree[3][_node_of(tree, bins)]
    _MARGINS[run, block] = (len(flat), margin)
    while len(_MARGINS) > 1 and sum(x[1].size for x in _MARGINS.values()) > HELD_MARGINS:
        _MARGINS.popitem(last=False)
    return margin


def _rows_at(block, spec: Spec, tree, nodes: np.ndarray, round_: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a block that the round's tree sees in ``nodes``, and their places there."""
    _, bins, _, fold, key = block
    s = spec.settings
    on = np.ones(len(bins), bool) if spec.without_fold is None else fold != spec.without_fold
    if s.row_share < 1:
        on &= _mixed(key, s.seed * 1_000_003 + round_) < s.row_share
    place = np.full(len(tree[0]), -1)
    place[nodes] = np.arange(len(nodes))
    at = place[_node_of(tree, bins)]
    on = np.flatnonzero(on & (at >= 0))
    return on, at[on]


def _slopes(margin: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients and hessians of the logistic loss."""
    p = 1 / (1 + np.exp(-margin))
    return p - label, p * (1 - p)


def _sums(bins: np.ndarray, rows, at: np.ndarray, channels, n_nodes: int, columns: np.ndarray, n_bins: np.ndarray) -> np.ndarray:
    """[nodes, bins of the columns, channels] of the rows, a column at a time."""
    size, start = n_bins[columns], 0
    out = np.empty((n_nodes, int(size.sum()), len(channels)))
    for j, n in zip(columns.tolist(), size.tolist()):
        code = at * n + bins[rows, j]
        for c, weight in enumerate(channels):
            out[:, start:start + n, c] = np.bincount(code, weight, n_nodes * n).reshape(n_nodes, n)
        start += n
    return out


def _histograms(block, run: str, specs: list[Spec], base: np.ndarray, done, growing, round_: int, n_bins: np.ndarray, groups,
                counted: bool = False):
    """((model, first column of the group), [open nodes, bins of the group, channels]) of one block;
    ``counted`` adds the rows' number as a channel where the model does not need it."""
    number, bins, label, _, _ = block
    margin = _margins(run, number, bins, base, done)
    for m, tree, nodes in growing:
        on, at = _rows_at(block, specs[m], tree, nodes, round_)
        rows = slice(None) if len(on) == len(bins) else on
        channels = [*_slopes(margin[m, rows], label[rows])]
        if counted or not specs[m].settings.second_order:
            channels.append(np.ones(len(on)))
        for columns in groups[m]:
            yield (m, int(columns[0])), _sums(bins, rows, at, channels, len(nodes), columns, n_bins)


def _region_rows(block, run: str, specs: list[Spec], base: np.ndarray, done, growing, round_: int, columns):
    """((model, node), (block, binned columns of the tree, gradients, hessians)) of one block's rows."""
    number, bins, label, _, _ = block
    margin = _margins(run, number, bins, base, done)
    for m, tree, nodes in growing:
        on, at = _rows_at(block, specs[m], tree, nodes, round_)
        g, h = _slopes(margin[m, on], label[on])
        order = np.argsort(at, kind="stable")
        ends = np.searchsorted(at[order], np.arange(len(nodes) + 1))
        for k, node in enumerate(nodes.tolist()):
            part = order[ends[k]:ends[k + 1]]
            if len(part):
                yield (m, node), (number, np.asfortranarray(bins[np.ix_(on[part], columns[m])]), g[part], h[part])


def _subtree(parts, s: Settings, levels: int, columns: np.ndarray, n_bins: np.ndarray) -> "Tree":
    """The tree below a node, from all rows of it."""
    parts = sorted(parts, key=lambda p: p[0])
    bins = np.asfortranarray(np.concatenate([p[1] for p in parts]))
    g, h = (np.concatenate([p[i] for p in parts]) for i in (2, 3))
    return _held_tree(bins, g, h, np.arange(len(g)), s, levels, columns, n_bins[columns], np.arange(len(columns)))[0]


def _held_tree(bins: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray, s: Settings, levels: int, names: np.ndarray,
               n_bins: np.ndarray, columns: np.ndarray) -> tuple["Tree", list[tuple[int, np.ndarray]]]:
    """The tree of ``rows`` of a table held column after column, and the rows of its leaves. ``columns``
    are the places of the tree's columns in ``bins``, ``names`` their numbers in the tree."""
    cut = n_bins > 1  # one bin cannot be cut
    columns, names, size = columns[cut], names[cut], n_bins[cut]
    cells, slope = int(size.sum()), np.empty(len(g), complex)
    slope.real, slope.imag = np.rint(g * EXACT) / EXACT, np.rint(h * EXACT) / EXACT if s.second_order else 1.0
    tree, leaves = Tree(), []
    todo = [(None, [(0, rows)])]  # (sums of the parent, its children)
    for level in range(levels + 1):
        fresh, held = [], 0
        step = max(1, CELLS // max(1, 4 * cells))
        for at in range(0, len(todo), step):
            asked, families = [], []
            for above, pair in todo[at:at + step]:
                pair = [(i, r, float(g[r].sum()), float(h[r].sum())) for i, r in pair]
                open_ = [len(columns) > 0 and level < levels and _may_split((a, b, len(r)), s) for _, r, a, b in pair]
                order = sorted(range(len(pair)), key=lambda k: len(pair[k][1]))
                direct = [] if not any(open_) else order[:1] if above is not None else [k for k in order if open_[k]]
                families.append((above, pair, open_, {k: len(asked) + n for n, k in enumerate(direct)}))
                asked += [pair[k][1] for k in direct]
            sums = _held_sums(bins, slope, asked, columns, size, cells)
            for above, pair, open_, direct in families:
                for k, (i, r, a, b) in enumerate(pair):
                    best = None
                    if open_[k]:
                        mine = sums[direct[k]] if k in direct else above - sums[direct[1 - k]]
                        best = _held_best(mine, size, s)
                    if best is None or not best[0] > 1e-12:
                        leaves.append((i, r))
                        if b + s.reg_lambda > 0:
                            tree.value[i] = -s.rate * a / (b + s.reg_lambda)
                        continue
                    gain, column, code = best
                    pair_nodes = tree.split(i, int(names[column]), code, gain)
                    right = bins[:, columns[column]][r] > code
                    kept = level + 1 < levels and held + cells <= CELLS
                    held += cells if kept else 0
                    fresh.append((mine.copy() if kept else None, [(pair_nodes[0], r[~right]), (pair_nodes[1], r[right])]))
        todo = fresh
    return tree, leaves


def _held_sums(bins: np.ndarray, slope: np.ndarray, asked: list[np.ndarray], columns: np.ndarray, size: np.ndarray,
               cells: int) -> np.ndarray:
    """[node, cells of the columns] of the slopes of each node's rows."""
    out = np.zeros((len(asked), cells), complex)
    if not asked:
        return out
    rows, flat = np.concatenate(asked), out.ravel()
    at = np.repeat(np.arange(len(asked)) * cells, [len(r) for r in asked])
    every = len(asked) == 1 and len(rows) == len(bins)  # then they are in order
    starts = (np.cumsum(size) - size).tolist()
    for a in range(0, len(rows), CACHED):
        part = slice(a, a + CACHED) if every else rows[a:a + CACHED]
        weight, node = slope[part], at[a:a + CACHED]
        for j, start in zip(columns.tolist(), starts):
            np.add.at(flat[start:], node + bins[:, j][part], weight)
    return out


def _held_best(sums: np.ndarray, size: np.ndarray, s: Settings) -> tuple[float, int, int] | None:
    """(gain, place of the column, bin) of a node's best split; the first of equal ones."""
    ends = np.cumsum(size)
    starts = (ends - size)[1:]
    total = sums[:ends[0]].sum()
    sums = sums.copy()
    sums[starts] -= total  # running sums start anew at each column
    run = np.cumsum(sums)
    g, w = run.real.copy(), run.imag.copy()
    g_right, w_right = total.real - g, total.imag - w
    extra, least = (s.reg_lambda, s.min_hessian) if s.second_order else (0.0, 1.0)
    bad = (w < least) | (w_right < least)
    bad[ends - 1] = True  # behind the last bin is no cut
    with np.errstate(divide="ignore", invalid="ignore"):
        for a, b in ((g, w), (g_right, w_right)):
            a *= a
            b += extra
            a /= b
            if not least + extra > 0:
                a[~(b > 0)] = 0.0
        worth = total.real ** 2 / (total.imag + extra) if total.imag + extra > 0 else 0.0
    g += g_right
    g[bad] = -np.inf
    most = g.max()
    if most == -np.inf:
        return None
    gain = (most - worth) / 2 - s.gamma
    at = int((g >= most - 2e-12 * abs(gain)).argmax())
    column = int(np.searchsorted(ends, at, side="right"))
    return float((g[at] - worth) / 2 - s.gamma), column, at - int(ends[column] - size[column])


def _held_model(parts, spec: Spec, base: float, n_bins: np.ndarray) -> list["Tree"]:
    """All trees of a model from all rows of it: (block, bins of the model's columns, label, fold, key) of each block."""
    parts = sorted(parts, key=lambda p: p[0])
    on = [slice(None) if spec.without_fold is None else p[3] != spec.without_fold for p in parts]
    bins = np.asfortranarray(np.concatenate([p[1][o] for p, o in zip(parts, on)]))
    label, key = (np.concatenate([p[i][o] for p, o in zip(parts, on)]) for i in (2, 4))
    parts.clear()
    own, s, margin, trees = np.array(spec.columns, np.int64), spec.settings, np.full(len(label), base), []
    place = np.zeros(len(n_bins), np.int64)
    place[own] = np.arange(len(own))
    for round_ in range(s.rounds):
        columns = _tree_columns(spec, round_)
        g, h = _slopes(margin, label)
        rows = np.arange(len(label))
        seen = _mixed(key, s.seed * 1_000_003 + round_) < s.row_share if s.row_share < 1 else np.ones(len(label), bool)
        tree, leaves = _held_tree(bins, g, h, rows[seen], s, s.depth, columns, n_bins[columns], place[columns])
        for i, r in leaves:
            margin[r] += tree.value[i]
        if not seen.all():
            feature, cut, left, value = tree.packed()
            margin[~seen] += value[_node_of((np.where(feature >= 0, place[feature], -1), cut, left, value), bins[~seen])]
        trees.append(tree)
    return trees


def _best_splits(columns: np.ndarray, n_bins: np.ndarray, s: Settings, hist: np.ndarray) -> list[tuple]:
    """Of each node: (gain, column, bin, channel sums left of the cut, channel sums of the node)."""
    size = n_bins[columns]
    ends = np.cumsum(size)
    run = np.cumsum(hist, axis=1)
    before = np.concatenate((np.zeros_like(run[:, :1]), run), axis=1)[:, ends - size]  # sums up to each column
    left = run - np.repeat(before, size, axis=1)
    total = left[:, ends[0] - 1]
    right = total[:, None] - left
    weight = 1 if s.second_order else 2
    extra = s.reg_lambda if s.second_order else 0.0
    least = s.min_hessian if s.second_order else 1.0

    def worth(x):
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(x[..., weight] + extra > 0, x[..., 0] ** 2 / (x[..., weight] + extra), 0.0)

    gain = (worth(left) + worth(right) - worth(total)[:, None]) / 2 - s.gamma
    ok = (left[..., weight] >= least) & (right[..., weight] >= least)
    ok[:, ends - 1] = False  # behind the last bin is no cut
    gain = np.where(ok, gain, -np.inf)
    near = gain >= gain.max(axis=1, keepdims=True) - 1e-12 * np.abs(gain.max(axis=1, keepdims=True))
    at = near.argmax(axis=1)  # the first of equal gains
    column = np.searchsorted(ends, at, side="right")
    line = np.arange(len(hist))
    return [(float(gain[i, at[i]]), int(columns[column[i]]), int(at[i] - (ends - size)[column[i]]),
             left[i, at[i]].tolist(), total[i].tolist()) for i in line]


# ------------------------------------------------------------------ fitting
@dataclass(frozen=True)
class Boosted:
    """A fitted model: its forest (margins) and the gains of the forest's nodes."""
    forest: Forest
    gain: np.ndarray
    width: int


def stored_blocks(df: DataFrame, cuts: list[np.ndarray], path: str, label: str, features: str, key: str,
                  fold: str | None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Binned rows in blocks, written to ``path`` and read again."""
    width, wide = len(cuts), max((len(c) for c in cuts), default=0) > 255
    kind = np.uint16 if wide else np.uint8
    x = df.select(vector_to_array(F.col(features)), F.col(label).cast("double"),
                  (F.col(fold) if fold else F.lit(-1)).cast("int"), F.xxhash64(F.col(key)))
    x = x.coalesce(max(1, math.ceil(x.count() / block_rows)))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for b in batches:
            m = _dense(b.column(0), width)
            binned = np.zeros(m.shape, kind)
            for j in range(width):
                binned[:, j] = np.searchsorted(cuts[j], m[:, j], side="left")
            held.append((binned, b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_numpy(), b.column(3).to_numpy()))
            if sum(len(h[0]) for h in held) >= block_rows:
                yield emit(held)
                held = []
        if held:
            yield emit(held)

    def emit(held):
        parts = [np.concatenate(a).tobytes() for a in zip(*held)]
        return pa.RecordBatch.from_arrays([pa.array([p], pa.binary()) for p in parts], names=["bins", "label", "fold", "key"])

    x.mapInArrow(pack, "bins binary, label binary, fold binary, key binary") \
        .withColumn("block", F.monotonically_increasing_id()).write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _unpack(row, width: int, kind) -> tuple:
    return (row["block"], np.frombuffer(row["bins"], kind).reshape(-1, width), np.frombuffer(row["label"]),
            np.frombuffer(row["fold"], np.int32), np.frombuffer(row["key"], np.int64).view(np.uint64))


def fit_many(df: DataFrame, specs: list[Spec], label: str = "label", features: str = "features", key: str = "page_id",
             fold: str | None = None, bins: int = 256, block_rows: int = BLOCK_ROWS,
             region_rows: int = REGION_ROWS, task_cells: int | None = None) -> list[Boosted]:
    """All models of ``specs`` on ``df``: each by one task where the table is one block or has at most
    ``task_cells`` binned values (``TASK_CELLS``; 0 for smaller blocks than usual), else level by level in common passes."""
    from pagelab.session import scratch_path
    spark, run = df.sparkSession, uuid.uuid4().hex
    sc = spark.sparkContext
    head = df.select(F.size(vector_to_array(F.col(features))).alias("n")).first()
    if head is None:
        raise ValueError("no rows to fit")
    width = head["n"]
    cuts = cut_points(df, width, features, bins)
    n_bins = np.array([len(c) + 1 for c in cuts])
    kind = np.uint16 if n_bins.max() > 256 else np.uint8
    table = stored_blocks(df, cuts, scratch_path(spark, f"boost_{run}"), label, features, key, fold, block_rows)
    blocks = table.rdd.map(lambda row: _by_column(_unpack(row, width, kind))).persist(StorageLevel.MEMORY_AND_DISK)
    counts = np.array(blocks.map(lambda b: [f(b, s) for s in specs for f in (_rows_of, _ones_of)]).reduce(
        lambda a, b: [x + y for x, y in zip(a, b)])).reshape(-1, 2)
    prior = np.clip(counts[:, 1] / np.maximum(counts[:, 0], 1), 1e-6, 1 - 1e-6)
    base = np.array([0.0 if s.settings.second_order else math.log(q / (1 - q)) for s, q in zip(specs, prior)])
    try:
        if task_cells is None:
            task_cells = TASK_CELLS if block_rows >= BLOCK_ROWS else 0
        n_blocks, n_rows = blocks.map(lambda b: (1, len(b[2]))).reduce(lambda a, b: (a[0] + b[0], a[1] + b[1]))
        if n_blocks == 1 or n_rows * max(len(s.columns) for s in specs) <= task_cells:
            turn = {m: i for i, m in enumerate(sorted(range(len(specs)), key=lambda m: -_effort(specs[m])))}

            def deal(block):
                made: dict = {}  # models of the same columns share them
                for m, s in enumerate(specs):
                    if s.columns not in made:
                        made[s.columns] = block[1] if s.columns == tuple(range(width)) else block[1][:, list(s.columns)]
                    yield m, (block[0], made[s.columns], *block[2:])

            def alone(rows):
                held: dict = {}
                for m, part in rows:
                    held.setdefault(m, []).append(part)
                for m in sorted(held):
                    yield m, _held_model(held[m], specs[m], base[m], n_bins)

            def of_block(rows):
                for m, block in rows:
                    def sums(done, growing, round_, groups, best):
                        return [(k, best(k, h)) for k, h in _histograms(block, f"{run}/{m}", [specs[m]], base[m:m + 1], done, growing,
                                                                        round_, n_bins, groups)]
                    yield m, _grow([specs[m]], n_bins, sums, lambda rounds: rounds)[0]
            dealt = blocks.flatMap(lambda b: [(m, b) for m in turn]) if n_blocks == 1 else blocks.flatMap(deal)
            dealt = dealt.partitionBy(len(specs), lambda m: turn[m]).mapPartitions(of_block if n_blocks == 1 else alone)
            grown = [trees for _, trees in sorted(dealt.collect(), key=lambda t: t[0])]
        else:
            parts = max(1, min(sc.defaultParallelism, blocks.getNumPartitions()))

            def sums(done, growing, round_, groups, best):
                each = blocks.flatMap(lambda b: _histograms(b, run, specs, base, done, growing, round_, n_bins, groups, True))
                return each.reduceByKey(np.add, parts).map(lambda kv: (kv[0], best(*kv))).collect()

            def subtrees(done, growing, round_, columns, levels):
                """Of every node of ``growing`` the tree below it, each grown by a task of its own."""
                at = {k: i for i, k in enumerate((m, int(node)) for m, _, nodes in growing for node in nodes)}
                settings = {m: specs[m].settings for m, _, _ in growing}

                def grown(rows):
                    held: dict = {}
                    for k, part in rows:
                        held.setdefault(k, []).append(part)
                    for k, got in held.items():
                        yield k, _subtree(got, settings[k[0]], levels[k], columns[k[0]], n_bins)
                each = blocks.flatMap(lambda b: _region_rows(b, run, specs, base, done, growing, round_, columns))
                return each.partitionBy(len(at), lambda k: at[k]).mapPartitions(grown).collect()
            grown = _grow(specs, n_bins, sums, sc.broadcast, subtrees, region_rows)
    finally:
        blocks.unpersist()
    return [_forest(t, cuts, b, width) for t, b in zip(grown, base)]


def _effort(spec: Spec) -> float:
    """How long a model takes to grow, next to others of the same rows."""
    s = spec.settings
    return s.rounds * (1 + s.depth / 2) * len(spec.columns) * s.column_share * s.row_share


def _by_column(block) -> tuple:
    """The block with its bins stored column after column."""
    return (block[0], np.asfortranarray(block[1]), *block[2:])


def _grow(specs: list[Spec], n_bins: np.ndarray, sums, share, subtrees=None, region_rows: int = 0) -> list[list[Tree]]:
    """The trees of all models, round by round and level by level. ``sums`` runs a pass over the
    rows, ``subtrees`` grows nodes of at most ``region_rows`` rows to their end, ``share`` hands the
    trees of ten finished rounds to whoever runs it."""
    grown: list[list[Tree]] = [[] for _ in specs]
    done: list = []  # ten rounds shared at a time, then the newest ones
    for round_ in range(max(s.settings.rounds for s in specs)):
        live = [m for m, s in enumerate(specs) if round_ < s.settings.rounds]
        trees, open_ = {m: Tree() for m in live}, {m: {0: None} for m in live}
        columns = {m: _tree_columns(specs[m], round_) for m in live}
        small = _grow_trees(sums, specs, done, trees, open_, {m: specs[m].settings.depth for m in live}, round_, n_bins, columns,
                            region_rows if subtrees else 0)
        if small:
            growing = [(m, trees[m].packed(), np.array(sorted(i for k, i in small if k == m))) for m in sorted({m for m, _ in small})]
            for (m, i), below in sorted(subtrees(done, growing, round_, columns, small), key=lambda t: t[0]):
                trees[m].graft(i, below)
        for m in live:
            grown[m].append(trees[m])
        done.append([[(m, trees[m].packed()) for m in live]])
        if len(done) >= 10 and all(isinstance(d, list) and len(d) == 1 for d in done[-10:]):
            done[-10:] = [share([r for d in done[-10:] for r in d])]
    for part in done:
        if hasattr(part, "value"):
            part.unpersist()
    return grown


def _grow_trees(sums, specs: list[Spec], done, trees, open_, depth: dict[int, int], round_: int, n_bins: np.ndarray, columns,
                region_rows: int = 0) -> dict[tuple[int, int], int]:
    """Grows ``trees`` from their open nodes by at most ``depth`` levels. Nodes of at most
    ``region_rows`` rows are left as they are: (model, node) -> the levels it may still have."""
    aside: dict[tuple[int, int], int] = {}
    for level in range(max(depth.values()) + 1):
        if region_rows:  # the third channel counts the rows
            for m in open_:
                for i in [i for i, t in open_[m].items() if t is not None and t[2] <= region_rows and level < depth[m]
                          and _may_split(t, specs[m].settings)]:
                    aside[m, i] = depth[m] - level
                    del open_[m][i]
        ask = [m for m in open_ if open_[m] and level < max(1, depth[m])]
        found = _splits(sums, specs, done, trees, open_, ask, round_, n_bins, columns) if ask else {}
        for m in open_:
            s, fresh = specs[m].settings, {}
            for i, total in open_[m].items():
                best = found.get((m, i))
                total = best[4] if best and total is None else total
                if best and best[0] > 1e-12 and level < depth[m]:
                    lo, hi = trees[m].split(i, best[1], best[2], best[0])
                    fresh[lo], fresh[hi] = best[3], [t - a for t, a in zip(total, best[3])]
                elif total is not None and total[1] + s.reg_lambda > 0:
                    trees[m].value[i] = -s.rate * total[0] / (total[1] + s.reg_lambda)
            open_[m] = fresh
        if not any(open_.values()):
            break
    return aside


def _may_split(total, s: Settings) -> bool:
    """Whether both sides of a cut can have what a side needs (unknown sums: perhaps)."""
    return total is None or (total[1] >= 2 * s.min_hessian * (1 - 1e-9) if s.second_order else total[2] >= 2 - 1e-9)


def _rows_of(block, spec: Spec) -> float:
    return float(len(block[2]) if spec.without_fold is None else (block[3] != spec.without_fold).sum())


def _ones_of(block, spec: Spec) -> float:
    return float(block[2].sum() if spec.without_fold is None else block[2][block[3] != spec.without_fold].sum())


def _splits(sums, specs, done, trees, open_, ask, round_, n_bins, columns) -> dict:
    """(model, node) -> its best split. Open nodes are dealt into passes of at most ``CELLS`` histogram cells."""
    found: dict = {}
    todo = []
    for m in ask:
        nodes, total = sorted(i for i, t in open_[m].items() if _may_split(t, specs[m].settings)), int(n_bins[columns[m]].sum())
        step = max(1, CELLS // total)
        todo += [(m, nodes[a:a + step], min(step, len(nodes) - a) * total) for a in range(0, len(nodes), step)]
    while todo:
        now, cells = [], 0
        while todo and (not now or cells + todo[0][2] <= CELLS) and all(todo[0][0] != m for m, _, _ in now):
            cells += todo[0][2]
            now.append(todo.pop(0))
        growing = [(m, trees[m].packed(), np.array(nodes)) for m, nodes, _ in now]
        groups = {}
        for m, nodes, _ in now:
            part = np.cumsum(n_bins[columns[m]]) * len(nodes) // max(1, min(CELLS // 8, GROUP_CELLS))
            groups[m] = np.split(columns[m], np.flatnonzero(np.diff(part)) + 1)
        chosen = {(m, int(g[0])): g for m in groups for g in groups[m]}
        settings = {m: specs[m].settings for m in groups}

        def best(k, hist):
            return _best_splits(chosen[k], n_bins, settings[k[0]], hist)

        at = {m: nodes for m, nodes, _ in now}
        for (m, _), splits in sorted(sums(done, growing, round_, groups, best), key=lambda kv: kv[0]):
            for node, split in zip(at[m], splits):
                old = found.get((m, node))
                if old is None or math.isinf(old[0]) or split[0] > old[0] + 1e-12 * abs(old[0]):
                    found[m, node] = split
    return found


def _forest(trees: list[Tree], cuts: list[np.ndarray], base: float, width: int) -> Boosted:
    feature, threshold, left, right, value, gain, roots, at = [], [], [], [], [], [], [], 0
    for t in trees:
        roots.append(at)
        feature += t.feature
        threshold += [float(cuts[f][b]) if f >= 0 else 0.0 for f, b in zip(t.feature, t.bin)]
        left += [at + x for x in t.left]
        right += [at + x + 1 for x in t.left]
        value += t.value
        gain += t.gain
        at += len(t.feature)
    f = Forest(np.array(feature, np.int64), np.array(threshold), np.array(left, np.int64), np.array(right, np.int64),
               np.array(value), np.array(roots, np.int64), base)
    return Boosted(f, np.array(gain), width)


# ------------------------------------------------------------------ estimator
class HistBooster:
    """Estimator with the setters that the other learners of this package have; ``fit`` gives a model."""

    def __init__(self, key: str = "page_id", bins: int = 256, **settings):
        self.settings, self.key, self.bins = Settings(**settings), key, bins
        self.columns = dict(features="features", label="label", prediction="prediction", probability="probability")

    def _set(self, name: str, column: str) -> "HistBooster":
        self.columns[name] = column
        return self

    def setFeaturesCol(self, c): return self._set("features", c)  # noqa: E704
    def setLabelCol(self, c): return self._set("label", c)  # noqa: E704
    def setPredictionCol(self, c): return self._set("prediction", c)  # noqa: E704
    def setProbabilityCol(self, c): return self._set("probability", c)  # noqa: E704

    def fit(self, df: DataFrame) -> "HistBoosterModel":
        n = df.select(F.size(vector_to_array(F.col(self.columns["features"]))).alias("n")).first()
        spec = Spec(self.settings, tuple(range(n["n"] if n else 0)))
        return HistBoosterModel(fit_many(df, [spec], self.columns["label"], self.columns["features"], self.key, bins=self.bins)[0],
                                dict(self.columns))


class HistBoosterModel:
    def __init__(self, boosted: Boosted, columns: dict[str, str]):
        self.boosted, self.columns = boosted, columns

    @property
    def featureImportances(self) -> DenseVector:
        return DenseVector(self.boosted.forest.importance(self.boosted.gain, self.boosted.width))

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with the probability vector and the prediction (ties at 0.5 go to class 0)."""
        c = self.columns
        x = scored(df, self.boosted.forest, c["features"], "_margin", self.boosted.width)
        p = 1 / (1 + F.exp(-F.col("_margin")))
        x = x.withColumn(c["probability"], array_to_vector(F.array(1 - p, p)))
        return x.withColumn(c["prediction"], (F.col("_margin") > 0).cast("double")).drop("_margin")

    def save(self, spark, path: str) -> None:
        """The node table (one row a node, in order) and a line of settings, as Parquet."""
        f = self.boosted.forest
        rows = [(i, *map(float, (f.feature[i], f.threshold[i], f.left[i], f.right[i], f.value[i], self.boosted.gain[i])))
                for i in range(len(f.feature))]
        spark.createDataFrame(rows, "i long, feature double, threshold double, left double, right double, value double, gain double") \
            .write.mode("overwrite").parquet(f"{path}/nodes")
        state = json.dumps({"roots": f.roots.tolist(), "base": f.base, "width": self.boosted.width, "columns": self.columns})
        spark.createDataFrame([(state,)], "value string").write.mode("overwrite").parquet(f"{path}/state")

    @classmethod
    def load(cls, spark, path: str) -> "HistBoosterModel":
        s = json.loads(spark.read.parquet(f"{path}/state").first()["value"])
        n = spark.read.parquet(f"{path}/nodes").orderBy("i").toPandas()  # the model: bounded by trees and depth
        i = lambda c: n[c].to_numpy().astype(np.int64)
        f = Forest(i("feature"), n["threshold"].to_numpy(), i("left"), i("right"), n["value"].to_numpy(),
                   np.array(s["roots"], np.int64), s["base"])
        return cls(Boosted(f, n["gain"].to_numpy(), s["width"]), s["columns"])


def with_settings(booster: HistBooster, **more) -> HistBooster:
    """The same estimator with some settings changed."""
    booster.settings = replace(booster.settings, **more)
    return booster
