"""Exact k nearest neighbours by pivots and the triangle inequality.

Every row belongs to the cell of its nearest pivot (a bounded, seeded choice of
training rows) and knows its distance to it; a cell's rows are cut, by that distance,
into blocks of about ``block_rows`` rows, so that a block is a ring around its pivot.
From the k rows nearest to each pivot follows a bound t on the k-th neighbour of all
rows of a test block. A training ring [a, b] around pivot j can hold a neighbour of a
test ring [l, u] around pivot i, with d the pivots' distance, only if

    b >= max(d - u, l - d, d / 2) - t   and   a <= d + u + t.

Blocks that fail this never join; those that pass meet in one task for each pair, which
ranks by one matrix product, checks the candidates' distances exactly, and sends on the k
nearest of the block for each test row. No side is ever whole in one place, but for a
training side that is one block: it travels to the test rows, which stay where they are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelab.operators.sample import exact_rank

_SLACK = 1e-9  # of distances, against rounding
_PAIRS = 8_192  # pairs of rows whose differences are held at once


def _stack(v: pd.Series) -> np.ndarray:
    return np.stack(v.to_numpy()).astype(np.float64)


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances by one matrix product (rounded)."""
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T), 0.0)


def choose_pivots(train: DataFrame, n: int, seed: int = 42) -> np.ndarray:
    """``n`` training vectors (the smallest hashes of their ids), repeated ones once."""
    rows = train.select("_v", F.xxhash64("_id", F.lit(seed)).alias("_h"), "_id").orderBy("_h", "_id").limit(n).collect()
    return np.unique(np.array([r["_v"] for r in rows], float), axis=0)


def _assigned(df: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``df`` with the number of the nearest pivot, ``_c``, and the distance to it, ``_d``."""
    shared = df.sparkSession.sparkContext.broadcast(pivots)

    @F.pandas_udf("struct<c:int,d:double>")
    def near(v: pd.Series) -> pd.DataFrame:
        c, d = np.zeros(len(v), int), np.zeros(len(v))
        for at in range(0, len(v), 1_024):
            x = _stack(v[at:at + 1_024])
            c[at:at + len(x)] = _squared(x, shared.value).argmin(axis=1)
            d[at:at + len(x)] = np.sqrt(((x - shared.value[c[at:at + len(x)]]) ** 2).sum(axis=1))
        return pd.DataFrame({"c": c, "d": d})

    x = df.withColumn("_n", near("_v"))
    return x.select(*df.columns, F.col("_n.c").alias("_c"), F.col("_n.d").alias("_d"))


def _blocks(df: DataFrame, block_rows: int) -> DataFrame:
    """Rows with the number of their ring, ``_b``, within their cell."""
    r = exact_rank(df, "_d", ["_c"], tie="_id", out="_rank")
    return r.withColumn("_b", F.floor((F.col("_rank") - 1) / block_rows).cast("int"))


def block_pairs(train: DataFrame, test: DataFrame, pivots: np.ndarray, k: int) -> DataFrame:
    """(_qc, _qb, _c, _b): the blocks that can meet. Only block ranges and the k least pivot
    distances of each cell (pivots x k numbers) are looked at."""
    n = len(pivots)
    apart = np.sqrt(((pivots[:, None] - pivots[None]) ** 2).sum(axis=2))
    least = np.full((n, k), np.inf)
    for r in train.where(F.col("_rank") <= k).select("_c", "_rank", "_d").collect():
        least[r["_c"], r["_rank"] - 1] = r["_d"]
    rings = lambda df: df.groupBy("_c", "_b").agg(F.min("_d").alias("_lo"), F.max("_d").alias("_hi"))

    def bounds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for c, b, lo, hi in zip(pdf["_c"], pdf["_b"], pdf["_lo"], pdf["_hi"]):
                d = apart[c]
                t = np.partition((hi + d[:, None] + least).ravel(), k - 1)[k - 1]  # the k-th neighbour is no farther
                slack = _SLACK * (1 + hi + d + (t if math.isfinite(t) else 0.0))
                low = np.maximum(np.maximum(d - hi, lo - d), d / 2) - t - slack
                yield pd.DataFrame({"_qc": c, "_qb": b, "_c": np.arange(n), "_from": low, "_to": d + hi + t + slack})

    asked = rings(test).mapInPandas(bounds, "_qc int, _qb int, _c int, _from double, _to double")
    return (asked.join(rings(train), "_c").where((F.col("_hi") >= F.col("_from")) & (F.col("_lo") <= F.col("_to")))
            .select("_qc", "_qb", "_c", "_b"))


def _nearest(tp: pd.DataFrame, qp: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k nearest of ``tp`` for each row of ``qp``; ties by id."""
    if not len(tp) or not len(qp):
        return pd.DataFrame({"_id": [], "d": [], "t": [], "y": []})
    tp = tp.sort_values("_id", kind="stable")
    x, ids, labels = _stack(tp["_v"]), tp["_id"].to_numpy(), tp["_y"].to_numpy()
    norm = (x * x).sum(axis=1)
    out = []
    for at in range(0, len(qp), 256):
        q = _stack(qp["_v"].iloc[at:at + 256])
        near = _squared(q, x)
        kth = np.partition(near, min(k, len(x)) - 1, axis=1)[:, min(k, len(x)) - 1]
        slack = 1e-12 * (norm.max() + (q * q).sum(axis=1)) * x.shape[1]
        row, col = np.nonzero(near <= (kth + 2 * slack)[:, None])
        d = np.empty(len(row))
        for i in range(0, len(row), _PAIRS):  # exact for the candidates: where rows repeat, all pairs may be
            d[i:i + _PAIRS] = ((x[col[i:i + _PAIRS]] - q[row[i:i + _PAIRS]]) ** 2).sum(axis=1)
        order = np.lexsort((ids[col], d, row))
        row, col, d = row[order], col[order], d[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        keep = place < k
        out.append(pd.DataFrame({"_id": qp["_id"].to_numpy()[at:at + 256][row[keep]], "d": d[keep], "t": ids[col[keep]], "y": labels[col[keep]]}))
    return pd.concat(out)


def nearest(train: DataFrame, test: DataFrame, k: int, block_rows: int = 4_096, n_pivots: int = 64) -> DataFrame:
    """(_id, d, t, y): for each test row the k nearest training rows of every block that it met
    (``_id`` long, ``_v`` array; ``_y`` int on the training side); the k least d are the answer."""
    find = lambda a, b: _nearest(a, b, k)
    shape = "_id long, d double, t long, y int"
    rows = train.limit(block_rows + 1).collect()  # a block
    if len(rows) <= block_rows:  # every test row meets the one block
        held = pd.DataFrame({c: [r[c] for r in rows] for c in ("_id", "_y", "_v")})
        shared = train.sparkSession.sparkContext.broadcast(held)
        return test.select("_id", "_v").mapInPandas(lambda parts: (find(shared.value, q) for q in parts), shape)
    from pagelab.operators.models import _written
    pivots = choose_pivots(train, n_pivots)
    a = _written(_blocks(_written(_assigned(train, pivots)), block_rows))
    b = _written(_blocks(_written(_assigned(test, pivots)), block_rows))
    pairs = _written(block_pairs(a, b, pivots, k))
    left = a.join(pairs, ["_c", "_b"]).select("_qc", "_qb", "_c", "_b", "_id", "_v", "_y")
    right = b.withColumnsRenamed({"_c": "_qc", "_b": "_qb"}).join(pairs, ["_qc", "_qb"]).select("_qc", "_qb", "_c", "_b", "_id", "_v")
    keys = ["_qc", "_qb", "_c", "_b"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(find, shape)


def share_met(train: DataFrame, test: DataFrame, k: int, block_rows: int = 4_096, n_pivots: int = 64) -> tuple[int, int]:
    """(pairs of blocks that meet, all pairs of blocks)."""
    pivots = choose_pivots(train, n_pivots)
    a, b = (_blocks(_assigned(x, pivots), block_rows) for x in (train, test))
    n = [x.select("_c", "_b").distinct().count() for x in (a, b)]
    return block_pairs(a, b, pivots, k).count(), n[0] * n[1]
