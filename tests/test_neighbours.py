"""Pivot k-NN against brute force; blocks that cannot hold a neighbour do not meet."""

import numpy as np
import pytest

from pagelab.operators import models as M, neighbours as N


def frames(spark, x, y, q):
    t = spark.createDataFrame([(i, int(c), v.tolist()) for i, (c, v) in enumerate(zip(y, x))], "vec_id long, label int, embedding array<double>")
    s = spark.createDataFrame([(10_000 + i, v.tolist()) for i, v in enumerate(q)], "vec_id long, embedding array<double>")
    return t.repartition(3), s.repartition(3)


def clustered(rng, n, d=6, clusters=9, spread=0.05):
    centre = rng.normal(size=(clusters, d)) * 4
    return centre[rng.integers(0, clusters, n)] + rng.normal(size=(n, d)) * spread


@pytest.mark.parametrize("kind", ["clustered", "spread", "repeated"])
def test_neighbours_equal_brute_force(spark, kind):
    rng = np.random.default_rng(5)
    if kind == "clustered":
        x, q = np.split(clustered(rng, 700), [500])
    elif kind == "spread":
        x, q = rng.normal(size=(300, 5)), rng.normal(size=(60, 5)) * 3
    else:  # a third of all rows in one point, ties everywhere
        x, q = np.repeat(rng.integers(0, 3, (60, 3)).astype(float), 5, axis=0), rng.integers(0, 3, (50, 3)).astype(float)
        x[:100] = 1.0
    y = rng.integers(0, 3, len(x))
    t, s = frames(spark, x, y, q)
    k = 4
    got = {r["vec_id"]: (r["prediction"], r["share_1"]) for r in M.knn_classify(t, s, k, block_rows=40, n_pivots=12).collect()}
    assert len(got) == len(q)
    for i, v in enumerate(q):
        near = np.lexsort((np.arange(len(x)), ((x - v) ** 2).sum(axis=1)))[:k]
        votes = y[near].tolist()
        want = min(set(votes), key=lambda c: (-votes.count(c), c))
        assert got[10_000 + i] == (want, votes.count(1) / k), (kind, i)


def test_fewer_training_rows_than_neighbours(spark):
    rng = np.random.default_rng(6)
    t, s = frames(spark, rng.normal(size=(3, 2)), [0, 1, 1], rng.normal(size=(90, 2)))
    got = M.knn_classify(t, s, 5, block_rows=20, n_pivots=2).collect()
    assert len(got) == 90 and {(r["prediction"], round(r["share_1"], 6)) for r in got} == {(1, 0.666667)}


def test_far_blocks_do_not_meet(spark):
    rng = np.random.default_rng(7)
    x = clustered(rng, 3_000)
    rows = spark.createDataFrame([(i, 0, v.tolist()) for i, v in enumerate(x)], "_id long, _y int, _v array<double>")
    met, every = N.share_met(rows, rows.select("_id", "_v"), 5, block_rows=100, n_pivots=24)
    assert met < 0.3 * every


def test_training_rows_of_one_block_travel_to_the_test_rows(spark):
    rng = np.random.default_rng(8)
    x, q = rng.normal(size=(30, 3)), rng.normal(size=(200, 3))
    t, s = frames(spark, x, rng.integers(0, 2, 30), q)
    t, s = (df.withColumnsRenamed({"vec_id": "_id", "label": "_y", "embedding": "_v"}) for df in (t, s))
    met = N.nearest(t, s, 4, block_rows=40)
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "CoGroup" not in plan and "hashpartitioning" not in plan
    got = {}
    for r in met.collect():
        got.setdefault(r["_id"], []).append((r["d"], r["t"]))
    assert len(got) == 200
    for i, v in enumerate(q):
        assert [n for _, n in sorted(got[10_000 + i])] == np.argsort(((x - v) ** 2).sum(axis=1))[:4].tolist()
