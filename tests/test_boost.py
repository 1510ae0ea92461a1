"""Second-order booster and exact tree Shapley values against brute force."""

import itertools
import math

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from pagelab.operators import boost as B, forest as FO


def table(spark, n=500, d=8, seed=0, parts=4):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, d)), 1)
    x[:, 0] = rng.integers(0, 3, n)
    x[:, d - 1] = 1.0  # constant
    y = (x[:, 0] + x[:, 1] * x[:, 2] + 0.5 * rng.normal(size=n) > 0.8).astype(float)
    rows = [(i, float(y[i]), int(i % 5), Vectors.dense(x[i])) for i in range(n)]
    return spark.createDataFrame(rows, ["page_id", "label", "fold", "features"]).repartition(parts), x, y


def brute_boost(x, y, s, on, n):
    """Margins of all rows from trees grown on the rows ``on``, every cut tried for every node."""
    cuts = [np.unique(x[:, j]) for j in range(x.shape[1])]
    cuts = [(c[1:] + c[:-1]) / 2 for c in cuts]
    prior = y[on].mean()
    margin = np.full(len(x), 0.0 if s.second_order else math.log(prior / (1 - prior)))
    for _ in range(n):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        w = h if s.second_order else np.ones(len(x))
        l2, least = (s.reg_lambda, s.min_hessian) if s.second_order else (0.0, 1.0)
        step = np.zeros(len(x))

        def grow(rows, depth):
            fit = rows & on
            worth = lambda m: g[m].sum() ** 2 / (w[m].sum() + l2)
            best = (1e-12, None)
            if depth < s.depth:
                for j, c in itertools.product(range(x.shape[1]), range(256)):
                    if c < len(cuts[j]):
                        left = fit & (x[:, j] <= cuts[j][c])
                        right = fit & ~left
                        if left.any() and right.any() and w[left].sum() >= least and w[right].sum() >= least:
                            gain = (worth(left) + worth(right) - worth(fit)) / 2 - s.gamma
                            if gain > best[0] * (1 + 1e-9):
                                best = (gain, (j, c))
            if best[1] is None:
                step[rows] = -s.rate * g[fit].sum() / (h[fit].sum() + s.reg_lambda)
                return
            j, c = best[1]
            grow(rows & (x[:, j] <= cuts[j][c]), depth + 1)
            grow(rows & (x[:, j] > cuts[j][c]), depth + 1)
        grow(np.ones(len(x), bool), 0)
        margin += step
    return margin


@pytest.mark.parametrize("settings", [dict(rounds=8, depth=3, rate=0.3), dict(rounds=5, depth=4, rate=0.3, second_order=False, reg_lambda=0.0),
                                      dict(rounds=4, depth=2, gamma=0.5, min_hessian=4.0, reg_lambda=3.0)])
def test_splits_equal_brute_force(spark, settings):
    df, x, y = table(spark)
    s = B.Settings(**settings)
    full, held = B.fit_many(df, [B.Spec(s, tuple(range(8))), B.Spec(s, tuple(range(8)), without_fold=2)], fold="fold", block_rows=150)
    on = np.arange(500) % 5 != 2
    assert full.forest.score(x) == pytest.approx(brute_boost(x, y, s, np.ones(500, bool), s.rounds), abs=1e-9)
    assert held.forest.score(x) == pytest.approx(brute_boost(x, y, s, on, s.rounds), abs=1e-9)


def test_models_fitted_together_equal_models_fitted_alone(spark, monkeypatch):
    df, x, _ = table(spark, seed=3)
    specs = [B.Spec(B.Settings(rounds=6, depth=4), tuple(range(3))), B.Spec(B.Settings(rounds=12, depth=2, row_share=0.7), tuple(range(2, 8))),
             B.Spec(B.Settings(rounds=7, depth=3, column_share=0.5), tuple(range(8)))]
    together = [m.forest.score(x) for m in B.fit_many(df, specs, block_rows=100)]
    for m, t in zip(B.fit_many(df, specs), together):  # one block: models grow apart
        assert m.forest.score(x) == pytest.approx(t, abs=1e-9)
    monkeypatch.setattr(B, "CELLS", 64)  # a pass for every node or so
    alone = [B.fit_many(df.repartition(2), [s], block_rows=250)[0].forest.score(x) for s in specs]
    for a, b in zip(together, alone):
        assert a == pytest.approx(b, abs=1e-9)


def test_margins_are_recomputed_where_they_are_missing():
    rng = np.random.default_rng(1)
    bins = rng.integers(0, 5, (30, 2)).astype(np.uint8)
    trees = []
    for k in range(4):
        t = B.Tree()
        t.split(0, k % 2, k, 1.0)
        t.value[1:] = [0.5 * k, -1.0]
        trees.append([(0, t.packed())])
    B._MARGINS.clear()
    base = np.zeros(1)
    step = [B._margins("r", 0, bins, base, [trees[:k]]).copy() for k in range(5)][-1]
    B._MARGINS.clear()
    assert (B._margins("r", 0, bins, base, [trees[:2], trees[2:]]) == step).all() and step.any()


def test_estimator_round_trip(spark, tmp_path):
    df, x, y = table(spark, n=300, seed=5)
    model = B.HistBooster(rounds=60, depth=3).fit(df)
    out = {r["page_id"]: (r["probability"][1], r["prediction"]) for r in model.transform(df).collect()}
    margin = model.boosted.forest.score(x)
    assert [out[i][0] for i in range(300)] == pytest.approx((1 / (1 + np.exp(-margin))).tolist())
    assert np.mean([out[i][1] == y[i] for i in range(300)]) > 0.85
    assert model.featureImportances.toArray().sum() == pytest.approx(1.0)
    model.save(spark, str(tmp_path))
    again = B.HistBoosterModel.load(spark, str(tmp_path))
    assert (again.boosted.forest.score(x) == margin).all()
    with pytest.raises(ValueError):
        B.HistBooster(rounds=1).fit(df.limit(0))


def test_sketched_cuts_are_close_to_even(spark):
    rng = np.random.default_rng(2)
    x = rng.exponential(size=20_000)
    df = spark.createDataFrame([(i, Vectors.dense(v, 1.0)) for i, v in enumerate(x.tolist())], ["page_id", "features"]).repartition(6)
    cuts, none = B.cut_points(df, 2, bins=64)
    share = np.diff(np.searchsorted(np.sort(x), cuts)) / len(x)
    assert len(cuts) == 63 and len(none) == 0 and share.max() < 2 / 64


# -- Shapley values ----------------------------------------------------------------------
def brute_shapley(score, x, background):
    d = x.shape[1]
    out = np.zeros(x.shape)
    for i, row in enumerate(x):
        value = {}
        for k in range(d + 1):
            for s in itertools.combinations(range(d), k):
                mixed = background.copy()
                mixed[:, list(s)] = row[list(s)]
                value[frozenset(s)] = score(mixed).mean()
        for s, v in value.items():
            for j in set(range(d)) - s:
                out[i, j] += math.factorial(len(s)) * math.factorial(d - len(s) - 1) / math.factorial(d) * (value[s | {j}] - v)
    return out


def test_tree_shapley_equals_all_subsets(spark, tmp_path):
    from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
    df, x, _ = table(spark, n=200, seed=7)
    back = x[:5]
    models = {"boost": B.HistBooster(rounds=6, depth=4, rate=0.5).fit(df).boosted.forest}
    fitted = RandomForestClassifier(numTrees=5, maxDepth=6, seed=1).fit(df)
    models["forest"] = FO.of_spark(spark, fitted, f"{tmp_path}/rf")
    gbt = GBTClassifier(maxIter=4, maxDepth=3, seed=1).fit(df)
    models["gbt"] = FO.of_spark(spark, gbt, f"{tmp_path}/gbt")
    p = {r["page_id"]: r["probability"][1] for r in fitted.transform(df).collect()}
    assert models["forest"].score(x) == pytest.approx([p[i] for i in range(200)], abs=1e-12)
    p = {r["page_id"]: r["probability"][1] for r in gbt.transform(df).collect()}
    assert 1 / (1 + np.exp(-2 * models["gbt"].score(x))) == pytest.approx([p[i] for i in range(200)], abs=1e-12)
    for name, f in models.items():
        got = f.leaves().shapley(x[:12], back)
        assert got == pytest.approx(brute_shapley(f.score, x[:12], back), abs=1e-12), name
        assert got.sum(axis=1) == pytest.approx(f.score(x[:12]) - f.score(back).mean(), abs=1e-9)


def test_tree_shapley_rows(spark, monkeypatch):
    df, x, _ = table(spark, n=60, seed=8)
    f = B.HistBooster(rounds=3, depth=3).fit(df).boosted.forest
    names = [f"c{j}" for j in range(8)]
    back = x[:3].tolist()
    rows = FO.tree_shapley(df, f, names, back).collect()
    whole = f.leaves().shapley(x, x[:3])
    assert len(rows) == 60 * 8 and {r["feature"] for r in rows} == set(names)
    assert all(r["contribution"] == pytest.approx(whole[r["page_id"], names.index(r["feature"])], abs=1e-12) for r in rows)
    assert {round(r["base_value"], 12) for r in rows} == {round(float(f.score(x[:3]).mean()), 12)}
    assert FO.tree_shapley(df, f, names, back, only=["c2"]).count() == 60
    monkeypatch.setattr(FO, "CELLS", 64)
    assert f.leaves().shapley(x, x[:3]) == pytest.approx(whole, abs=1e-12)


@pytest.mark.parametrize("region_rows", [1, 60, 100_000])
def test_nodes_grown_by_one_task_equal_nodes_grown_by_passes(spark, region_rows):
    df, x, _ = table(spark, seed=4)
    specs = [B.Spec(B.Settings(rounds=5, depth=5), tuple(range(8)), without_fold=1),
             B.Spec(B.Settings(rounds=4, depth=4, row_share=0.8, column_share=0.6), tuple(range(1, 8))),
             B.Spec(B.Settings(rounds=3, depth=3, second_order=False, reg_lambda=0.0), tuple(range(8)))]
    one = B.fit_many(df, specs, fold="fold")  # one block
    for a, b in zip(one, B.fit_many(df, specs, fold="fold", block_rows=100, region_rows=region_rows)):
        assert b.forest.score(x) == pytest.approx(a.forest.score(x), abs=1e-9)
        assert b.forest.importance(b.gain, 8) == pytest.approx(a.forest.importance(a.gain, 8), abs=1e-9)


def test_a_round_of_small_nodes_takes_two_jobs_whatever_the_depth(spark):
    df, _, _ = table(spark, seed=6)
    sc, jobs = spark.sparkContext, {}
    for depth in (2, 7):
        sc.setJobGroup(f"boost_depth_{depth}", "")
        B.fit_many(df, [B.Spec(B.Settings(rounds=6, depth=depth, min_hessian=0.1), tuple(range(8)))], block_rows=150)
        jobs[depth] = len(sc.statusTracker().getJobIdsForGroup(f"boost_depth_{depth}"))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[7] <= jobs[2] + 2


def test_tables_of_some_blocks_are_grown_without_passes(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(21_000, 3))  # more than a block
    rows = zip(range(len(x)), (x[:, 0] + rng.normal(size=len(x)) > 0).astype(int).tolist(), map(Vectors.dense, x))
    df = spark.createDataFrame(list(rows), ["page_id", "label", "features"]).repartition(2)
    sc, jobs = spark.sparkContext, []
    for rounds in (1, 4):
        sc.setJobGroup(f"whole{rounds}", "")
        fitted = B.fit_many(df, [B.Spec(B.Settings(rounds=rounds, depth=3), (0, 1, 2))])[0]
        jobs.append(len(sc.statusTracker().getJobIdsForGroup(f"whole{rounds}")))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[0] == jobs[1]
    passes = B.fit_many(df, [B.Spec(B.Settings(rounds=4, depth=3), (0, 1, 2))], task_cells=0)[0]
    assert passes.forest.score(x) == pytest.approx(fitted.forest.score(x), abs=1e-9)


def test_sums_of_a_larger_child_are_the_parents_less_the_smaller_ones():
    rng = np.random.default_rng(12)
    bins = np.asfortranarray(rng.integers(0, 40, (3_000, 5)).astype(np.uint8))
    label = (bins[:, 0] + rng.normal(size=3_000) * 9 > 20).astype(float)
    g, h = B._slopes(rng.normal(size=3_000), label)
    n_bins, own, asked = np.full(5, 40), np.arange(5), []

    def counted(bins, slope, rows, *rest):
        asked.extend(map(len, rows))
        return sums(bins, slope, rows, *rest)
    sums, B._held_sums = B._held_sums, counted
    try:
        s = B.Settings(depth=4)
        tree, leaves = B._held_tree(bins, g, h, np.arange(3_000), s, 4, own, n_bins, own)
        assert sum(asked) <= 3_000 * (1 + 3 / 2)  # the root, and at most half of the rows on each level below
        cells, B.CELLS = B.CELLS, 1  # no sums are kept
        again, _ = B._held_tree(bins, g, h, np.arange(3_000), s, 4, own, n_bins, own)
    finally:
        B._held_sums, B.CELLS = sums, cells
    assert again == tree and sorted(np.concatenate([r for _, r in leaves]).tolist()) == list(range(3_000))
