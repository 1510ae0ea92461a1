"""Draws, rungs and promotion of the halving search; reruns agree."""

import json
import random

import pytest
from pyspark.ml.linalg import Vectors

from pagelab.operators import search as SR


def table(spark, n=240, seed=1):
    rnd, rows = random.Random(seed), []
    for i in range(n):
        x = [rnd.random() for _ in range(4)]
        rows.append((i, int(x[0] + 0.5 * x[1] > 0.75), Vectors.dense(x)))
    return spark.createDataFrame(rows, ["page_id", "label", "features"])


def test_draws_stay_in_their_space_and_repeat():
    for t in range(200):
        s = SR.draw(SR.NETWORK_SPACE, t)
        assert s == SR.draw(SR.NETWORK_SPACE, t)
        assert s["units"] in (32, 64, 128) and 1 <= s["layers"] <= 3 and 0.2 <= s["dropout"] <= 0.6 and 1e-4 <= s["rate"] <= 1e-2
    assert {SR.draw(SR.NETWORK_SPACE, t)["layers"] for t in range(200)} == {1, 2, 3}
    assert SR.draw(SR.NETWORK_SPACE, 0) != SR.draw(SR.NETWORK_SPACE, 0, seed=43)
    with pytest.raises(ValueError):
        SR.draw({"x": ("bell", 0, 1)}, 0)


def test_rungs():
    assert [n for n, _ in SR.rungs(9, 3)] == [9, 3, 1] and [round(s, 6) for _, s in SR.rungs(9, 3)] == [0.111111, 0.333333, 1.0]
    assert SR.rungs(1, 3) == [(1, 1.0)]
    assert [n for n, _ in SR.rungs(10, 4)] == [10, 2, 1]


def test_promotion_follows_the_scores(spark):
    """Brute force on planted scores: the better half goes on, ties by number, each rung's rows nested."""
    seen = []

    def scores(df, trials, folds, key):
        seen.append(({r[key] for r in df.select(key).collect()}, sorted(trials)))
        return {t: [(10, 5 + (t % 3))] * folds for t in trials}
    SR.SEARCHES["planted"] = ({"a": ("real", 0.0, 1.0)}, scores)
    try:
        got = SR.successive_halving(table(spark), "planted", trials=8, eta=2).collect()
    finally:
        del SR.SEARCHES["planted"]
    assert [t for _, t in seen] == [list(range(8)), [1, 2, 4, 5], [2, 5], [2]]
    assert all(a <= b for (a, _), (b, _) in zip(seen, seen[1:])) and len(seen[-1][0]) == 240
    best = [r for r in got if r["best"]]
    assert len(best) == 1 and best[0]["trial"] == 2 and abs(best[0]["cv_accuracy"] - 0.7) < 1e-12


@pytest.mark.parametrize("model", ["boosted_trees", "logistic_regression"])
def test_searches_run_and_reruns_agree(spark, model, monkeypatch):
    small = dict(SR.BOOSTED_SPACE, rounds=("choice", (5, 10)), depth=("whole", 2, 3))
    monkeypatch.setitem(SR.SEARCHES, "boosted_trees", (small, SR.boosted_scores))
    a, b = (SR.successive_halving(table(spark).repartition(p), model, trials=4, eta=2).collect() for p in (2, 5))
    assert sorted(a) == sorted(b) and len(a) == 4 + 2 + 1
    best = [r for r in a if r["best"]]
    assert len(best) == 1 and best[0]["rung"] == 2 and best[0]["rows"] == 240 and best[0]["cv_accuracy"] > 0.8
    assert json.loads(best[0]["settings"]) == SR.draw(SR.SEARCHES[model][0], best[0]["trial"])


def test_the_network_is_searched(spark):
    got = SR.successive_halving(table(spark, 90), "dense_network", trials=2, eta=2, folds=2).collect()
    assert len(got) == 3 and sum(r["best"] for r in got) == 1 and all(0 <= r["cv_accuracy"] <= 1 for r in got)


def test_unknown_names_and_empty_tables(spark):
    with pytest.raises(ValueError):
        SR.successive_halving(table(spark), "oracle")
    with pytest.raises(ValueError):
        SR.successive_halving(table(spark).where("page_id < 0"), "logistic_regression")
