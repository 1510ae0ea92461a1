"""Forests grown by regions, Shapley values by walks, and pages that arrive as a folder."""

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

import __spark_entry__ as E
from pagelab.operators import bagged as BG, forest as FO, models as M


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(1500, 6)), 2)
    y = ((x[:, 0] + x[:, 1] * x[:, 2] > 0) ^ (rng.random(1500) < 0.05)).astype(int)
    rows = [(i, int(b), a.tolist()) for i, (a, b) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "page_id long, label int, v array<double>")
    return df.select("page_id", "label", array_to_vector("v").alias("features")).persist(), x, y


def _share(df, m):
    return {r.page_id: r.p for r in m.transform(df).select("page_id", M.prob1().alias("p")).collect()}


@pytest.mark.parametrize("region_rows", [100, 65_536])
def test_forest_of_regions(spark, table, region_rows, monkeypatch):
    """Upper levels by sums over many blocks, subtrees by their own rows: the same learner."""
    monkeypatch.setattr(BG, "BLOCK_ROWS", 200)
    df, x, y = table
    m = M.create_model("structural_rf", numTrees=8, maxDepth=12, regionRows=region_rows).fit(df.where("page_id < 1000"))
    share = _share(df, m)
    p = np.array([share[i] for i in range(1500)])
    assert np.mean((p[1000:] > 0.5) == y[1000:]) > 0.75 and np.mean((p[:1000] > 0.5) == y[:1000]) > 0.9
    assert set(np.argsort(m.featureImportances.toArray())[-3:]) == {0, 1, 2}
    f = m.forest
    assert len(f.roots) == 8 and f.depth() <= 12
    inner = np.flatnonzero(f.feature >= 0)  # no two sibling leaves say the same
    a, b = f.left[inner], f.right[inner]
    both = (f.feature[a] < 0) & (f.feature[b] < 0)
    assert both.any() and ((f.value[a] * 8 > 0.5) != (f.value[b] * 8 > 0.5))[both].all()


def test_subtree_counts():
    """A fully grown tree gives each distinct row the share of ones among its copies, weights counted."""
    rng = np.random.default_rng(2)
    bins = rng.integers(0, 4, (300, 1)).astype(np.uint8)
    times, ones = rng.integers(1, 4, 300).astype(float), rng.integers(0, 2, 300).astype(float)
    f, cut, left, value, _ = BG._subtree(bins, times, ones, 10, 1, rng)
    levels = [(times * ones)[bins[:, 0] == b].sum() / times[bins[:, 0] == b].sum() for b in range(4)]
    root = (times * ones).sum() / times.sum()
    if (f >= 0).any():
        got = []
        for b in range(4):
            i = 0
            while f[i] >= 0:
                i = left[i] + (b > cut[i])
            got.append(value[i])
        assert all((g > 0.5) == (w > 0.5) or abs(g - w) < 0.5 for g, w in zip(got, levels))
    else:
        assert value[0] == pytest.approx(root)


def test_forest_one_class_and_bad_input(spark, table):
    df = table[0]
    m = M.create_model("structural_rf", numTrees=3).fit(df.withColumn("label", F.lit(0)))
    assert set(_share(df, m).values()) == {0.0}
    with pytest.raises(ValueError):
        M.create_model("structural_rf").fit(df.limit(0))
    with pytest.raises(ValueError):
        M.create_model("structural_rf").fit(df.withColumn("label", F.lit(2)))


def test_forest_in_a_pipeline_saved_and_loaded(spark, table, tmp_path):
    df = table[0]
    pm = Pipeline(stages=[M.create_model("structural_rf", numTrees=4, regionRows=300)]).fit(df)
    pm.write().overwrite().save(str(tmp_path / "m"))
    back = PipelineModel.load(str(tmp_path / "m"))
    assert _share(df, back) == _share(df, pm)
    assert np.array_equal(back.stages[0].featureImportances.toArray(), pm.stages[0].featureImportances.toArray())


def test_walks_give_the_leaves_values(spark, table, monkeypatch):
    """Walks come to the same contributions as sums over all leaves, also in small pieces."""
    df, x, _ = table
    f = M.create_model("structural_rf", numTrees=5, maxDepth=8, regionRows=200).fit(df).forest
    want = f.leaves().shapley(x[:9], x[50:53])
    assert f.walks().shapley(x[:9], x[50:53]) == pytest.approx(want, abs=1e-12)
    monkeypatch.setattr(FO, "WAYS", 256)
    assert f.walks().shapley(x[:9], x[50:53]) == pytest.approx(want, abs=1e-12)
    assert want.sum(axis=1) == pytest.approx(f.score(x[:9]) - f.score(x[50:53]).mean(), abs=1e-12)


@pytest.mark.parametrize("cuts", [9, 400])
def test_walks_compare_places_of_values(cuts, monkeypatch):
    """Values on, between and beyond the cuts, missing ones too, in one byte a value or two."""
    rng = np.random.default_rng(6)
    trees, depth, width = 40, 6, 4
    n = 2 ** (depth + 1) - 1
    node = np.arange(n)
    inner = node < n // 2
    one = np.where(inner, 2 * node + 1, 0)
    feature = np.where(np.tile(inner, trees), rng.integers(0, width, n * trees), -1)
    left = np.concatenate([np.where(inner, one + t * n, 0) for t in range(trees)])
    f = FO.Forest(feature, rng.integers(0, cuts, n * trees).astype(float), left, left + 1, rng.normal(size=n * trees), np.arange(trees) * n)
    x, back = rng.integers(-1, 2 * cuts + 1, (30, width)) / 2, rng.integers(0, 2 * cuts, (3, width)) / 2
    x[0, 1], x[1, 2], x[2, 0] = np.nan, np.inf, -np.inf
    walks = f.walks()
    assert walks.cut.dtype == (np.uint8 if cuts < 255 else np.uint16)
    got = walks.shapley(x, back)
    monkeypatch.setattr(FO, "ROWS", 7)
    assert walks.shapley(x, back) == pytest.approx(got, abs=1e-12)
    held = [1, *range(3, 30)]  # a path's interval has no place for a missing value or -inf
    assert got[held] == pytest.approx(f.leaves().shapley(x[held], back), abs=1e-9)
    assert got.sum(axis=1) == pytest.approx(f.score(x) - f.score(back).mean(), abs=1e-9)


def test_stream_score_of_a_folder_of_files(spark, tmp_path):
    """Pages in several part files are scored as pages in one file are."""
    rows = [(i, f"https://h{i % 7}.example/{'en' if i % 3 else 'de'}/{i}",
             f"<html lang=\"{'en' if i % 3 else 'de'}\"><body><p>{'x' * (i % 11)}</p></body></html>") for i in range(60)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    df.repartition(3).write.parquet(str(tmp_path / "many" / "pages.parquet"))
    df.toPandas().to_parquet(tmp_path / "pages.parquet")
    got = [E.queries()["stream_score"](spark, str(p)).collect() for p in (tmp_path / "many", tmp_path)]
    many, one = ({r.page_id: (r.prediction, round(r.p1, 6)) for r in g} for g in got)
    assert len(got[0]) == 60 and many == one
