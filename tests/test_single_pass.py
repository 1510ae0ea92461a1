"""Queries look at every page once."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagelab.operators import drift as DR
from pagelab.operators.vector import StructuralFeaturizer
from pagelab.plans import catalog, q_models as QM, q_profile as QP

ROWS = 24


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Pages of two languages, one without html and one held twice."""
    page = "<html lang='{0}'><head><title>Shop {1}</title></head><body>{2}<a href='http://a{1}.com/'>x</a></body></html>".replace("'", '"')
    rows = [(i, f"http://a{i}.com/{'login' if i % 3 else 'x'}/{i}", page.format("en" if i % 2 else "de", i, "<p>t</p>" * (i % 5)))
            for i in range(ROWS - 2)]
    rows += [(ROWS, "http://b.org/", None), rows[0]]
    path = str(tmp_path_factory.mktemp("once"))
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    return path


@pytest.fixture
def seen(spark, monkeypatch):
    """An accumulator of the pages that the queries have looked at."""
    count, pages = spark.sparkContext.accumulator(0), catalog.pages

    @F.udf("string")
    def look(html):
        count.add(1)
        return html
    look = look.asNondeterministic()
    monkeypatch.setattr(catalog, "pages", lambda s, sf: pages(s, sf).withColumn("html", look("html")))
    monkeypatch.setattr(QM, "_FEATURES", {})
    return count


def test_model_features_are_extracted_once(spark, folder, seen):
    path, names = QM._features(spark, folder)
    got = spark.read.parquet(path)
    assert got.count() == ROWS and len(got.first()["features"]) == len(names)
    assert seen.value == ROWS


def test_fit_transform_is_fit_and_transform(spark, folder):
    p = catalog.pages(spark, folder)
    model, got = StructuralFeaturizer().fit_transform(p, keep=("label", "era"))
    again = StructuralFeaturizer().fit(p)
    assert (model.bounds, model.vocabs) == (again.bounds, again.vocabs)
    rows = [sorted((r["page_id"], r["label"], r["era"], tuple(np.round(r["features"], 9) + 0.0)) for r in x.collect())
            for x in (got, again.transform(p, keep=("label", "era")))]
    assert rows[0] == rows[1] and len(rows[0]) == ROWS


def test_tokens_of_the_sequence_model_are_made_once(spark, folder, seen):
    assert QM.q_seq(spark, folder).count() == 1
    assert seen.value == ROWS


def test_radar_reads_its_table_twice(spark):
    count = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def look(x):
        count.add(1)
        return x
    df = spark.createDataFrame([(0, 0.0, 1.0, 7.0), (0, 10.0, 3.0, 7.0), (1, 5.0, None, 7.0)], "label int, a double, b double, c double")
    df = df.withColumn("a", look.asNondeterministic()("a"))
    got = DR.radar_profile(df, ["a", "b", "c"], {"one": ["a"], "two": ["a", "b"], "three": ["c"]})
    assert got.columns == ["label", "category", "score"]
    assert sorted(map(tuple, got.collect())) == [(0, "one", 0.5), (0, "three", 0.0), (0, "two", 0.5), (1, "one", 0.5), (1, "three", 0.0), (1, "two", None)]
    assert count.value == 6  # the bounds, and the means of all groups


def test_base_columns_are_a_table_and_not_held_by_executors(spark, folder, seen, monkeypatch):
    monkeypatch.setattr(QP, "_BASE", {})
    b = QP.base(spark, folder)
    assert not b.storageLevel.useMemory and not b.storageLevel.useDisk
    assert QP.q_radar(spark, folder).count() == 2 * len(QP.RADAR)
    assert b.count() == ROWS and seen.value == ROWS
