"""Invariants on the given sf0.001 tables."""

import pytest
from pyspark.sql import functions as F

from pagelab.functions import dom as DF
from pagelab.operators import scale, text as T
from pagelab.operators.features import BASE_28, structural_base
from pagelab.plans import catalog
from pagelab.sources import pages as P


def test_tfidf_norms_are_zero_or_one(spark, sf001):
    p = P.table(spark, sf001, "pages")
    d = p.select("page_id", T.word_ngrams(DF.tag_sequence("html"), 2, 3).alias("g"))
    _, w = T.tfidf_fit_transform(d, "page_id", "g", 50)
    norms = w.groupBy("page_id").agg(F.sqrt(F.sum(F.col("weight") ** 2)).alias("n")).collect()
    assert norms and all(r.n == pytest.approx(1.0) for r in norms)


def test_zscore_train_moments(spark, sf001):
    b = structural_base(catalog.pages(spark, sf001), keep=("page_id",))
    z = scale.zscore_apply(b, scale.zscore_fit(b, BASE_28), BASE_28)
    st = z.agg(*[F.avg(c).alias(f"m_{c}") for c in BASE_28], *[F.stddev_pop(c).alias(f"s_{c}") for c in BASE_28]).first()
    for c in BASE_28:
        assert abs(st[f"m_{c}"]) < 1e-9
        assert st[f"s_{c}"] == pytest.approx(1.0) or st[f"s_{c}"] == pytest.approx(0.0, abs=1e-12)
