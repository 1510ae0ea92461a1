"""Driver contract: registry consistency, entry smoke run, a few queries on sf0.001."""

import __spark_entry__ as E


def test_oracle_keys_are_queries():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 100


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert rows and set(df.columns) == {"label", "feature", "mean", "n"}


def test_streaming_equals_batch(spark, sf001):
    """L1: the streamed, validated, de-duplicated sink equals the batch form."""
    from pyspark.sql import functions as F
    from pagelab.operators import clean
    from pagelab.sources import pages as P
    q = E.queries()["stream_ingest_dedup"](spark, sf001)
    p = P.table(spark, sf001, "pages")
    known = p.where(F.col("url").startswith("https://") & F.col("url").contains("/en/")).select("url")
    b = clean.page_validity_filter(p).join(known, "url", "left_anti")
    assert sorted(r.page_id for r in q.collect()) == sorted(r.page_id for r in b.collect())


def test_arrivals_of_many_files_keep_every_page(spark, tmp_path):
    """L1: an arrival of several files is one micro-batch, and no page is late for it."""
    import os
    from glob import glob
    from pyspark.sql import functions as F
    from pagelab.session import scratch_path
    pages = spark.range(1, 8001, 1, 4).select(
        F.col("id").alias("page_id"), F.format_string("http://x.org/%d", "id").alias("url"), F.repeat(F.lit("word "), 30).alias("html"))
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    written = lambda: set(glob(os.path.join(scratch_path(spark, "arrivals_*").removeprefix("file:"), "*.parquet")))
    before = written()
    q = E.queries()["stream_ingest_dedup"](spark, str(tmp_path))
    assert sorted(r.page_id for r in q.collect()) == list(range(1, 8001))
    assert len(written() - before) > 3  # no arrival goes through one task


def test_shapley_additivity(spark, sf001):
    """Contributions of a row sum to f(x) - mean background score."""
    from pyspark.sql import functions as F
    from pagelab.operators import explain, models as M
    from pagelab.operators.features import BASE_28, structural_base
    from pagelab.plans import catalog
    b = M.assemble(structural_base(catalog.pages(spark, sf001), keep=("page_id", "label")), BASE_28)
    m = M.create_model("structural_rf", numTrees=10, maxDepth=4).setLabelCol("label").fit(b)
    s = explain.shapley_sampling(b, m, BASE_28, n_perm=2, n_background=2)
    tot = s.groupBy("page_id").agg(F.sum("contribution").alias("c"), F.first("base_value").alias("b"))
    f = m.transform(b).select("page_id", M.prob1().alias("f"))
    for r in tot.join(f, "page_id").collect():
        assert abs(r.c - (r.f - r.b)) < 1e-9


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_url_queries_prune_html(spark, sf001):
    """Column pruning reaches the parquet scan: URL features never read html."""
    p = _plan(E.queries()["url_structural_features"](spark, sf001))
    assert "ReadSchema: struct<page_id:bigint,url:string>" in p or "page_id:bigint,url:string>" in p
    assert "html" not in p.split("ReadSchema")[1].split(">")[0]


def test_per_page_features_are_narrow(spark, sf001):
    """DOM/pattern features add no shuffle beyond the input spread."""
    p = _plan(E.queries()["dom_tree_features"](spark, sf001))
    assert p.count("Exchange") <= 1
