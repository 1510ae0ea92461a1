"""Term look-ups whose Python side is bounded by rows, not by the size of the pages."""

import math
from collections import Counter

import pytest

from pagelab.operators import heavy as HV, text as T

DOCS = [(1, ["a", "b", "a", "x"]), (1, ["a", "b", "a", "x"]), (None, ["b"]), (None, ["b", "a"]), (2, []), (3, None), (4, ["x"]),
        (5, ["b", "c", None, "a", "a"])]


@pytest.fixture
def docs(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    yield spark.createDataFrame(DOCS, "k long, t array<string>").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_documents_across_batches_keep_their_norm(spark, docs):
    vocab = spark.createDataFrame([("a", 0, 1.5), ("b", 1, 2.0), ("c", 2, 3.0)], "term string, idx int, idf double")
    docs = docs.where("k is null or k < 5")
    want = []
    for k, terms in DOCS[:-1]:
        tf = Counter(terms or [])
        w = {t: tf[t] * idf for t, idf in (("a", 1.5), ("b", 2.0), ("c", 3.0)) if tf[t]}
        norm = math.sqrt(sum(v * v for v in w.values()))
        want += [(k, t, "abc".index(t), round(v / norm, 12)) for t, v in w.items()]
    got = T.tfidf_transform(docs, "k", "t", vocab)
    rows = [(r["k"], r["term"], r["idx"], round(r["weight"], 12)) for r in got.collect()]
    assert sorted(rows, key=repr) == sorted(want, key=repr)
    assert "Generate" in got._jdf.queryExecution().toString()  # terms, not whole documents, are sent to Python


def test_ids_are_looked_up_a_few_rows_at_a_time(spark, docs, monkeypatch):
    vocab = spark.createDataFrame([("a", 2), ("b", 3)], "term string, id int")
    monkeypatch.setattr(T, "_ID_ROWS", 3)
    got = T.ids_from_vocab(docs, "k", "t", vocab, 3)
    assert sorted(([r["k"], list(r["ids"])] for r in got.collect()), key=repr) == sorted(
        ([k, (ids := [{"a": 2, "b": 3}.get(t, 1) for t in (terms or [])[:3]]) + [0] * (3 - len(ids))] for k, terms in DOCS), key=repr)
    assert "MapInArrow" in got._jdf.queryExecution().toString()


def test_summaries_of_slices_are_exact(docs, monkeypatch):
    monkeypatch.setattr(HV, "ROWS", 3)
    got = {r["term"]: (r["total"], r["df"]) for r in HV.frequent_terms(docs, "t", 2, size=2).collect()}
    assert got == {"a": (7, 4), "b": (5, 5)}


def test_grams_are_looked_up_by_hash_before_they_are_counted(spark):
    from pagelab.operators.vector import tfidf_in_row
    terms = [f"t{i:02d}" for i in range(20)]
    df = spark.createDataFrame([(1, ["t01", "zz", "t00", "t01", None]), (2, []), (3, ["zz"])], "k int, g array<string>")
    out = df.select("k", tfidf_in_row(df.g, terms, [2.0] * 20).alias("w"))
    got = {r["k"]: r["w"] for r in out.collect()}
    assert got[1] == pytest.approx([1 / math.sqrt(5), 2 / math.sqrt(5)] + [0.0] * 18)
    assert got[2] == got[3] == [0.0] * 20
    assert "INSET" in out._jdf.queryExecution().optimizedPlan().toString()
