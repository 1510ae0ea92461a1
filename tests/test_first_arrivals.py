"""L1 with keyed state: first arrivals across restarts, replays, repeats and nulls."""

import datetime as dt
import tempfile

import pytest
from pyspark.sql import functions as F

from pagelab.streaming import ingest as L

SCHEMA = "page_id long, url string, ts timestamp, page string"
START = dt.datetime(2024, 1, 1, 12)


def drained(spark, arrivals, **kw):
    """Each arrival is written and drained by a query of its own, from one checkpoint."""
    src, out, progress = (tempfile.mkdtemp(prefix=f"first-{n}-") for n in ("in", "out", "ckpt"))
    for rows in arrivals:
        rows = [(i, u, None if h is None else START + dt.timedelta(hours=h), p) for i, u, h, p in rows]
        spark.createDataFrame(rows, SCHEMA).repartition(2).write.mode("append").parquet(src)
        s = L.page_stream(spark, src, spark.createDataFrame([], SCHEMA).schema, max_files=None)
        L.run_to_table(L.first_arrivals(s, order=("page_id",), **kw), out, progress)
    got = spark.read.schema(SCHEMA).parquet(f"{out}/batch_id=*")
    return sorted((r["page_id"], r["url"] or "", r["page"]) for r in got.collect())


def test_first_arrival_wins_across_restarts(spark):
    got = drained(spark, [[(1, "a", 0, "first"), (2, "b", 0, "b1")],
                          [(3, "a", 0.5, "second"), (4, "c", 0.2, "c1")],
                          [(5, "b", 1.0, "b2"), (6, "c", 0.1, "earlier, but not first")]])
    assert got == [(1, "a", "first"), (2, "b", "b1"), (4, "c", "c1")]


def test_replay_behind_the_watermark_is_dropped_and_a_new_crawl_is_not(spark):
    got = drained(spark, [[(1, "a", 0, "first")], [(2, "z", 6, "moves the watermark")],
                          [(3, "a", 3, "two hours late"), (4, "q", 2, "late as well")],
                          [(5, "a", 6.5, "crawled anew")], [(6, "a", 7, "known again")]])
    assert got == [(1, "a", "first"), (2, "z", "moves the watermark"), (5, "a", "crawled anew")]


def test_ties_repeats_nulls_and_empty_arrivals(spark):
    hot = [(100 - k, "hot", 0, f"p{100 - k}") for k in range(60)]
    got = drained(spark, [[], hot + hot, [(7, None, 0, None), (8, None, 0, "x"), (9, "d", None, "no time")], []])
    assert got == [(7, "", None), (41, "hot", "p41")]


def test_state_lives_longer_with_a_longer_ttl(spark):
    arrivals = [[(1, "a", 0, "first")], [(2, "z", 6, "z")], [(3, "a", 6.5, "known for ten hours")]]
    assert drained(spark, arrivals, ttl="10 hours") == [(1, "a", "first"), (2, "z", "z")]


def test_ttl_must_be_positive(spark):
    with pytest.raises(ValueError):
        L.first_arrivals(spark.createDataFrame([], SCHEMA).withColumn("ts", F.col("ts")), ttl="0 hours")
