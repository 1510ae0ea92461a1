"""Frequent-items summaries: the vocabulary of the full count, proven or widened."""

import random
from collections import Counter

from pagelab.operators import heavy as HV
from pagelab.operators import text as T


def brute(rows, k):
    """{(group): [(term, total, df)]} by plain counting."""
    total, df = {}, {}
    for g, ts in rows:
        ts = [t for t in ts or () if t is not None]
        total.setdefault(g, Counter()).update(ts)
        df.setdefault(g, Counter()).update(set(ts))
    out = {g: [(t, n, df[g][t]) for t, n in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:k]] for g, c in total.items()}
    return {g: v for g, v in out.items() if v}


def got(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: r["rank"]):
        out.setdefault(r["g"], []).append((r["term"], r["total"], r["df"]))
    return out


def frame(spark, rows, parts=6):
    return spark.createDataFrame(rows, "g string, t array<string>").repartition(parts)


def skewed(seed, n=300):
    rnd = random.Random(seed)
    return [(rnd.choice(["a", "b", None]), [f"w{int(rnd.paretovariate(0.7)) % 900}" for _ in range(rnd.randrange(60))])
            for _ in range(n)]


def test_equal_to_plain_counts_by_group_at_every_width(spark):
    rows = skewed(1) + [("a", None), ("b", []), ("c", []), ("a", [None, "w1", None])]
    for size in (3, 40, 5000):
        assert got(HV.frequent_terms(frame(spark, rows), "t", 12, ["g"], size=size)) == brute(rows, 12)


def test_a_summary_that_proves_nothing_is_widened(spark, monkeypatch):
    # all counts are equal: no summary narrower than the vocabulary proves anything
    rows = [("a", [f"w{i:03d}" for i in range(200)])] * 4
    widths, plain = [], HV.summaries
    monkeypatch.setattr(HV, "summaries", lambda d, t, size, g=(): (widths.append(size), plain(d, t, size, g))[1])
    assert got(HV.frequent_terms(frame(spark, rows, 2), "t", 5, ["g"], size=5)) == brute(rows, 5)
    assert widths == [5, 20, 80, 320]


def test_flat_candidates_fall_back_to_the_full_count(spark):
    rows = skewed(2)
    assert got(HV.frequent_terms(frame(spark, rows), "t", 9, ["g"], size=50, max_candidates=3)) == brute(rows, 9)
    assert got(HV.frequent_terms(frame(spark, rows), "t", 9, ["g"], size=50, max_bytes=3)) == brute(rows, 9)


def test_summary_bounds_hold_and_stay_small():
    rnd, s, true = random.Random(3), HV.Summary(20), Counter()
    for _ in range(5000):
        t, n = f"w{int(rnd.paretovariate(0.6)) % 700}", rnd.randrange(1, 4)
        s.add(t, n)
        true[t] += n
    s.settle()
    assert len(s.n) <= 20 and s.error > 0
    assert all(s.n.get(t, 0) <= n <= s.n.get(t, 0) + s.error for t, n in true.items())


def test_empty_table_and_vocabularies(spark):
    none = frame(spark, [])
    assert HV.frequent_terms(none, "t", 3).isEmpty() and HV.tfidf_vocabulary(none, "t", 3).isEmpty()
    d = frame(spark, skewed(4)).selectExpr("monotonically_increasing_id() AS page_id", "t").checkpoint()
    key = lambda r: r["term"]
    cols = ["term", "idx", "df", "total", "idf"]
    assert sorted(HV.tfidf_vocabulary(d, "t", 30, size=30).select(cols).collect(), key=key) == \
        sorted(T.tfidf_fit(d, "page_id", "t", 30).select(cols).collect(), key=key)
    cols = ["term", "id", "cnt"]
    assert sorted(HV.id_vocabulary(d, "t", 20, size=18).select(cols).collect(), key=key) == \
        sorted(T.frequency_vocab(d, "t", 20).select(cols).collect(), key=key)
