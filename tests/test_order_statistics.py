"""Radix selection against numpy, on values of all kinds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagelab.operators import stats as S


def test_keys_keep_the_order_of_doubles():
    rng = np.random.default_rng(1)
    x = np.concatenate((rng.normal(size=500) * 10.0 ** rng.integers(-300, 300, 500), [0.0, -0.0, np.inf, -np.inf, 5e-324, -5e-324, np.nan]))
    k = S.ordered_bits(x)
    order = np.argsort(k, kind="stable")
    assert (np.sort(x)[:-1] == x[order][:-1]).all() and np.isnan(x[order][-1])
    assert k[list(x).index(0.0)] == S.ordered_bits(np.array([-0.0]))[0]
    back = S.from_ordered_bits(k)
    assert ((back == x) | np.isnan(x)).all()


def test_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(2)
    kinds = {"integers": rng.integers(0, 5, 900).astype(float), "normal": rng.normal(size=1_001),
             "close": 1.0 + rng.integers(0, 2_000, 700) * 2.0 ** -50, "wide": rng.normal(size=600) * 10.0 ** rng.integers(-200, 200, 600),
             "one": np.array([3.5]), "same": np.full(400, -7.25)}
    rows = [(k, int(i % 2), float(v)) for k, x in kinds.items() for i, v in enumerate(x)]
    rows += [(None, 0, 1.0), (None, 0, 4.0), ("none", 1, None)]
    df = spark.createDataFrame(rows, "feature string, class int, value double").repartition(7)
    probs = [0.0, 0.25, 0.5, 0.99, 1.0]
    got = {(r["feature"], r["class"]): [r[f"q_{i}"] for i in range(5)] for r in S.exact_quantiles(df, ["feature", "class"], "value", probs).collect()}
    want = {}
    for k in [*kinds, None]:
        for c in (0, 1):
            v = [x for f, cc, x in rows if f == k and cc == c and x is not None]
            if v:
                want[k, c] = np.quantile(v, probs).tolist()
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k], rel=1e-12), k
    whole = S.exact_quantiles(df, [], "value", [0.5]).collect()
    assert len(whole) == 1 and whole[0]["q_0"] == pytest.approx(np.median([x for *_, x in rows if x is not None]))
    assert S.exact_quantiles(df.limit(0), ["feature"], "value", [0.5]).count() == 0
    assert S.exact_quantiles(df.limit(0), [], "value", [0.5]).collect()[0]["q_0"] is None


def test_no_value_is_shuffled(spark):
    df = spark.range(0, 50_000, 1, 4).select(F.lit("a").alias("g"), (F.col("id") / 7).alias("v"))
    counts = S._bucket_counts(df, ["g"], "v", 64 - S.RADIX, None)
    assert counts.count() < 400  # buckets of 50,000 distinct values
    assert counts.agg(F.sum("_n")).first()[0] == 50_000


def test_ranks_equal_a_sort(spark):
    import pandas as pd
    from pagelab.operators import drift as DR, ranks as R
    rng = np.random.default_rng(4)
    x = pd.DataFrame({"a": rng.integers(0, 4, 1_500).astype(float), "b": rng.normal(size=1_500), "c": np.full(1_500, 2.0),
                      "d": -np.abs(rng.normal(size=1_500)) * 1e200})
    x["e"] = (x["b"].round(1) + x["a"]).round(9)  # float noise splits no ties
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x.to_numpy())], ["id", *x.columns]).repartition(6)
    d = R.build(df, list(x.columns))
    assert d.rows == 1_500 and len(d.parts[1]) > 1
    got = {r["id"]: r["ranks"] for r in R.with_ranks(df, d).collect()}
    want = x.rank(method="average").to_numpy()
    assert (np.array([got[i] for i in range(1_500)]) == want).all()
    corr = {(r["feature_a"], r["feature_b"]): r["corr"] for r in DR.spearman(df, list(x.columns)).collect()}
    real = x.rank().corr()
    for (a, b), v in corr.items():
        assert v is None if "c" in (a, b) else v == pytest.approx(real.loc[a, b], abs=1e-12)
    assert len(corr) == 10
    d.parts[0][0] = (*d.parts[0][0][:1], d.parts[0][0][1] + 8, *d.parts[0][0][2:])
    with pytest.raises(Exception, match="sees the ranks in part"):
        R.with_ranks(df, d).collect()
