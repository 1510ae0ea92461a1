"""F7, I13, E15 and F9 variants on small tables."""

import numpy as np

from pagelab.operators import drift as DR, text as T


def long(spark):
    rows = [("x", float(v)) for v in range(101)] + [("zero", 0.0)] * 30 + [("zero", 5.0)]
    return spark.createDataFrame(rows, "feature string, value double")


def values(df, feature):
    return sorted((r["value"] for r in df.where(f"feature = '{feature}'").collect()), key=lambda v: (v is None, v))


def test_factor_and_null_out(spark):
    assert values(DR.drop_top_quantile(long(spark), 0.5, factor=1.5), "x") == [float(v) for v in range(76)]
    # a quantile of 0 leaves the feature whole with a factor, and cuts without one
    assert values(DR.drop_top_quantile(long(spark), 0.5, factor=2.0), "zero") == [0.0] * 30 + [5.0]
    assert values(DR.drop_top_quantile(long(spark), 0.5), "zero") == [0.0] * 30
    out = values(DR.drop_top_quantile(long(spark), 0.9, null_out=True), "x")
    assert out == [float(v) for v in range(91)] + [None] * 10
    assert DR.drop_top_quantile(long(spark).limit(0), 0.9, factor=1.5).isEmpty()


def test_density_of_a_class_sums_to_one(spark):
    rng = np.random.default_rng(5)
    rows = [("a" if i % 3 else "b", "f", float(v)) for i, v in enumerate(rng.normal(size=400))] + [("a", "same", 2.0)] * 5
    df = spark.createDataFrame(rows, "label string, feature string, value double")
    got = DR.histogram(df, ["label"], 30, density=True).collect()
    v = {k: np.array([x for c, f, x in rows if c == k and f == "f"]) for k in "ab"}
    every = np.concatenate(list(v.values()))
    for k in "ab":
        want, _ = np.histogram(v[k], 30, (every.min(), every.max()), density=True)
        mine = np.zeros(30)
        for r in got:
            if r["label"] == k and r["feature"] == "f":
                mine[r["bin"]] = r["density"]
        assert np.allclose(mine, want)
    assert [r["density"] for r in got if r["feature"] == "same"] == [30.0]


def test_value_counts(spark):
    df = spark.createDataFrame([("a", "n", float(v)) for v in [0] * 98 + [1, 900]], "label string, feature string, value double")
    got = {(r["value"], r["count"]) for r in DR.value_counts(df, ["label"], 0.99).collect()}
    assert got == {(0.0, 98), (1.0, 1)}


def test_stop_words_are_an_argument(spark):
    df = spark.createDataFrame([("g", ["the", "login", "bank", "bank", "www"]), ("g", None)], "g string, w array<string>")
    words = lambda **kw: [r["word"] for r in sorted(T.word_frequencies(df, "w", ["g"], **kw).collect(), key=lambda r: r["rank"])]
    assert words() == ["bank", "the"]
    assert words(stop=(*T.ENGLISH_STOP, *T.WORD_FREQ_STOP)) == ["bank"]
    assert words(stop=()) == ["bank", "login", "the", "www"]
