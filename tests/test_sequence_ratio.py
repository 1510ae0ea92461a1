"""The sequence ratio as an expression against difflib."""

import difflib
import random

from pyspark.sql import functions as F

from pagelab.functions.sequence import brand_discrepancy, sequence_ratio
from pagelab.functions.udfs import brand_discrepancy_difflib


def pairs(n, lengths, letters, seed):
    rnd = random.Random(seed)

    def text():
        return "".join(rnd.choice(letters) for _ in range(rnd.choice(lengths)))
    out = []
    for _ in range(n):
        a = text()
        # half of the right strings share pieces with the left one
        b = text() if rnd.random() < 0.5 else text()[:9] + a[rnd.randrange(len(a) + 1):] + text()[:5] + a[:7]
        out.append((a, b))
    return out


def check(spark, rows):
    df = spark.createDataFrame(rows, "a string, b string").repartition(8)
    for r in df.select("a", "b", sequence_ratio("a", "b").alias("r")).collect():
        assert abs(r["r"] - difflib.SequenceMatcher(None, r["a"], r["b"]).ratio()) < 1e-12, (r["a"], r["b"])


def test_equal_to_difflib_on_random_pairs(spark):
    check(spark, pairs(700, range(0, 25), "abc", 1) + pairs(300, range(0, 60), "abcdefgh01", 2) + [("", ""), ("a", ""), ("", "a")])


def test_popular_characters_of_long_right_strings(spark):
    rnd, rows = random.Random(3), []
    for n in (198, 199, 200, 201, 260):
        for letters in ("ab", "abcdefghijklmnopqrstuvwxyz0123456789"):
            b = "".join(rnd.choice(letters) for _ in range(n))
            rows += [(b[:40], b), ("x" + b[50:70] + "Z" + b[7:19], b), ("".join(rnd.choice(letters) for _ in range(30)), b),
                     ("q!" + b[:30], b[:100] + "!" + b[100:])]
    check(spark, rows)


def test_brand_discrepancy_equals_the_pandas_form(spark):
    rows = [*pairs(200, range(0, 15), "abc", 4), ("pay", "paypal"), ("paypal", "mypaypalcom"), (None, "x"), ("x", None), (None, None), ("", "")]
    df = spark.createDataFrame(rows, "t string, d string")
    got = df.select(brand_discrepancy("t", "d").alias("x"), brand_discrepancy_difflib(F.col("t"), F.col("d")).alias("y")).collect()
    assert all(abs(r["x"] - r["y"]) < 1e-12 for r in got)
