"""Nystroem kernel features: error of the kernel, and the SVM against an exact solver."""

import numpy as np
from pyspark.ml.linalg import Vectors

from pagelab.operators import models as M


def table(spark, n, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4))
    y = ((x ** 2).sum(axis=1) < 3.2).astype(int)  # a ball: no plane parts it
    return spark.createDataFrame([(i, int(c), Vectors.dense(v)) for i, (c, v) in enumerate(zip(y, x))], ["page_id", "label", "features"]), x, y


def exact_svm(k, y, c, steps=60):
    """Dual coordinate descent over the whole kernel (a constant added for the offset)."""
    k, s, a = k + 1.0, 2.0 * y - 1, np.zeros(len(y))
    f = np.zeros(len(y))
    for _ in range(steps):
        for i in range(len(y)):
            new = min(max(a[i] - (s[i] * f[i] - 1) / k[i, i], 0.0), c)
            f += (new - a[i]) * s[i] * k[i]
            a[i] = new
    return a * s


def test_kernel_error_is_small(spark):
    df, x, _ = table(spark, 1_500)
    gamma = M.scale_gamma(df)
    assert M.Nystroem(M.landmarks(df, 200), gamma).error(df) < 0.02
    few = df.where("page_id < 120")
    whole = M.landmarks(few, 200)
    assert len(whole) == 120 and M.Nystroem(whole, gamma).error(few) < 1e-6  # all rows are landmarks


def test_accuracy_is_that_of_an_exact_solver(spark, tmp_path):
    df, x, y = table(spark, 900)
    tr, te = df.where("page_id < 500"), df.where("page_id >= 500")
    svm = M.KernelSVM(4, n_out=150).fit(tr)
    got = {r["page_id"]: r["svm_prediction"] for r in svm.transform(te).collect()}
    beta = exact_svm(M._rbf(x[:500], x[:500], svm.gamma), y[:500], 1.0)
    want = (M._rbf(x[500:], x[:500], svm.gamma) + 1.0) @ beta > 0
    mine = np.mean([got[i] == y[i] for i in range(500, 900)])
    assert mine >= np.mean(want == y[500:]) - 0.01 and mine > 0.9
    svm.save(str(tmp_path))
    back = M.KernelSVM(4).load(str(tmp_path))
    assert {r["page_id"]: r["svm_prediction"] for r in back.transform(te).collect()} == got
