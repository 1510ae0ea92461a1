"""ReLU network: gradients, data-parallel steps, reruns after a lost task."""

import os
import subprocess
import sys

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from pagelab.operators import network as N

LAYERS = [N.Layer(6, True), N.Layer(5), N.Layer(4, True)]


def loss(net, x, y):
    p = net.forward(x, training=True)[0]
    return -(y * np.log(p) + (1 - y) * np.log(1 - p)).sum()


def test_gradients_equal_finite_differences():
    rng = np.random.default_rng(1)
    net = N.Net(7, LAYERS, seed=3)
    net.weights += 0.1 * rng.normal(size=len(net.weights))
    x, y = rng.normal(size=(20, 7)), rng.integers(0, 2, 20).astype(float)
    g, _ = net.gradient(x, y)
    w = net.weights.copy()
    for k in range(len(w)):
        ends = []
        for h in (1e-6, -1e-6):
            net.weights = w.copy()
            net.weights[k] += h
            ends.append(loss(net, x, y))
        assert g[k] == pytest.approx((ends[0] - ends[1]) / 2e-6, rel=1e-4, abs=1e-5)


def table(spark, n=600):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(n, 4))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)  # no straight line parts these
    return spark.createDataFrame([(i, float(c), Vectors.dense(v)) for i, (c, v) in enumerate(zip(y, x))], ["page_id", "label", "features"])


def test_workers_agree_and_learn(spark, tmp_path):
    df = table(spark)
    right = lambda m: m.transform(df).where("prediction = label").count()
    net = N.ReluNetwork([N.Layer(32), N.Layer(16)], epochs=12, batch=16, rate=0.02, workers=3, rows_per_worker=200)
    model = net.fit(df)
    assert right(model) > 540
    one = N.ReluNetwork([N.Layer(32), N.Layer(16)], epochs=40, batch=32, rate=0.01)
    model = one.fit(df)
    assert right(model) > 560
    again = one.fit(df.repartition(5))
    assert (again.net.weights == model.net.weights).all()  # the seed fixes all
    model.save(spark, str(tmp_path))
    back = N.ReluNetworkModel.load(spark, str(tmp_path))
    assert (back.net.weights == model.net.weights).all() and right(back) == right(model)
    thin = N.ReluNetwork([N.Layer(16, True, 0.3), N.Layer(8, True, 0.3), N.Layer(4)], epochs=2, batch=64).fit(df.limit(100))
    assert np.isfinite(thin.net.weights).all() and thin.net.moments[0][0].any()
    with pytest.raises(ValueError):
        net.fit(df.limit(0))


RERUN = """
import sys; sys.path.insert(0, {root!r}); sys.path.insert(0, {root!r} + "/tests")
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[3,4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "3").getOrCreate()
from pyspark import BarrierTaskContext
from pagelab.operators import network as N
from test_network import table
net = N.ReluNetwork([N.Layer(8)], epochs=3, batch=32, workers=3, rows_per_worker=50)
df = table(spark, 200)
want = net.fit(df).net.weights
plain = N.train
def lost_once(*a, **k):
    c = BarrierTaskContext.get()
    import os
    if c.partitionId() == 1 and not os.path.exists({marker!r}):
        open({marker!r}, "w").close()
        raise RuntimeError("this task is lost")
    return plain(*a, **k)
N.train = lost_once
import pyspark.cloudpickle as cp
cp.register_pickle_by_value(N)
got = net.fit(df).net.weights
print("SAME" if (got == want).all() else "DIFFERENT")
"""


def test_a_lost_task_reruns_the_stage_to_the_same_network(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = RERUN.format(root=root, marker=str(tmp_path / "lost"))
    env = {**os.environ, "PYTHONPATH": os.pathsep.join([root, os.path.join(root, "tests"), os.environ.get("PYTHONPATH", "")])}
    r = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300, env=env)
    assert "SAME" in r.stdout and "this task is lost" in r.stderr, r.stderr[-2000:]
