"""k-NN of repeated rows holds a bounded number of pairs."""

import tracemalloc

import numpy as np
import pandas as pd

from pagelab.operators import neighbours as N


def test_nearest_of_repeated_rows_in_bounded_memory():
    n = 4_096
    train = pd.DataFrame({"_id": np.arange(n)[::-1], "_v": [np.ones(48)] * n, "_y": np.arange(n) % 2})
    test = pd.DataFrame({"_id": np.arange(300), "_v": [np.ones(48)] * 300})
    tracemalloc.start()
    try:
        got = N._nearest(train, test, 5)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert got.groupby("_id")["t"].apply(list).tolist() == [[0, 1, 2, 3, 4]] * 300
    assert peak < 200e6
