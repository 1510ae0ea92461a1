"""The few vectorised Python helpers (pandas UDFs). Everything else is JVM-side."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.DoubleType())
def brand_discrepancy_difflib(title: pd.Series, domain: pd.Series) -> pd.Series:
    """1 - SequenceMatcher ratio of cleaned title and alphanumeric domain;
    0 when the title is empty; 0 when the title (longer than 3) is part of
    the domain."""
    out = []
    for t, d in zip(title.fillna(""), domain.fillna("")):
        if not t:
            out.append(0.0)
            continue
        sim = difflib.SequenceMatcher(None, t, d).ratio()
        if len(t) > 3 and t in d:
            sim = 1.0
        out.append(1.0 - sim)
    return pd.Series(out, dtype="float64")
