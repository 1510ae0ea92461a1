"""F: clipping, z-scoring, min-max scaling, quantile filters, wide -> long.

Statistics of all columns are computed in ONE aggregate (one job), the fitted
state is a one-row DataFrame, and applying it is a broadcast join of that
row followed by column arithmetic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def zscore_fit(df: DataFrame, cols: list[str]) -> DataFrame:
    """Mean and population sigma of every column (sigma 0 -> 1)."""
    aggs = []
    for c in cols:
        aggs.append(F.avg(c).alias(f"{c}__mean"))
        sd = F.stddev_pop(c)
        aggs.append(F.when(sd == 0, F.lit(1.0)).otherwise(sd).alias(f"{c}__sd"))
    return df.agg(*aggs)


def zscore_apply(df: DataFrame, state: DataFrame, cols: list[str], prefix: str = "") -> DataFrame:
    j = df.join(F.broadcast(state), how="inner")  # one-row state
    out = j.withColumns({f"{prefix}{c}": (F.col(c) - F.col(f"{c}__mean")) / F.col(f"{c}__sd") for c in cols})
    return out.drop(*[f"{c}__mean" for c in cols], *[f"{c}__sd" for c in cols])


def clip_fit(df: DataFrame, cols: list[str], q: float = 0.99) -> DataFrame:
    """Exact per-column q-quantile (linear interpolation) as a one-row state,
    computed for all columns in one distributed quantile job."""
    from pagelab.operators.stats import exact_quantiles
    long = df.select(*[F.col(c).cast("double") for c in cols]).unpivot([], cols, "feature", "value")
    qs = exact_quantiles(long, ["feature"], "value", [q])
    wide = qs.groupBy().pivot("feature", cols).agg(F.first("q_0"))  # one row, one column per feature
    return wide.select(*[F.col(f"`{c}`").alias(f"{c}__ub") for c in cols])


def clip_apply(df: DataFrame, state: DataFrame, cols: list[str]) -> DataFrame:
    j = df.join(F.broadcast(state), how="inner")  # one-row state
    out = j.withColumns({c: F.least(F.col(c).cast("double"), F.col(f"{c}__ub")) for c in cols})
    return out.drop(*[f"{c}__ub" for c in cols])


def minmax_fit(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.agg(*[x for c in cols for x in (F.min(c).alias(f"{c}__min"), F.max(c).alias(f"{c}__max"))])


def minmax_apply(df: DataFrame, state: DataFrame, cols: list[str]) -> DataFrame:
    j = df.join(F.broadcast(state), how="inner")  # one-row state
    rng = {c: F.col(f"{c}__max") - F.col(f"{c}__min") for c in cols}
    out = j.withColumns({c: F.when(rng[c] == 0, F.lit(0.0)).otherwise((F.col(c) - F.col(f"{c}__min")) / rng[c])
                         for c in cols})
    return out.drop(*[f"{c}__min" for c in cols], *[f"{c}__max" for c in cols])


def log1p_clip(df: DataFrame, cols: list[str]) -> DataFrame:
    """log1p(max(x, 0))."""
    return df.withColumns({c: F.log1p(F.greatest(F.col(c).cast("double"), F.lit(0.0))) for c in cols})


def melt(df: DataFrame, ids: list[str], cols: list[str], var: str = "feature", val: str = "value") -> DataFrame:
    """F8: wide -> long, NULL values dropped."""
    long = df.select(*ids, *[F.col(c).cast("double") for c in cols]).unpivot(ids, cols, var, val)
    return long.where(F.col(val).isNotNull())
