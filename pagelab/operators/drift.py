"""I: drift between eras and per-class profiles."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelab.operators.stats import exact_quantiles, grouped_cumsum


def class_averages(df: DataFrame, cols: list[str], label: str = "label") -> DataFrame:
    """I8: mean of each feature by class, long form (class, feature, mean)."""
    long = df.select(label, *[F.col(c).cast("double") for c in cols]).unpivot([label], cols, "feature", "value")
    return long.groupBy(label, "feature").agg(F.avg("value").alias("mean"), F.count(F.lit(1)).alias("n"))


def drop_top_quantile(long: DataFrame, q: float = 0.99, feature: str = "feature", value: str = "value",
                      factor: float = 1.0, null_out: bool = False) -> DataFrame:
    """per feature keep values at or below ``factor`` times the q-quantile; with a factor, a
    feature whose quantile is not positive stays whole. ``null_out`` keeps the rows and makes
    the values above null."""
    qs = exact_quantiles(long, [feature], value, [q]).withColumnRenamed("q_0", "_q")  # one row per feature
    x = long.join(F.broadcast(qs), feature)
    keep = F.col(value) <= F.col("_q") * factor
    if factor != 1.0:
        keep = (F.col("_q") <= 0) | keep
    x = x.withColumn(value, F.when(keep, F.col(value))) if null_out else x.where(keep)
    return x.drop("_q")


def top_variance(long: DataFrame, k: int = 15, feature: str = "feature", value: str = "value") -> DataFrame:
    """the k features with the largest sample variance (ties by name)."""
    v = long.groupBy(feature).agg(F.var_samp(value).alias("variance"))
    w = Window.orderBy(F.desc(F.round("variance", 9)), feature)  # one row per feature: tiny
    return v.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def ks_drift(long: DataFrame, era: str, a: str, b: str, feature: str = "feature", value: str = "value") -> DataFrame:
    """Max |ECDF_a - ECDF_b| per feature from running sums over the
    distinct values of each feature (scalable running sums)."""
    c = long.groupBy(feature, value).agg(F.sum((F.col(era) == a).cast("long")).alias("na"),
                                         F.sum((F.col(era) == b).cast("long")).alias("nb"))
    tot = c.groupBy(feature).agg(F.sum("na").alias("_ta"), F.sum("nb").alias("_tb"))
    s = grouped_cumsum(c, [feature], value, ["na", "nb"]).join(F.broadcast(tot), feature)
    gap = F.abs(F.col("cum_na") / F.col("_ta") - F.col("cum_nb") / F.col("_tb"))
    return s.groupBy(feature).agg(F.max(gap).alias("ks"))


def mean_shift(long: DataFrame, era: str, a: str, b: str, feature: str = "feature", value: str = "value") -> DataFrame:
    """(new - old) / |old| * 100, 0 when old is 0."""
    m = long.groupBy(feature).agg(F.avg(F.when(F.col(era) == a, F.col(value))).alias("old_mean"),
                                  F.avg(F.when(F.col(era) == b, F.col(value))).alias("new_mean"))
    sh = F.when(F.col("old_mean") == 0, F.lit(0.0)).otherwise(
        (F.col("new_mean") - F.col("old_mean")) / F.abs(F.col("old_mean")) * 100)
    return m.withColumn("shift_pct", sh)


def mean_shift_filter(long: DataFrame, era: str, a: str, b: str, min_abs_pct: float = 50.0,
                      feature: str = "feature", value: str = "value") -> DataFrame:
    """I4: features whose mean moved by more than ``min_abs_pct`` percent;
    divides by the old mean (not its absolute value); old = 0 gives +inf
    when the new mean is positive, else 0."""
    m = long.groupBy(feature).agg(F.avg(F.when(F.col(era) == a, F.col(value))).alias("old_mean"),
                                  F.avg(F.when(F.col(era) == b, F.col(value))).alias("new_mean"))
    sh = (F.when(F.col("old_mean") == 0, F.when(F.col("new_mean") > 0, F.lit(float("inf"))).otherwise(F.lit(0.0)))
          .otherwise((F.col("new_mean") - F.col("old_mean")) / F.col("old_mean") * 100))
    return m.withColumn("shift_pct", sh).where(F.abs("shift_pct") > min_abs_pct)


def top_bottom(scores: DataFrame, col: str, k: int, feature: str = "feature") -> DataFrame:
    """K smallest ('stable') and k largest ('drifted') by ``col``."""
    w1 = Window.orderBy(F.round(col, 9), feature)  # one row per feature: tiny
    w2 = Window.orderBy(F.desc(F.round(col, 9)), feature)
    r = scores.select(feature, col, F.row_number().over(w1).alias("_a"), F.row_number().over(w2).alias("_b"))
    return (r.where(F.col("_a") <= k).select(F.lit("stable").alias("side"), feature, col, F.col("_a").alias("rank"))
            .unionByName(r.where(F.col("_b") <= k).select(F.lit("drifted").alias("side"), feature, col, F.col("_b").alias("rank"))))


def class_value_proportion(long: DataFrame, label: str = "label", feature: str = "feature", value: str = "value") -> DataFrame:
    """Count and share of each value inside (class, feature)."""
    c = long.groupBy(label, feature, value).agg(F.count(F.lit(1)).alias("count"))
    t = c.groupBy(label, feature).agg(F.sum("count").alias("_t"))
    return c.join(t, [label, feature]).withColumn("share", F.col("count") / F.col("_t")).drop("_t")


def quantiles(long: DataFrame, groups, qs, feature: str = "feature", value: str = "value") -> DataFrame:
    """Exact quantiles (linear interpolation) per (groups, feature)."""
    a = exact_quantiles(long, [*groups, feature], value, qs)
    return a.select(*groups, feature, *[F.col(f"q_{i}").alias(f"q_{str(q).replace('.', '_')}") for i, q in enumerate(qs)])


def describe(long: DataFrame, groups, feature: str = "feature", value: str = "value") -> DataFrame:
    """Count, mean, sample sd, min, quartiles, max."""
    v = F.col(value)
    a = long.groupBy(*groups, feature).agg(F.count(F.lit(1)).alias("count"), F.avg(v).alias("mean"),
                                           F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))
    q = exact_quantiles(long, [*groups, feature], value, [0.25, 0.5, 0.75])
    return a.join(q, [*groups, feature]).select(*groups, feature, "count", "mean", "std", "min",
                                                F.col("q_0").alias("p25"), F.col("q_1").alias("p50"),
                                                F.col("q_2").alias("p75"), "max")


def boxplot_stats(long: DataFrame, groups, feature: str = "feature", value: str = "value") -> DataFrame:
    """Quartiles, whiskers at the most extreme values within 1.5 IQR,
    outlier counts."""
    q = exact_quantiles(long, [*groups, feature], value, [0.25, 0.75])
    q = q.select(*groups, feature, F.col("q_0").alias("q1"), F.col("q_1").alias("q3"))
    x = long.join(F.broadcast(q), [*groups, feature])  # one row per group and feature
    lo = F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))
    hi = F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))
    v = F.col(value)
    return x.groupBy(*groups, feature, "q1", "q3").agg(
        F.min(F.when(v >= lo, v)).alias("whisker_low"), F.max(F.when(v <= hi, v)).alias("whisker_high"),
        F.sum(((v < lo) | (v > hi)).cast("long")).alias("outliers")).withColumn("iqr", F.col("q3") - F.col("q1"))


def value_counts(long: DataFrame, groups, q: float = 0.99, feature: str = "feature", value: str = "value") -> DataFrame:
    """I13 of discrete features: rows of each (groups, feature, value) up to the feature's q-quantile."""
    return drop_top_quantile(long, q, feature, value).groupBy(*groups, feature, value).agg(F.count(F.lit(1)).alias("count"))


def histogram(long: DataFrame, groups, bins: int = 20, feature: str = "feature", value: str = "value",
              density: bool = False) -> DataFrame:
    """Equal-width bins over each feature's range (last bin closed;
    a constant feature gets the range value +- 0.5); ``density`` adds each group's own density."""
    r = long.groupBy(feature).agg(F.min(value).alias("_mn"), F.max(value).alias("_mx"))
    same = F.col("_mx") == F.col("_mn")
    r = r.select(feature, F.when(same, F.col("_mn") - 0.5).otherwise(F.col("_mn")).alias("_lo"),
                 F.when(same, F.col("_mx") + 0.5).otherwise(F.col("_mx")).alias("_hi"))
    x = long.join(F.broadcast(r), feature)  # one row per feature
    b = F.least(F.floor((F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins), F.lit(bins - 1))
    if not density:
        return x.groupBy(*groups, feature, b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    c = x.groupBy(*groups, feature, b.alias("bin"), ((F.col("_hi") - F.col("_lo")) / bins).alias("_w")).agg(F.count(F.lit(1)).alias("count"))
    rows = F.sum("count").over(Window.partitionBy(*groups, feature))  # at most ``bins`` rows each
    return c.withColumn("density", F.col("count") / (rows * F.col("_w"))).drop("_w")


def pairwise_corr(df: DataFrame, cols: list[str]) -> DataFrame:
    """Pearson correlation of every column pair (name_a > name_b); NULL when
    a column is constant. The matrix comes from Spark ML's distributed
    covariance (one tree aggregation); only the d x d result reaches the
    driver."""
    import math
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.stat import Correlation
    v = VectorAssembler(inputCols=cols, outputCol="_v", handleInvalid="keep") \
        .transform(df.select(*[F.col(c).cast("double").alias(c) for c in cols]))
    m = Correlation.corr(v, "_v", "pearson").first()[0].toArray()  # d x d, bounded by the feature count
    rows = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols[:i]):
            x = float(m[i, j])
            rows.append((max(a, b), min(a, b), None if math.isnan(x) else x))
    return df.sparkSession.createDataFrame(rows, "feature_a string, feature_b string, corr double")


def spearman(df: DataFrame, cols: list[str]) -> DataFrame:
    """I16: Pearson correlation of mid-ranks (name_a > name_b); NULL when a column is
    constant. Ranks are looked up in a stored dictionary of distinct values; rows add up
    to one matrix a task and are not shuffled."""
    import math
    from pagelab.operators.ranks import build, rank_products
    m = rank_products(df, build(df, cols))
    rows = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols[:i]):
            x = math.sqrt(m[i, i] * m[j, j])
            rows.append((max(a, b), min(a, b), float(m[i, j] / x) if x > 0 else None))
    return df.sparkSession.createDataFrame(rows, "feature_a string, feature_b string, corr double")


def radar_profile(df: DataFrame, cols: list[str], groups_map: dict, label: str = "label") -> DataFrame:
    """Min-max scale, mean per class, mean of the means per feature group."""
    from pagelab.operators.scale import minmax_apply, minmax_fit
    s = minmax_apply(df, minmax_fit(df, cols), cols)
    m = s.groupBy(label).agg(*[F.avg(c).alias(c) for c in cols])
    scores = F.array(*[F.struct(F.lit(cat).alias("category"), (sum(F.col(f) for f in fs) / len(fs)).alias("score"))
                       for cat, fs in groups_map.items()])
    return m.select(label, F.inline(scores))  # all groups from one pass


def standardised_gap(long: DataFrame, label: str = "label", feature: str = "feature", value: str = "value") -> DataFrame:
    """Difference of class means after z-scoring with the sample sigma."""
    s = long.groupBy(feature).agg(F.avg(value).alias("_mu"), F.stddev_samp(value).alias("_sd"))
    x = long.join(F.broadcast(s), feature)  # one row per feature
    z = F.when((F.col("_sd") == 0) | F.col("_sd").isNull(), F.lit(0.0)).otherwise((F.col(value) - F.col("_mu")) / F.col("_sd"))
    g = x.groupBy(feature).agg((F.avg(F.when(F.col(label) == 1, z)) - F.avg(F.when(F.col(label) == 0, z))).alias("gap"))
    w = Window.orderBy(F.desc(F.round(F.abs("gap"), 9)), feature)  # one row per feature: tiny
    return g.withColumn("rank", F.row_number().over(w))


def era_shift_quantile_view(df: DataFrame, era: str, cols: list[str], q: float = 0.95) -> DataFrame:
    """Per feature, rows up to the pooled q-quantile, quartiles by era."""
    long = df.select(era, *[F.col(c).cast("double") for c in cols]).unpivot([era], cols, "feature", "value")
    cut = exact_quantiles(long, ["feature"], "value", [q]).withColumnRenamed("q_0", "_cut")  # one row per feature
    x = long.join(F.broadcast(cut), "feature").where(F.col("value") <= F.col("_cut"))
    qs = exact_quantiles(x, [era, "feature"], "value", [0.25, 0.5, 0.75])
    n = x.groupBy(era, "feature").agg(F.count(F.lit(1)).alias("n"))
    return qs.join(n, [era, "feature"]).select(era, "feature", F.col("q_0").alias("q1"), F.col("q_1").alias("median"),
                                               F.col("q_2").alias("q3"), "n")


def _snap(col, lo, hi, bins):
    """Centre of the lattice cell holding ``col`` (bins equal cells on [lo, hi])."""
    w = (hi - lo) / bins
    i = F.least(F.floor((col - lo) / F.when(w == 0, F.lit(1.0)).otherwise(w)), F.lit(bins - 1))
    return F.when(w == 0, col).otherwise(lo + (i + 0.5) * w)


def _grid_sums(points: DataFrame, keys: list[str], args: list[str], cells: int, kernel, step: int = 256) -> DataFrame:
    """(keys, i, s): sum over rows of ``kernel(args) -> rows x cells`` per key and cell.

    Each task adds its rows up in one array per key and emits that array, so
    what is shuffled is keys x cells per task and never rows x cells."""
    fields = {f.name: f.dataType.simpleString() for f in points.schema.fields}

    def add(it):
        held = {}
        for pdf in it:
            for key, part in pdf.groupby(keys, dropna=False, sort=False):
                total = held.setdefault(key, np.zeros(cells))
                cols = [part[c].to_numpy(float) for c in args]
                for at in range(0, len(part), step):
                    total += kernel(*(c[at:at + step, None] for c in cols)).sum(axis=0)
        for key, total in held.items():
            yield pd.DataFrame({**{k: [v] * cells for k, v in zip(keys, key)}, "i": np.arange(cells), "s": total})

    schema = ", ".join(f"`{k}` {fields[k]}" for k in keys) + ", i int, s double"
    part = points.select(*keys, *args).mapInPandas(add, schema)
    return part.groupBy(*keys, "i").agg(F.sum("s").alias("s"))


def kde_curve(long: DataFrame, groups, points: int = 100, feature: str = "feature", value: str = "value",
              bins: int | None = None) -> DataFrame:
    """Gaussian KDE per (groups, feature) on an even grid over the
    feature's range, normalised per group (Scott factor n^(-1/5) times the
    sample sigma). Rows are first reduced to distinct values with counts; with
    ``bins`` values first snap to so many cells of the feature's range (an
    approximation the caller asks for), else the result is exact."""
    groups = list(groups)
    src = long
    if bins:
        r = long.groupBy(feature).agg(F.min(value).alias("_l"), F.max(value).alias("_u"))
        src = long.join(F.broadcast(r), feature).withColumn(  # one row per feature
            value, _snap(F.col(value), F.col("_l"), F.col("_u"), bins)).drop("_l", "_u")
    d = src.groupBy(*groups, feature, value).agg(F.count(F.lit(1)).alias("_c"))
    st = long.groupBy(*groups, feature).agg(F.count(F.lit(1)).alias("_n"), F.stddev_samp(value).alias("_sd"))
    st = st.withColumn("_h", F.col("_sd") * F.pow(F.col("_n").cast("double"), -0.2)).where(F.col("_h") > 0)
    rg = long.groupBy(feature).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    x = d.join(F.broadcast(st), [*groups, feature]).join(F.broadcast(rg), feature)  # a row per group and feature
    at = np.arange(points) / (points - 1)

    def kernel(v, c, h, lo, hi):
        return c * np.exp(-0.5 * ((lo + at * (hi - lo) - v) / h) ** 2)

    sums = _grid_sums(x, [*groups, feature], [value, "_c", "_h", "_lo", "_hi"], points, kernel)
    out = sums.join(F.broadcast(st), [*groups, feature]).join(F.broadcast(rg), feature)
    return out.select(*groups, feature, "i", (F.col("_lo") + F.col("i") * (F.col("_hi") - F.col("_lo")) / (points - 1)).alias("x"),
                      (F.col("s") / (F.col("_n") * F.col("_h") * (2 * 3.141592653589793) ** 0.5)).alias("density"))


def bhattacharyya_overlap(df: DataFrame, era: str, a: str, b: str, xcol: str, ycol: str, grid: int = 100,
                          bins: int | None = None) -> DataFrame:
    """Overlap sum_g sqrt(p(g) q(g)) of the two eras' 2-D Gaussian KDEs
    (Scott factor n^(-1/6), sample covariance) on a grid x grid lattice over
    the pooled range padded by 1, each density normalised over the grid.
    Both columns are first z-scored on the pooled rows (population sigma).
    Rows are reduced to distinct points with counts (with ``bins``, of a
    bins x bins lattice); each task adds its points up on the grid."""
    from pagelab.operators.scale import zscore_apply, zscore_fit
    x = df.where(F.col(era).isin(a, b)).select(era, F.col(xcol).cast("double").alias("x"), F.col(ycol).cast("double").alias("y"))
    x = zscore_apply(x, zscore_fit(x, ["x", "y"]), ["x", "y"])
    st = x.groupBy(era).agg(F.count(F.lit(1)).alias("n"), F.var_samp("x").alias("vx"), F.var_samp("y").alias("vy"),
                            F.covar_samp("x", "y").alias("cxy"))
    f2 = F.pow(F.col("n").cast("double"), -1.0 / 3.0)  # (n^(-1/6))^2
    st = st.select(era, (F.col("vx") * f2).alias("sx"), (F.col("vy") * f2).alias("sy"), (F.col("cxy") * f2).alias("sxy"))
    det = F.col("sx") * F.col("sy") - F.col("sxy") * F.col("sxy")
    st = st.select(era, (F.col("sy") / det).alias("ixx"), (F.col("sx") / det).alias("iyy"), (-F.col("sxy") / det).alias("ixy"))
    rg = x.agg((F.min("x") - 1).alias("x0"), (F.max("x") + 1).alias("x1"), (F.min("y") - 1).alias("y0"), (F.max("y") + 1).alias("y1"))
    pts = x
    if bins:
        pts = x.join(F.broadcast(rg), how="inner")  # one-row side
        pts = pts.select(era, _snap(F.col("x"), F.col("x0") + 1, F.col("x1") - 1, bins).alias("x"),
                         _snap(F.col("y"), F.col("y0") + 1, F.col("y1") - 1, bins).alias("y"))
    pts = pts.groupBy(era, "x", "y").agg(F.count(F.lit(1)).alias("c"))
    j = pts.join(F.broadcast(st), era).join(F.broadcast(rg), how="inner")  # two-row and one-row sides
    gi, gj = np.divmod(np.arange(grid * grid), grid)

    def kernel(px, py, c, ixx, iyy, ixy, x0, x1, y0, y1):
        dx = x0 + gi * (x1 - x0) / (grid - 1) - px
        dy = y0 + gj * (y1 - y0) / (grid - 1) - py
        return c * np.exp(-0.5 * (dx * dx * ixx + 2 * dx * dy * ixy + dy * dy * iyy))

    z = _grid_sums(j, [era], ["x", "y", "c", "ixx", "iyy", "ixy", "x0", "x1", "y0", "y1"], grid * grid, kernel, step=64)
    tot = z.groupBy(era).agg(F.sum("s").alias("_t"))
    p = z.join(F.broadcast(tot), era).select(era, F.col("i").alias("k"), (F.col("s") / F.col("_t")).alias("p"))
    pa = p.where(F.col(era) == a).select("k", F.col("p").alias("pa"))
    pb = p.where(F.col(era) == b).select("k", F.col("p").alias("pb"))
    return pa.join(pb, "k").agg(F.sum(F.sqrt(F.col("pa") * F.col("pb"))).alias("bhattacharyya"))
