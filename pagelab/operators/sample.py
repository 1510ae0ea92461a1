"""Seeded samples, splits, folds and training windows.

Randomness is a hash of the row key and a seed (the first 52 bits of MD5 of
"key:seed"), so every sample is reproducible, by any engine, and recomputes
identically when a task is retried.

Exact ranks inside a class never sort a class in one task. ``exact_rank``
cuts the order key into many ranges (uniform ranges for hash keys, quantile
ranges otherwise), counts rows per (group, range) in a small table, and
numbers rows inside each range with a window partitioned by (group, range):
rank = rows of the group in earlier ranges + position inside the range.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HASH_BITS = 52


def hash_uniform(key, seed: int = 42):
    """Deterministic uniform number in [0, 1) from a key and a seed."""
    k = F.col(key) if isinstance(key, str) else key
    h = F.md5(F.concat(F.coalesce(k.cast("string"), F.lit("")), F.lit(f":{int(seed)}")).cast("binary"))
    return F.conv(F.substring(h, 1, HASH_BITS // 4), 16, 10).cast("double") / float(2 ** HASH_BITS)


def exact_rank(df: DataFrame, order: str, groups: list[str] | None = None, out: str = "_rank",
               n_ranges: int = 256, uniform01: bool = False, tie: str | None = None) -> DataFrame:
    """1-based rank of each row by ``order``, then ``tie`` (unique within a group), inside
    ``groups``; scalable: no window spans a whole group."""
    groups = list(groups or [])
    if uniform01:
        splits = [i / n_ranges for i in range(n_ranges)] + [float("inf")]
        splits[0] = float("-inf")
    else:
        probs = [i / n_ranges for i in range(1, n_ranges)]
        qs = df.approxQuantile(order, probs, 1.0 / (4 * n_ranges)) if probs else []
        splits = [float("-inf")] + sorted(set(float(q) for q in qs)) + [float("inf")]
    b = Bucketizer(splits=splits, inputCol="_ord", outputCol="_rng", handleInvalid="keep")
    x = b.transform(df.withColumn("_ord", F.col(order).cast("double")))
    counts = x.groupBy(*groups, "_rng").agg(F.count(F.lit(1)).alias("_cnt"))
    w = Window.partitionBy(*groups).orderBy("_rng").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*groups, "_rng", F.coalesce(F.sum("_cnt").over(w), F.lit(0)).alias("_off"))
    # offsets has (groups x ranges) rows: bounded by n_ranges per group
    x = x.join(F.broadcast(offsets), [*groups, "_rng"], "inner")
    wr = Window.partitionBy(*groups, "_rng").orderBy(order, *([tie] if tie else []))
    return x.withColumn(out, F.col("_off") + F.row_number().over(wr)).drop("_ord", "_rng", "_off")


def global_rank(df: DataFrame, order: list[str], out: str = "rank") -> DataFrame:
    """1-based rank by any sortable columns without a single-partition window.

    The frame is range-sorted across partitions; each row's index inside its
    partition plus the row count of all earlier partitions is its rank. The
    sorted frame is checkpointed (shared checkpoint folder) so the counts and
    the indices see the same partitioning even if tasks are retried.
    """
    from pagelab.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(df.sparkSession)
    s = df.orderBy(*order).withColumn("_mid", F.monotonically_increasing_id()).checkpoint(eager=True)
    s = s.withColumn("_pid", F.shiftright("_mid", 33)).withColumn("_loc", F.col("_mid").bitwiseAND((1 << 33) - 1))
    cnt = s.groupBy("_pid").agg(F.count(F.lit(1)).alias("_c"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    off = cnt.select("_pid", F.coalesce(F.sum("_c").over(w), F.lit(0)).alias("_off"))  # one row per partition
    return (s.join(F.broadcast(off), "_pid").withColumn(out, F.col("_off") + F.col("_loc") + 1)
             .drop("_mid", "_pid", "_loc", "_off"))


def sample_n(df: DataFrame, n: int, seed: int = 42, key: str = "page_id") -> DataFrame:
    """min(n, rows) seeded rows (top-n by hash: a per-partition top-k)."""
    return df.withColumn("_u", hash_uniform(key, seed)).orderBy("_u", key).limit(n).drop("_u")


def balanced_sample(df: DataFrame, n: int, label: str = "label", seed: int = 42,
                    key: str = "page_id") -> DataFrame:
    """N seeded rows per class (fewer if the class is smaller), shuffled."""
    x = exact_rank(df.withColumn("_u", hash_uniform(key, seed)), "_u", [label], uniform01=True, tie=key)
    return x.where(F.col("_rank") <= n).drop("_rank").orderBy(hash_uniform(key, seed + 1)).drop("_u")


def head_per_class(df: DataFrame, value, n: int, label: str = "label", order: str = "page_id") -> DataFrame:
    """First n rows of one class."""
    return df.where(F.col(label) == F.lit(value)).orderBy(order).limit(n)


def class_counts(df: DataFrame, label: str = "label") -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))


def stratified_split(df: DataFrame, test_frac: float | None = 0.2, train_size: int | None = None,
                     label: str = "label", seed: int = 42, key: str = "page_id",
                     out: str = "split") -> DataFrame:
    """Per class, the first round(test_frac * n_c) rows by hash are
    ``test`` (or, with ``train_size``, the class's proportional share of
    ``train_size`` rows is ``train``); the rest is the other side."""
    x = exact_rank(df.withColumn("_u", hash_uniform(key, seed)), "_u", [label], uniform01=True, tie=key)
    cnt = class_counts(df, label)
    if train_size is not None:
        total = df.count()
        cnt = cnt.withColumn("_q", F.round(F.col("_n") * F.lit(train_size) / F.lit(total)))
        side = F.when(F.col("_rank") <= F.col("_q"), "train").otherwise("test")
    else:
        cnt = cnt.withColumn("_q", F.round(F.col("_n") * F.lit(test_frac)))
        side = F.when(F.col("_rank") <= F.col("_q"), "test").otherwise("train")
    x = x.join(F.broadcast(cnt), label)  # one row per class
    return x.withColumn(out, side).drop("_u", "_rank", "_n", "_q")


def stratified_kfold(df: DataFrame, k: int = 5, label: str = "label", seed: int = 42,
                     key: str = "page_id", out: str = "fold") -> DataFrame:
    """fold = (rank inside class by hash - 1) mod k; classes are split
    evenly (fold sizes within a class differ by at most one)."""
    x = exact_rank(df.withColumn("_u", hash_uniform(key, seed)), "_u", [label], uniform01=True, tie=key)
    return x.withColumn(out, ((F.col("_rank") - 1) % k).cast("int")).drop("_u", "_rank")


def ordered_split(df: DataFrame, train_frac: float = 0.8, order: str = "page_id",
                  out: str = "split") -> DataFrame:
    """First floor(train_frac * n) rows by ``order`` train, rest test."""
    n = df.count()
    cut = int(train_frac * n)
    x = exact_rank(df, order)
    return x.withColumn(out, F.when(F.col("_rank") <= cut, "train").otherwise("test")).drop("_rank")


def rolling_mix(old: DataFrame, new: DataFrame, k_old: int, m_new: int, order: str = "page_id") -> DataFrame:
    """First K old rows + first M new rows (ordered limits, top-k plans)."""
    a = old.orderBy(order).limit(k_old).withColumn("source", F.lit("old"))
    b = new.orderBy(order).limit(m_new).withColumn("source", F.lit("new"))
    return a.unionByName(b)


def mixed_retrain_set(old: DataFrame, new: DataFrame, n_old: int, n_new: int, seed: int = 42,
                      key: str = "page_id") -> DataFrame:
    """n_old sampled old rows + n_new sampled new rows for training; the
    remaining new rows are the evaluation set (column ``split``)."""
    tr_old = sample_n(old, n_old, seed, key).withColumn("split", F.lit("train"))
    picked = sample_n(new, n_new, seed, key).select(key)
    nw = new.join(picked.withColumn("_p", F.lit(1)), key, "left")
    nw = nw.withColumn("split", F.when(F.col("_p").isNotNull(), "train").otherwise("test")).drop("_p")
    return tr_old.unionByName(nw)


def blind_features(df: DataFrame, cols) -> DataFrame:
    """Zero chosen feature columns."""
    return df.withColumns({c: F.lit(0.0).cast(df.schema[c].dataType) for c in cols})
