"""Scalable order statistics: running sums and mid-ranks inside groups.

A window ordered over a whole group would sort the group in one task. Here
each group's order key is cut into ranges at approximate quantiles computed
per group (``percentile_approx``: a small array per group), rows are counted
per (group, range), the counts are turned into offsets on that small table,
and the running sum inside a range is a window over (group, range) only.
Equal keys always land in the same range, so ties are handled exactly.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _ranges(df: DataFrame, groups: list[str], order: str, n_ranges: int) -> DataFrame:
    probs = [i / n_ranges for i in range(1, n_ranges)]
    b = df.groupBy(*groups).agg(F.percentile_approx(order, probs, 4 * n_ranges).alias("_b"))
    b = b.withColumn("_b", F.array_distinct("_b"))  # one small array per group
    x = df.join(F.broadcast(b), groups, "inner") if groups else df.join(F.broadcast(b), how="inner")
    return x.withColumn("_rng", F.size(F.filter("_b", lambda v: v < F.col(order)))).drop("_b")


def grouped_cumsum(df: DataFrame, groups: list[str], order: str, cols: list[str],
                   n_ranges: int = 256, prefix: str = "cum_") -> DataFrame:
    """Inclusive running sums of ``cols`` by ascending ``order`` inside
    ``groups`` (rows with equal keys share the value of the last of them)."""
    groups = list(groups)
    df = df.persist()  # read three times below (boundaries, range totals, running sums)
    x = _ranges(df, groups, order, n_ranges)
    tot = x.groupBy(*groups, "_rng").agg(*[F.sum(c).alias(f"_t_{c}") for c in cols])
    w = Window.partitionBy(*groups).orderBy("_rng").rowsBetween(Window.unboundedPreceding, -1)
    off = tot.select(*groups, "_rng", *[F.coalesce(F.sum(f"_t_{c}").over(w), F.lit(0)).alias(f"_o_{c}") for c in cols])
    x = x.join(F.broadcast(off), [*groups, "_rng"], "inner")  # groups x n_ranges rows
    wr = Window.partitionBy(*groups, "_rng").orderBy(order).rangeBetween(Window.unboundedPreceding, 0)
    return x.select(*df.columns, *[(F.col(f"_o_{c}") + F.sum(c).over(wr)).alias(f"{prefix}{c}") for c in cols])


def mid_ranks(df: DataFrame, groups: list[str], value: str, out: str = "rank") -> DataFrame:
    """Average (mid) rank of each distinct value inside groups:
    rows below + (ties + 1) / 2. Returns (groups, value, out)."""
    cnt = df.groupBy(*groups, value).agg(F.count(F.lit(1)).alias("_n"))
    c = grouped_cumsum(cnt, groups, value, ["_n"])
    return c.select(*groups, value, (F.col("cum__n") - F.col("_n") + (F.col("_n") + 1) / 2.0).alias(out))


def top_k_per_group(df: DataFrame, groups, order, k: int, key: str, salts: int = 64, out: str = "rank") -> DataFrame:
    """Exact top-k rows per group by ``order`` (a list of sort columns that is
    unique per row, e.g. count desc then term) without sorting a whole group
    in one task: phase 1 keeps the top k inside (group, hash(key) mod salts),
    phase 2 ranks the at most salts x k survivors of each group."""
    groups = list(groups)
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(F.col(key)), F.lit(salts)))
    w1 = Window.partitionBy(*groups, "_salt").orderBy(*order)
    cand = salted.withColumn("_r1", F.row_number().over(w1)).where(F.col("_r1") <= k).drop("_r1", "_salt")
    w2 = Window.partitionBy(*groups).orderBy(*order) if groups else Window.orderBy(*order)
    return cand.withColumn(out, F.row_number().over(w2)).where(F.col(out) <= k)


def ordered_bits(x: np.ndarray) -> np.ndarray:
    """64-bit integers in the order of the doubles ``x`` (NaN above all, -0 equal to 0)."""
    x = np.where(np.isnan(x), np.nan, x + 0.0)
    return _flip(x.view(np.int64))


def from_ordered_bits(keys: np.ndarray) -> np.ndarray:
    return _flip(np.asarray(keys, np.int64)).view(np.float64)


def _flip(bits: np.ndarray) -> np.ndarray:
    return bits ^ ((bits >> np.int64(63)) & np.int64(0x7FFFFFFFFFFFFFFF))


RADIX = 16  # bits that a scan tells apart


def _local_groups(pdf: pd.DataFrame, groups: list[str]):
    """(group as a tuple, None for null; row numbers) of a batch."""
    code = np.zeros(len(pdf), np.int64)
    for g in groups:
        c, u = pd.factorize(pdf[g], use_na_sentinel=False)
        code = code * len(u) + c
        _, code = np.unique(code, return_inverse=True)
    order = np.argsort(code, kind="stable")
    first = np.flatnonzero(np.diff(code[order], prepend=-1)) if len(code) else []
    for rows in np.split(order, first[1:]) if len(code) else []:
        head = pdf.iloc[rows[0]]
        yield tuple(None if pd.isna(head[g]) else head[g] for g in groups), rows


def _bucket_counts(df: DataFrame, groups: list[str], value: str, shift: int, wanted: dict | None, up_shift: int = 63) -> DataFrame:
    """(groups, _up, _p, _n, _lo, _hi): rows of each bucket of keys with equal bits from ``shift`` on,
    inside the buckets ``_up`` (bits from ``up_shift`` on, one scan back) that ``wanted`` names; summed per task."""
    def run(batches):
        held: dict = {}
        for pdf in batches:
            keys = ordered_bits(pdf[value].to_numpy(np.float64))
            for group, rows in _local_groups(pdf, groups):
                k = keys[rows]
                if wanted is not None:
                    k = k[np.isin(k >> up_shift, wanted.get(group, ()))]
                if len(k):
                    held.setdefault(group, []).append(_compact(np.sort(k), None, shift))
                    if len(held[group]) >= 64:
                        held[group] = [_merged(held[group], shift)]
        for group, parts in held.items():
            lo, hi, n = _merged(parts, shift)
            yield pd.DataFrame({**{g: [v] * len(n) for g, v in zip(groups, group)}, "_up": lo >> up_shift if wanted is not None else 0,
                                "_p": lo >> shift, "_n": n, "_lo": lo, "_hi": hi})

    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    shape = "".join(f"`{g}` {types[g]}, " for g in groups) + "_up long, _p long, _n long, _lo long, _hi long"
    part = df.select(*groups, F.col(value).cast("double").alias(value)).mapInPandas(run, shape)
    return part.groupBy(*groups, "_up", "_p").agg(F.sum("_n").alias("_n"), F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))


def _compact(keys: np.ndarray, counts: np.ndarray | None, shift: int, hi: np.ndarray | None = None):
    """Least key, greatest key and number of rows of each bucket of sorted ``keys``."""
    first = np.flatnonzero(np.diff(keys >> shift, prepend=(keys[0] >> shift) - 1))
    last = np.append(first[1:], len(keys)) - 1
    n = np.diff(np.append(first, len(keys))) if counts is None else np.add.reduceat(counts, first)
    return keys[first], (keys[last] if hi is None else np.maximum.reduceat(hi, first)), n


def _merged(parts: list, shift: int):
    lo, hi, n = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(lo, kind="stable")
    return _compact(lo[order], n[order], shift, hi[order])


def exact_quantiles(df: DataFrame, groups, value: str, probs, out_prefix: str = "q_") -> DataFrame:
    """Exact quantiles with linear interpolation (numpy's default) per group, by radix selection.

    Values become order-preserving 64-bit keys. A scan counts, for all groups at once, the
    rows per leading ``RADIX`` bits; the buckets that hold the wanted order statistics are
    counted by their next bits in the next scan, until a bucket holds one value; where the
    opened buckets hold at most 2 ** RADIX rows each, the next scan counts whole keys (four scans
    at most, two for most columns). Only bucket counts are shuffled, never values; the
    driver sees two rows for each (group, probability), so groups are classes and features,
    not keys. ``df`` is read once a scan: callers persist what is dear to compute.
    Nulls are left out; groups without values have no row."""
    groups, probs = list(groups), [float(p) for p in probs]
    spark = df.sparkSession
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    rows = df.where(F.col(value).isNotNull())
    found: dict = {}  # (group, probability's number, side) -> value
    place: dict = {}  # (group, number) -> position between the two order statistics
    wanted, left = None, {}  # group -> buckets to open; (group, number, side) -> (bucket, rank in it)
    shift, up_shift = 64 - RADIX, 63
    while True:
        b = _bucket_counts(rows, groups, value, shift, wanted, up_shift)
        w = Window.partitionBy(*groups, "_up")
        b = b.withColumn("_cum", F.sum("_n").over(w.orderBy("_p")))  # at most 2 ** RADIX buckets
        if wanted is None:
            b = b.withColumn("_all", F.sum("_n").over(w))
            asked = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), (F.lit(p) * (F.col("_all") - 1)).alias("at")) for i, p in enumerate(probs)]))
            b = b.select("*", asked.alias("_a")).select("*", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.floor("_a.at").alias("idx")),
                                                                               F.struct(F.lit(1).alias("side"), F.ceil("_a.at").alias("idx")))).alias("_t"))
            b = b.select(*groups, "_p", "_n", "_lo", "_hi", "_cum", F.col("_a.i").alias("_i"), F.col("_a.at").alias("_at"),
                         F.col("_t.side").alias("_side"), F.col("_t.idx").cast("long").alias("_idx"))
        else:
            asked = [(*g, i, side, up, idx) for (g, i, side), (up, idx) in left.items()]
            names = [f"_g{k}" for k in range(len(groups))]
            shape = "".join(f"{n} {types[g]}, " for n, g in zip(names, groups)) + "_i int, _side int, _w long, _idx long"
            on = F.col("_up") == F.col("_w")
            for n, g in zip(names, groups):
                on = on & F.col(g).eqNullSafe(F.col(n))
            b = b.join(F.broadcast(spark.createDataFrame(asked, shape)), on).withColumn("_at", F.lit(0.0))  # two rows a (group, probability)
        hit = b.where((F.col("_cum") - F.col("_n") <= F.col("_idx")) & (F.col("_idx") < F.col("_cum"))).collect()
        first, wanted, left, most = wanted is None, {}, {}, 0
        for r in hit:
            g = tuple(r[x] for x in groups)
            if first:
                place[g, r["_i"]] = r["_at"]
            if r["_lo"] == r["_hi"]:
                found[g, r["_i"], r["_side"]] = float(from_ordered_bits(np.array([r["_lo"]]))[0])
            else:
                left[g, r["_i"], r["_side"]] = (r["_p"], r["_idx"] - (r["_cum"] - r["_n"]))
                wanted.setdefault(g, set()).add(r["_p"])
                most = max(most, r["_n"])
        wanted = {g: np.array(sorted(v), np.int64) for g, v in wanted.items()}
        if not left:
            break
        shift, up_shift = (0 if most <= 1 << RADIX else shift - RADIX), shift
    out = []
    for g in dict.fromkeys(g for g, _ in place):
        q = []
        for i in range(len(probs)):
            a, b, at = found[g, i, 0], found[g, i, 1], place[g, i]
            q.append(a + (at - math.floor(at)) * (b - a) if a != b else a)
        out.append((*g, *q))
    shape = "".join(f"`{g}` {types[g]}, " for g in groups) + ", ".join(f"{out_prefix}{i} double" for i in range(len(probs)))
    if not out and not groups:
        out = [(None,) * len(probs)]
    return spark.createDataFrame(out, shape)
