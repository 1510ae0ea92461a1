"""Mid-ranks of whole columns from a rank dictionary.

The dictionary holds, for each column, its distinct values in order with running
counts. It is made by two shuffles of distinct values (summed per task, then sorted
by ranges) and stored as raw arrays in the shared folder, a file for each range.
Readers map the files and search them for whole Arrow batches, so the rows themselves
are neither unpivoted nor shuffled, a value that half of all rows share is one entry,
and a worker's memory does not follow the number of distinct values.

Where the shared folder is no mounted one, Spark fetches the files for each executor.
A worker that does not see them all, whole, raises.
"""

from __future__ import annotations

import glob
import mmap
import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelab.operators.stats import ordered_bits

HELD = 1 << 20  # distinct values a counting task keeps before it sends them on


@dataclass(frozen=True)
class RankDictionary:
    path: str
    columns: tuple[str, ...]
    rows: int
    #: column number -> [(file, bytes, first key, rows before, offset of its keys, distinct values)]
    parts: dict

    def open(self) -> dict[int, list[tuple]]:
        """column -> [(first key, rows before, keys, running counts)], mapped."""
        u = urlparse(self.path)
        here = u.path if u.scheme in ("", "file") else SparkFiles.get(os.path.basename(self.path))
        maps, out = {}, {}
        for j, parts in self.parts.items():
            for file, size, first, before, at, n in parts:
                if file not in maps:
                    names = glob.glob(f"{glob.escape(here)}/{file}*")
                    if len(names) != 1 or os.path.getsize(names[0]) != size:
                        raise FileNotFoundError(f"{self.path}: this worker sees the ranks in part ({file})")
                    with open(names[0], "rb") as f:
                        maps[file] = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
                keys, upto = np.frombuffer(maps[file], "<i8", n, at), np.frombuffer(maps[file], "<i8", n, at + 8 * n)
                out.setdefault(j, []).append((first, before, keys, upto))
        return out


def mid_ranks_of(parts: list[tuple], keys: np.ndarray) -> np.ndarray:
    """Mid-rank of each key: rows below, and half of one more than the rows that share it."""
    out = np.zeros(len(keys))
    which = np.searchsorted(np.array([p[0] for p in parts]), keys, side="right") - 1
    for k in np.unique(which):
        _, before, known, upto = parts[k]
        at = np.flatnonzero(which == k)
        i = np.searchsorted(known, keys[at])
        below = np.where(i > 0, upto[i - 1], 0)
        out[at] = before + below + (upto[i] - below + 1) / 2.0
    return out


def _wide(df: DataFrame, columns: list[str]) -> DataFrame:
    # values are compared at 9 decimals so that float noise does not split ties
    return df.select(*[F.round(F.col(c).cast("double"), 9).alias(f"c{j}") for j, c in enumerate(columns)])


def build(df: DataFrame, columns: list[str]) -> RankDictionary:
    """The dictionary of ``columns`` of all rows (nulls and NaN rank as one value above all)."""
    from pagelab.session import scratch_path
    spark, d = df.sparkSession, len(columns)

    def ship(held: list[list[np.ndarray]]) -> pd.DataFrame:
        parts = [np.unique(np.concatenate(h), return_counts=True) if h else (np.zeros(0, np.int64), np.zeros(0, np.int64)) for h in held]
        return pd.DataFrame({"j": np.repeat(np.arange(d), [len(k) for k, _ in parts]), "k": np.concatenate([k for k, _ in parts]),
                             "n": np.concatenate([n for _, n in parts])})

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [[] for _ in range(d)], 0
        for pdf in batches:
            for j in range(d):
                held[j].append(ordered_bits(pdf[f"c{j}"].to_numpy(np.float64)))
            size += len(pdf) * d
            if size > HELD:
                yield ship(held)
                held, size = [[] for _ in range(d)], 0
        if size:
            yield ship(held)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = [(b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy()) for b in batches if b.num_rows]
        if not table:
            return
        j, k, n = (np.concatenate(x) for x in zip(*table))
        first = np.flatnonzero(np.diff(j, prepend=-1))
        head, body, at = [len(first)], [], 8 * (1 + 5 * len(first))
        for a, b in zip(first, np.append(first[1:], len(j))):
            upto = np.cumsum(n[a:b])
            head += [int(j[a]), int(k[a]), int(upto[-1]), at, int(b - a)]
            body += [k[a:b].astype("<i8").tobytes(), upto.astype("<i8").tobytes()]
            at += 16 * int(b - a)
        yield pa.RecordBatch.from_arrays([pa.array([np.array(head, "<i8").tobytes() + b"".join(body)], pa.binary())], names=["payload"])

    path = scratch_path(spark, f"ranks_{uuid.uuid4().hex}")
    n_ranges = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    distinct = _wide(df, columns).mapInPandas(count, "j int, k long, n long").groupBy("j", "k").agg(F.sum("n").alias("n"))
    (distinct.repartitionByRange(n_ranges, "j", "k").sortWithinPartitions("j", "k").mapInArrow(pack, "payload binary")
     .select(F.col("payload").cast("string")).write.text(path))
    if urlparse(path).scheme not in ("", "file"):
        spark.sparkContext.addFile(path, recursive=True)
    files = spark.read.format("binaryFile").load(path).where("length > 0")
    heads = files.select(F.regexp_extract("path", r"(part-\d+)[^/]*$", 1).alias("file"), "length",
                         F.substring("content", 1, 8 * (1 + 5 * d)).alias("head")).collect()  # a head a range
    found = []
    for r in heads:
        head = np.frombuffer(bytes(r["head"])[:len(r["head"]) // 8 * 8], "<i8")
        found += [(int(x[0]), int(x[1]), r["file"], r["length"], int(x[2]), int(x[3]), int(x[4])) for x in head[1:1 + 5 * head[0]].reshape(-1, 5)]
    parts, before = {}, {}
    for j, first, file, size, total, at, n in sorted(found):
        parts.setdefault(j, []).append((file, size, first, before.get(j, 0), at, n))
        before[j] = before.get(j, 0) + total
    return RankDictionary(path, tuple(columns), before.get(0, 0), parts)


def rank_products(df: DataFrame, ranks: RankDictionary) -> np.ndarray:
    """Sums over all rows of the products of centred mid-ranks, [column, column]. The centre of
    every column's ranks is (rows + 1) / 2; each task sends one matrix."""
    d, centre = len(ranks.columns), (ranks.rows + 1) / 2.0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, known = np.zeros((d, d)), None
        for pdf in batches:
            known = known or ranks.open()
            r = np.stack([mid_ranks_of(known[j], ordered_bits(pdf[f"c{j}"].to_numpy(np.float64))) for j in range(d)]) - centre
            total += r @ r.T
        if known:
            i, j = np.tril_indices(d)
            yield pd.DataFrame({"i": i, "j": j, "s": total[i, j]})

    sums = _wide(df, list(ranks.columns)).mapInPandas(run, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s"))
    out = np.zeros((d, d))
    for r in sums.collect():  # one row a pair of columns
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["s"]
    return out


def with_ranks(df: DataFrame, ranks: RankDictionary, out: str = "ranks") -> DataFrame:
    """``df`` with the array of mid-ranks of the dictionary's columns, looked up in place."""
    @F.pandas_udf("array<double>")
    def of(x: pd.DataFrame) -> pd.Series:
        known = ranks.open()
        r = np.stack([mid_ranks_of(known[j], ordered_bits(x[f"c{j}"].to_numpy(np.float64))) for j in range(len(ranks.columns))], axis=1)
        return pd.Series(list(r))

    wide = F.struct(*[F.round(F.col(c).cast("double"), 9).alias(f"c{j}") for j, c in enumerate(ranks.columns)])
    return df.withColumn(out, of(wide))
