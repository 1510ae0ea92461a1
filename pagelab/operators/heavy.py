"""Most frequent terms with a shuffle that a sketch bounds, not the vocabulary.

An aggregation by term moves every distinct term of every task. Here each task keeps
a frequent-items summary of at most ``size`` counters a group (weighted
Misra-Gries: when there are more, the counter at rank ``size`` + 1 is taken off all,
and what is taken off adds to the task's error). The summaries are merged by sums;
a term's count lies between its sum and its sum plus the tasks' errors together, so

* a term can be among the k greatest only if its upper bound reaches the k-th lower
  bound: only those candidates are counted exactly, in a second scan that broadcasts them;
* a term without a counter occurs at most as often as the errors' sum. If that is not
  below the exact k-th count, the sketch proves nothing: it is widened four times and
  both scans run again. A summary from which nothing was ever taken off is exact.

So the result is always that of the full aggregation, ties by term included. When the
candidates pass ``max_candidates`` (flat distributions), they are not
broadcast: the terms are counted by the full aggregation.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelab.operators.stats import top_k_per_group
from pagelab.operators.text import counted
from pagelab.session import ensure_checkpoint_dir

WIDEN = 4
ROWS = 256  # documents whose distinct terms are Python strings at once


class Summary:
    """Frequent-items summary of one group: at most ``size`` counters after ``settle``."""

    def __init__(self, size: int):
        self.size, self.error, self.n = size, 0, {}

    def add(self, term: str, times: int) -> None:
        self.n[term] = self.n.get(term, 0) + times
        if len(self.n) > 2 * self.size:
            self.settle()

    def settle(self) -> None:
        if len(self.n) <= self.size:
            return
        held = np.fromiter(self.n.values(), np.int64, len(self.n))
        off = int(np.partition(held, len(held) - self.size - 1)[len(held) - self.size - 1])
        self.error += off
        self.n = {t: c - off for t, c in self.n.items() if c > off}


def _counts(terms: str):
    return counted(F.filter(F.col(terms), lambda t: t.isNotNull()))


def summaries(docs: DataFrame, terms: str, size: int, groups=()) -> DataFrame:
    """(groups, term, low, error): one row a counter of a task's summary, and per task and
    group one row of a null term that carries the error. Null term lists and null terms count nothing."""
    groups = list(groups)
    src = docs.select(*groups, _counts(terms).alias("_c"))
    fields = src.schema.fields[:-1]
    out = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "term string", "low long", "error long"])

    def summed(batches):
        held: dict[tuple, Summary] = {}
        for b in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            lists = b.column(len(groups))
            flat, row = lists.flatten(), pc.list_parent_indices(lists)
            each = pa.table([*(b.column(i).take(row) for i in range(len(groups))), flat.field(0), flat.field(1)],
                            names=[*groups, "_term", "_tf"])
            each = each.group_by([*groups, "_term"]).aggregate([("_tf", "sum")])  # the batch's distinct terms
            *keys, names, times = (each.column(c).to_pylist() for c in (*groups, "_term", "_tf_sum"))
            for key, term, n in zip(zip(*keys) if keys else [()] * len(names), names, times):
                if key not in held:
                    held[key] = Summary(size)
                held[key].add(term, n)
        for key, s in held.items():
            s.settle()
            rows = 1 + len(s.n)
            types = [b.schema.field(i).type for i in range(len(groups))]
            yield pa.RecordBatch.from_arrays(
                [*(pa.array([v] * rows, t) for v, t in zip(key, types)), pa.array([None, *s.n], pa.string()),
                 pa.array([0, *s.n.values()], pa.int64()), pa.array([s.error] + [0] * len(s.n), pa.int64())],
                names=[*groups, "term", "low", "error"])

    return src.mapInArrow(summed, out)


def frequent_terms(docs: DataFrame, terms: str, k: int, groups=(), size: int | None = None,
                   max_candidates: int = 500_000, max_bytes: int = 1 << 26) -> DataFrame:
    """(groups, term, total, df, rank): the ``k`` terms of each group with the largest total count
    (ties by term), exactly; total counts repeats, df rows with the term. ``size`` is the first
    width of the summaries (8 ``k`` by default); candidates are broadcast up to ``max_candidates``
    rows of ``max_bytes`` bytes of text.

    Defined results: null term lists, null terms and empty tables give no rows; a null group
    is a group of its own; fewer than ``k`` distinct terms give all of them."""
    groups, size = list(groups), size or 8 * k
    if k < 1 or size < 1:
        raise ValueError("k and size must be positive")
    ensure_checkpoint_dir(docs.sparkSession)
    long = docs.select(*groups, F.explode(_counts(terms)).alias("c")).select(*groups, "c.term", "c.tf")

    def ranked(counts: DataFrame) -> DataFrame:
        return top_k_per_group(counts, groups, [F.desc("total"), F.col("term")], k, "term", out="rank")

    def exact(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*groups, "term").agg(F.sum("tf").alias("total"), F.count(F.lit(1)).alias("df"))

    def aside(df: DataFrame, *more) -> DataFrame:
        return df.select(*[F.col(g).alias(f"_{g}") for g in groups], *more)

    same = F.lit(True)  # a group column and its underscored copy
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"_{g}"))
    while True:
        merged = summaries(docs, terms, size, groups).groupBy(*groups, "term").agg(
            F.sum("low").alias("low"), F.sum("error").alias("error")).checkpoint()
        held = merged.where(F.col("term").isNotNull()).select(*groups, "term", "low")
        errors = merged.where(F.col("term").isNull()).select(*groups, F.col("error").alias("_e"))  # one row a group
        # the k-th lower bound of each group; 0 where there are fewer counters
        low = top_k_per_group(held, groups, [F.desc("low"), F.col("term")], k, "term", out="_r").where(F.col("_r") == k)
        bounds = errors.join(aside(low, F.col("low").alias("_k")), same, "left")
        bounds = aside(bounds, "_e", F.coalesce("_k", F.lit(0)).alias("_k"))
        near = held.join(bounds if groups else F.broadcast(bounds), same).where(F.col("low") + F.col("_e") >= F.col("_k"))
        near = aside(near, F.col("term").alias("_term")).checkpoint()
        n, text = near.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("_term")), F.lit(0))).first()
        if n > max_candidates or text > max_bytes:
            return ranked(exact(long))
        top = ranked(exact(long.join(F.broadcast(near), (F.col("term") == F.col("_term")) & same, "left_semi"))).checkpoint()
        # proven where nothing was taken off, or the k-th exact count is above the errors
        kth = aside(top.where(F.col("rank") == k), F.col("total").alias("_t"))
        if errors.join(kth, same, "left").where((F.col("_e") > 0) & (F.coalesce("_t", F.lit(0)) <= F.col("_e"))).isEmpty():
            return top
        size *= WIDEN


def tfidf_vocabulary(docs: DataFrame, terms: str, max_features: int, size: int | None = None) -> DataFrame:
    """E2 by summaries: (term, idx, df, total, idf) as ``text.tfidf_fit`` gives without groups."""
    n = docs.count()
    top = frequent_terms(docs, terms, max_features, size=size)
    at = Window.orderBy("term")  # at most max_features rows
    return top.select("term", (F.row_number().over(at) - 1).alias("idx"), "df", "total",
                      (F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1).alias("idf"))


def id_vocabulary(docs: DataFrame, terms: str, vocab_size: int, first_id: int = 2, size: int | None = None) -> DataFrame:
    """E9 by summaries: (term, id, cnt) as ``text.frequency_vocab`` gives."""
    top = frequent_terms(docs, terms, vocab_size - first_id, size=size)
    return top.select("term", (F.col("rank") + first_id - 1).alias("id"), F.col("total").alias("cnt"))
