"""Periodic runs of words: stretches that repeat with a fixed lag.

A run is a stretch of consecutive words with smallest period q (words q apart are
identical) of at least ``min_words`` words and ``min_periods`` periods that no
neighbouring word extends keeping the period. Every word of a run occurs at least
``min_periods`` times in it. So, for all texts of a batch at once:

1. Frequency splitting: within each segment (first: a whole text) words that occur
   less often than that split it; parts shorter than ``min_words`` are dropped and
   the others counted anew, until no segment changes. Runs stay whole.
2. Lag scan of the surviving segments: windows of 1, 2, 4, ... words get names
   (a window is the pair of its halves' names; windows that occur once drop out).
   With windows of l words, the distance from a window to the one before it of the
   same name is the lag q, of which l/2 < q <= l count; consecutive windows of
   equal lag q, from i to j, are the run [i - q, j + l). In a run of three periods
   every window that lies one period inside it has its nearest twin exactly one
   smallest period before, so each run is found once, with its smallest period,
   in n log n steps for n words however long the period.

Defined cases: a null or empty text has no words and no runs, its collapsed text
is empty; repeated rows give equal results; of runs that overlap each counts; other
columns pass through, columns of the outputs' names are replaced; empty tables
stay empty. Bytes that are not UTF-8 are compared as they are.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelab.llm.common import small_arrays

_MADE = ("struct<n_words:bigint,runs:array<struct<start:bigint,length:bigint,period:bigint>>,collapsed:string>")


def split(words: np.ndarray, ends: np.ndarray, min_words: int, min_count: int) -> np.ndarray:
    """Places of the words (ids, texts one after the other, ``ends`` where each text
    ends) that survive the splitting; places that do not follow each other, and ends
    of texts, bound the segments."""
    place = np.arange(len(words))
    segment = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    n_words, stable = int(words.max(initial=0)) + 1, []
    while len(place):
        long = np.bincount(segment) >= min_words
        keep = long[segment]
        place, segment = place[keep], segment[keep]
        _, segment = np.unique(segment, return_inverse=True)
        _, key, n = np.unique(segment * n_words + words[place], return_inverse=True, return_counts=True)
        keep = n[key] >= min_count
        changed = np.bincount(segment[~keep], minlength=int(segment.max(initial=-1)) + 1) > 0
        stable.append(place[~changed[segment]])
        keep &= changed[segment]
        place, segment = place[keep], segment[keep]
        cut = np.ones(len(place), bool)
        cut[1:] = (np.diff(place) > 1) | (np.diff(segment) > 0)
        segment = np.cumsum(cut) - 1
    return np.sort(np.concatenate(stable)) if stable else place


def scan(words: np.ndarray, ends: np.ndarray, place: np.ndarray, min_words: int, min_periods: int) -> np.ndarray:
    """(start, length, period) of every run in the segments of ``place``, by start and period."""
    cut = np.ones(len(place) + 1, bool)
    if len(place):
        cut[1:-1] = (np.diff(place) > 1) | (np.diff(np.searchsorted(ends, place, side="right")) > 0)
    bounds = np.flatnonzero(cut)
    sizes = np.diff(bounds)
    if not len(sizes):
        return np.zeros((0, 3), np.int64)
    # segments side by side with a mark of its own behind each
    at = np.arange(len(place)) + np.repeat(np.arange(len(sizes)), sizes)
    total = len(place) + len(sizes)
    origin = np.full(total, -1, np.int64)
    origin[at] = place
    name = np.full(total, -1, np.int64)  # of the window that begins here; -1 occurs once
    name[at] = words[place]
    i, found, window = at, [], 1
    while len(i):
        order = np.argsort(name[i], kind="stable")
        sorted_name, sorted_i = name[i][order], i[order]
        lag = np.zeros(total, np.int64)
        twin = sorted_name[1:] == sorted_name[:-1]
        lag[sorted_i[1:][twin]] = np.diff(sorted_i)[twin]
        on = np.flatnonzero((2 * lag > window) & (lag <= window))
        if len(on):
            q = lag[on]
            first = np.concatenate(([True], (np.diff(on) > 1) | (np.diff(q) != 0)))
            last = np.concatenate((first[1:], [True]))
            start, q = on[first] - q[first], q[first]
            length = on[last] + window - start
            ok = length >= np.maximum(min_words, min_periods * q)
            found.append(np.stack((origin[start[ok]], length[ok], q[ok]), axis=1))
        # windows of twice the size, where both halves occur again
        repeated = np.zeros(len(sorted_i), bool)
        repeated[1:] |= twin
        repeated[:-1] |= twin
        name[sorted_i[~repeated]] = -1
        i = np.sort(sorted_i[repeated])
        i = i[i + window < total]
        i = i[name[i + window] >= 0]
        pair = np.full(total, -1, np.int64)
        _, pair[i] = np.unique(name[i] * (int(name.max(initial=0)) + 1) + name[i + window], return_inverse=True)
        name, window = pair, 2 * window
        if window // 2 * min_periods > sizes.max():
            break  # longer lags do not fit any segment
    runs = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def find_runs(texts: list[bytes], min_words: int = 24, min_periods: int = 3) -> tuple[list[list[bytes]], list[np.ndarray]]:
    """Words and runs (start, length, period) of each text."""
    if min_periods < 3 or min_words < min_periods:
        raise ValueError("runs need three periods, and at least a word for each")
    words = [t.split() for t in texts]  # at ASCII white space
    number: dict[bytes, int] = defaultdict(count().__next__)
    sizes = np.array([len(w) for w in words], np.int64)
    ids = np.fromiter(map(number.__getitem__, chain.from_iterable(words)), np.int64, int(sizes.sum()))
    ends = np.cumsum(sizes)
    runs = scan(ids, ends, split(ids, ends, min_words, min_periods), min_words, min_periods)
    of = np.searchsorted(ends, runs[:, 0], side="right")
    runs[:, 0] -= (ends - sizes)[of]
    return words, np.split(runs, np.searchsorted(of, np.arange(1, len(texts)))) if texts else []


def collapse(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words but those that a run holds after its first period, joined by spaces."""
    if not len(runs):
        return b" ".join(words)
    step = np.zeros(len(words) + 1, np.int64)
    np.add.at(step, runs[:, 0] + runs[:, 2], 1)
    np.add.at(step, runs[:, 0] + runs[:, 1], -1)
    return b" ".join(words[k] for k in np.flatnonzero(np.cumsum(step[:-1]) == 0).tolist())


def with_runs(docs: DataFrame, text: str = "text", min_words: int = 24, min_periods: int = 3) -> DataFrame:
    """``docs`` with n_words, runs (start, length, period; by start, then period) and the
    collapsed text, in which only the first period of each run is left."""

    @F.arrow_udf(_MADE)
    def of(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            for piece in small_arrays(part):
                texts = [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in piece]
                words, runs = find_runs(texts, min_words, min_periods)
                flat = np.concatenate(runs) if runs else np.zeros((0, 3), np.int64)
                ends = np.concatenate(([0], np.cumsum([len(r) for r in runs]))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(
                    [pa.array(flat[:, k]) for k in range(3)], names=["start", "length", "period"]))
                left = pa.array([collapse(w, r) for w, r in zip(words, runs)], pa.binary())
                yield pa.StructArray.from_arrays(
                    [pa.array([len(w) for w in words], pa.int64()), lists, left.cast(pa.string(), safe=False)],
                    names=["n_words", "runs", "collapsed"])

    got = docs.withColumn("__periodic", of(F.col(f"`{text}`").cast("binary")))
    return got.withColumns({c: F.col(f"__periodic.{c}") for c in ("n_words", "runs", "collapsed")}).drop("__periodic")


def strongest(runs: Column) -> Column:
    """The run of greatest length / period, compared exactly; ties: smallest start, then period. Null without runs."""
    better = lambda a, r: a.isNull() | (r["length"] * a["period"] > a["length"] * r["period"])
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    return F.aggregate(runs, none, lambda a, r: F.when(better(a, r), r).otherwise(a))
