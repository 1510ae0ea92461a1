"""Importance resampling towards a target distribution by hashed word n-grams.

The n-grams (1 to ``max_words`` consecutive words, repeats counted) of the raw
documents and of the target texts are counted in ``buckets`` hash buckets. A
bucket's gain is the floored, scaled log ratio of its smoothed shares; a document
weighs the floored mean of its n-grams' gains. With a Gumbel number of its own
added, the documents of highest score are a sample without replacement that leans
towards the target.

Counting and weighing treat a batch of texts as one: the texts are joined with a
separator that no word holds, one regular expression pass finds all words, a
binary search of their places among the texts' offsets masks the n-grams that
would reach into the next text, and the buckets are counted at once. CRC-32 is
linear, so an n-gram's number follows from its words' numbers by table look-up;
each distinct word of a batch is hashed once. Only bucket counts (``buckets``
numbers a task) are shuffled and reach the driver.

Defined cases: null and empty texts have no words: weight 0, never drawn; a null
doc_id hashes as the empty string and ranks behind all others of its score; rows
that agree in score and doc_id rank in an order that is fixed once the scores are
stored; without target texts all targets count 0; columns of the outputs' names
are replaced, others pass through; empty tables give empty results.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from fractions import Fraction
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelab.llm.common import checkpointed, small_arrays
from pagelab.operators.sample import global_rank

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")  # of lower-cased UTF-8 bytes
SEPARATOR = b"\0"
_IN_WORD = np.array([WORD.fullmatch(bytes([b])) is not None for b in range(256)])
_STEPS = 64  # shifts by up to so many bytes have a table of their own


def _shift_tables() -> np.ndarray:
    """[n, k, byte]: the CRC register ``byte << 8 k`` after n zero bytes."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, (one >> 1) ^ np.uint32(0xEDB88320), one >> 1)
    out = np.zeros((_STEPS + 1, 4, 256), np.uint32)
    for k in range(4):
        x = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
        for n in range(_STEPS + 1):
            out[n, k] = x
            x = (x >> np.uint32(8)) ^ one[x & np.uint32(255)]
    return out


_SHIFT = _shift_tables()


def _shifted(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``crc`` of some bytes, moved on by n zero bytes."""
    crc, n = crc.copy(), n.copy()
    while (far := np.flatnonzero(n > _STEPS)).size:
        crc[far] = _shifted(crc[far], np.full(len(far), _STEPS))
        n[far] -= _STEPS
    out = _SHIFT[n, 0, crc & 255]
    for k in (1, 2, 3):
        out = out ^ _SHIFT[n, k, (crc >> np.uint32(8 * k)) & 255]
    return out


def _joined_crc(crc: np.ndarray, more: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-32 of texts of CRC ``crc`` followed by texts of CRC ``more`` and ``size`` bytes."""
    return _shifted(crc, size) ^ more


def features(texts: list[bytes], max_words: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of every n-gram, its text's number, words of each text)."""
    joined = SEPARATOR.join(texts).lower()
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
    place: dict[bytes, int] = defaultdict(count().__next__)  # numbers words as they come
    words = WORD.findall(joined)
    word = np.fromiter(map(place.__getitem__, words), np.int64, len(words))
    inside = _IN_WORD[np.frombuffer(SEPARATOR + joined, np.uint8)]
    starts = np.flatnonzero(inside[1:] & ~inside[:-1])
    text = np.searchsorted(begins, starts, side="right") - 1
    crc = np.fromiter(map(zlib.crc32, place), np.uint32, len(place))[word]
    size = np.fromiter(map(len, place), np.int64, len(place))[word]
    space = np.uint32(zlib.crc32(b" "))
    found, of, gram = [crc], [text], crc
    for n in range(2, max_words + 1):
        ahead = _joined_crc(gram[:-1], space, np.ones(max(0, len(gram) - 1), np.int64))
        gram = _joined_crc(ahead, crc[n - 1:], size[n - 1:])  # n-gram from each word on
        whole = text[:len(gram)] == text[n - 1:]  # not into the next text
        found.append(gram[whole])
        of.append(text[:len(gram)][whole])
    return (np.concatenate(found) % np.uint32(buckets)).astype(np.int64), np.concatenate(of), \
        np.bincount(text, minlength=len(texts))


def _raw(part: pa.Array) -> Iterator[list[bytes]]:
    for piece in small_arrays(part):
        yield [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in piece]


def bucket_counts(docs: DataFrame, text: str = "text", max_words: int = 2, buckets: int = 10_000) -> DataFrame:
    """(bucket, n): n-grams of all texts in each bucket that has any, summed per task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for texts in _raw(b.column(0)):
                total += np.bincount(features(texts, max_words, buckets)[0], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    return (docs.select(F.col(f"`{text}`").cast("binary")).mapInArrow(run, "bucket bigint, n bigint")
            .groupBy("bucket").agg(F.sum("n").alias("n")))


def _vector(counts: DataFrame, buckets: int) -> list[int]:
    out = [0] * buckets
    for r in counts.collect():  # at most one row a bucket
        out[r["bucket"]] = r["n"]
    return out


def gains(source: list[int], target: list[int], scale: int = 1000) -> list[int]:
    """floor(scale ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))) of every bucket, in doubles."""
    of_source, of_target, b = sum(source), sum(target), len(source)
    return [math.floor(scale * math.log((t + 1) * (of_source + b) / ((s + 1) * (of_target + b))))
            for s, t in zip(source, target)]


def learn(docs: DataFrame, target: DataFrame, text: str = "text", max_words: int = 2, buckets: int = 10_000) -> list[int]:
    """Gains of all buckets from whole texts of both tables."""
    counted = [_vector(bucket_counts(d, text, max_words, buckets), buckets) for d in (docs, target)]
    return gains(*counted)


def weigh(docs: DataFrame, gain: list[int], text: str = "text", max_words: int = 2) -> DataFrame:
    """``docs`` with n_words, n_features and weight."""
    buckets, shared = len(gain), docs.sparkSession.sparkContext.broadcast(np.array(gain, np.int64))

    @F.arrow_udf("struct<n_words:bigint,n_features:bigint,weight:bigint>")
    def of(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            for texts in _raw(part):
                bucket, at, n_words = features(texts, max_words, buckets)
                n = np.bincount(at, minlength=len(texts))
                total = np.zeros(len(texts), np.int64)
                order = np.argsort(at, kind="stable")  # integer sums, exact at any length
                first = np.flatnonzero(np.diff(at[order], prepend=-1))
                if len(first):
                    total[at[order][first]] = np.add.reduceat(shared.value[bucket[order]], first)
                yield pa.StructArray.from_arrays(
                    [pa.array(n_words), pa.array(n), pa.array(total // np.maximum(n, 1))],
                    names=["n_words", "n_features", "weight"])

    got = docs.withColumn("__weighed", of(F.col(f"`{text}`").cast("binary")))
    return got.withColumns({c: F.col(f"__weighed.{c}") for c in ("n_words", "n_features", "weight")}).drop("__weighed")


def gumbel(key: Column, seed: int, scale: int = 1000) -> Column:
    """floor(scale x a standard Gumbel number) that the key fixes: from the first 32 bits of sha256("seed:key")."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-scale * F.log(-F.log((h + 0.5) / 4294967296.0)))


def draw(weighed: DataFrame, share: Fraction = Fraction(1, 4), min_words: int = 20, seed: int = 7,
         key: str = "doc_id") -> DataFrame:
    """``weighed`` with score and rank: of the N rows of at least ``min_words`` words,
    floor(share N) of highest score are drawn and ranked from 1, ties by key; the rank
    of other rows is null.

    The rows are stored once in the shared folder; ranks come from ranges of
    (score, key) sorted apart, so neither one score nor one key repeated in many rows
    is sorted by one task."""
    x = weighed.withColumn("score", F.col("weight") + gumbel(F.col(f"`{key}`"), seed)) \
        .withColumn("__row", F.monotonically_increasing_id())
    x = checkpointed(x)
    fit = F.coalesce(F.col("n_words") >= min_words, F.lit(False))
    chosen = math.floor(share * x.where(fit).count())
    ranked = global_rank(x.where(fit), [F.desc("score"), F.asc_nulls_last(f"`{key}`"), F.asc("__row")], out="rank")
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= chosen, F.col("rank")).cast("bigint"))
    return ranked.unionByName(x.where(~fit).withColumn("rank", F.lit(None).cast("bigint"))).drop("__row")
