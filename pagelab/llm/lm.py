"""Interpolated modified Kneser-Ney bigram model: counted in Spark, stored as
sorted hash arrays, memory-mapped by the workers that score.

Tokens are the words of a text (A-Z folded, cut at ASCII white space) and one
end mark; a start mark is context only. Steps, each one shuffle of packed,
already summed counts:

1. vocabulary: (XXH64 of the word, count), dealt by the top bits of the hash,
   so that the files in order are one sorted array; a word's id is its place.
2. bigrams: (id of the context, id of the word) in one 64-bit key, counted per
   task, dealt by ranges of the context id, summed and stored sorted, with the
   totals and the counts of ones, twos and more of each context.
3. continuations: how many contexts each word has, from the stored bigrams,
   dealt by ranges of the word id.

Then p(w|u) = max(c(uw) - D(c), 0) / c(u) + g(u) p1(w), and p1 alike from the
continuation counts, with the rest spread evenly over the vocabulary and one
unknown word. The discounts come from the counts of counts. A context that was
never seen leaves p1.

Files are raw little-endian arrays written by Spark into the shared folder
(any file system); workers map them in place where that folder is a mounted
one, else from the copy that Spark fetches for each executor; a worker that does
not see all of what training wrote raises. No array passes
through the driver; it learns sizes and counts of counts only. Model size and
traffic grow with the corpus, nothing is pruned or sampled.

Defined cases: a null or empty text is the end mark alone; a null doc_id is
trained on; unseen words have no count; with no training text every token is
unknown and scores by the uniform rest; repeated rows count as often as they occur.
"""

from __future__ import annotations

import functools
import glob
import math
import mmap
import os
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import count
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelab.llm.common import shared_path, small_batches

SEED = 0
BATCH_BYTES = 2 << 20  # text looked up at a time
_LOW = np.uint64(0xFFFFFFFF)
_SHIP = "bucket int, payload binary"
#: Arrays of a bucket of words, bigrams and continuations; totals come first.
_ARRAYS = {"w": ["<i8", "<u8", "<i8"], "b": ["<i8", "<u8", "<u4", "<i8", "<u4", "<u4", "<u4"], "c": ["<i8", "<u4"]}


def held_out(doc_id: Column) -> Column:
    """One document in seven, by the CRC-32 of its id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def words_of(raw: bytes | None) -> list[bytes]:
    return (raw.lower().split() if raw else []) + [b""]  # the empty word is the end mark


word_hash = functools.partial(xxhash.xxh64_intdigest, seed=SEED)


# -- files: one per bucket, a header of eight 64-bit numbers and raw arrays ------
def _pack(*arrays: np.ndarray) -> bytes:
    head = np.zeros(8, "<u8")
    head[:len(arrays)] = [a.nbytes for a in arrays]
    return head.tobytes() + b"".join(a.tobytes() + b"\0" * (-a.nbytes % 8) for a in arrays)


def _unpack(data, types: list[str]) -> list[np.ndarray]:
    head, at, out = np.frombuffer(data, "<u8", 8), 64, []
    for size, t in zip(head.tolist(), types):
        out.append(np.frombuffer(data, t, size // np.dtype(t).itemsize, at))
        at += size + (-size % 8)
    return out


def _store(rows: DataFrame, path: str) -> None:
    """Write each row's ``payload`` as a file part-<bucket>: raw bytes and a newline."""
    rows.select(F.col("payload").cast("string")).write.text(path)


def _local(path: str) -> str:
    """Where a worker finds the files of ``path``."""
    u = urlparse(path)
    return u.path if u.scheme in ("", "file") else SparkFiles.get(os.path.basename(path))


def _share(spark: SparkSession, path: str) -> str:
    if urlparse(path).scheme not in ("", "file"):
        spark.sparkContext.addFile(path, recursive=True)  # executors fetch it from the store
    return path


def _bucket(name: str) -> int:
    return int(re.match(r"part-(\d+)", os.path.basename(name))[1])


def _sizes(spark: SparkSession, path: str) -> dict[int, int]:
    """bucket -> bytes of its file, as the shared folder lists them; no content is read."""
    rows = spark.read.format("binaryFile").load(path).select("path", "length").collect()  # one row a bucket
    return {_bucket(r["path"]): r["length"] for r in rows if r["length"]}


def _open(path: str, types: list[str], sizes: dict[int, int]) -> dict[int, list[np.ndarray]]:
    """bucket -> mapped arrays, the bucket's totals first. A worker that does not see
    every file that training wrote, whole, raises."""
    here = {_bucket(n): n for n in glob.glob(f"{glob.escape(_local(path))}/part-*")}
    out = {}
    for bucket, size in sizes.items():
        if bucket not in here or os.path.getsize(here[bucket]) != size:
            raise FileNotFoundError(f"{path}: this worker sees the model in part (bucket {bucket})")
        with open(here[bucket], "rb") as f:
            data = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        out[bucket] = _unpack(data, types)
    return out


def _totals(model: "Model", level: str) -> dict[int, list[int]]:
    """bucket -> the totals at the head of its file (one small row a bucket)."""
    spark, buckets = SparkSession.active(), sorted(model.files[level])

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [pa.array(at, pa.int64()), pa.array([model.maps()[level][k][0].tolist() for k in at], pa.list_(pa.int64()))],
                names=["bucket", "totals"])

    rows = spark.createDataFrame([(k,) for k in buckets], "bucket long").repartition(max(1, len(buckets) // 16))
    return {r["bucket"]: r["totals"] for r in rows.mapInArrow(heads, "bucket long, totals array<bigint>").collect()}


def _dealt(rows: DataFrame, buckets: int, merge) -> DataFrame:
    """Send shipped rows to the partition of their bucket and merge each there."""
    return rows.repartitionById(buckets, F.col("bucket")).mapInArrow(merge, "payload binary")


def _payload(*arrays: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([_pack(*arrays)], pa.binary())], names=["payload"])


def _of_counts(n: np.ndarray) -> np.ndarray:
    """How many counts are 1, 2, 3, 4, and any."""
    return np.array([*((n == k).sum() for k in (1, 2, 3, 4)), len(n)], "<i8")


def _emit(buckets: list[int], payloads: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), pa.array(payloads, pa.binary())],
                                      names=["bucket", "payload"])


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], (np.add.reduceat(counts, first) if len(first) else counts[:0])


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys.sort()
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.diff(first, append=len(keys))


def _squeeze(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys and counts in few bytes: gaps and counts as variable-length numbers."""
    gaps = np.diff(keys, prepend=np.uint64(0))
    return _pack(np.array([len(keys)], "<u8"), _varint(gaps), _varint(counts.astype(np.uint64)))


def _varint(x: np.ndarray) -> np.ndarray:
    """Seven bits a byte, low bits first, the top bit marks that more follow."""
    size = np.ones(len(x), np.int64)
    for k in range(1, 10):
        size += x >> np.uint64(7 * k) > 0
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if len(x) else 0, np.uint8)
    at = ends - size
    for k in range(int(size.max()) if len(x) else 0):
        on = size > k
        byte = (x[on] >> np.uint64(7 * k)).astype(np.uint8) & 0x7F
        out[at[on] + k] = byte | np.where(size[on] > k + 1, 0x80, 0).astype(np.uint8)
    return out


def _unvarint(raw: np.ndarray, n: int) -> np.ndarray:
    last = np.flatnonzero(raw < 0x80)
    start = np.concatenate(([0], last[:-1] + 1))
    size = last - start + 1
    out = np.zeros(n, np.uint64)
    for k in range(int(size.max()) if n else 0):
        on = size > k
        out[on] |= (raw[start[on] + k] & np.uint8(0x7F)).astype(np.uint64) << np.uint64(7 * k)
    return out


def _stretch(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, gaps, counts = _unpack(data, ["<u8", "u1", "u1"])
    return np.cumsum(_unvarint(gaps, int(n[0])), dtype=np.uint64), _unvarint(counts, int(n[0])).astype(np.int64)


def _gathered(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    """Sum of all shipped (keys, counts) of one bucket."""
    keys, counts, size = [], [], 0
    for b in batches:
        for x in b.column("payload"):
            k, c = _stretch(x.as_buffer().to_pybytes())
            keys.append(k)
            counts.append(c)
            size += len(k)
            if len(keys) > 1 and size > 8 << 20:
                k, c = _summed(np.concatenate(keys), np.concatenate(counts))
                keys, counts, size = [k], [c], len(k)
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return _summed(np.concatenate(keys), np.concatenate(counts))


# -- the model -------------------------------------------------------------------
@dataclass
class Model:
    """Paths and totals; workers open the arrays when they first score."""
    words: str
    bigrams: str
    continuations: str
    bits: int  # the vocabulary is dealt by so many top bits
    starts: list[int]  # first id of each vocabulary bucket
    n_tokens: int
    n_types: int
    ranges: int  # buckets of ids
    d2: tuple[float, float, float]
    d1: tuple[float, float, float]
    n_bigrams: int  # distinct ones: the sum of all continuation counts
    rest1: float  # mass that the unigram level leaves to the uniform one
    files: dict = field(default_factory=dict)  # level -> bucket -> bytes
    _maps: dict = field(default_factory=dict, repr=False)

    def width(self) -> int:
        """Ids per bucket; the id after the last word is the start mark."""
        return -(-(self.n_types + 1) // self.ranges)

    def __getstate__(self):
        return {**self.__dict__, "_maps": {}}

    def maps(self) -> dict:
        key = os.getpid()
        if key not in self._maps:
            self._maps.clear()
            self._maps[key] = {
                level: _open(path, _ARRAYS[level], self.files[level])
                for level, path in (("w", self.words), ("b", self.bigrams), ("c", self.continuations)) if path}
        return self._maps[key]

    # ids ------------------------------------------------------------------------
    def lookup(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(id, training count) of word hashes; -1 and 0 where unseen."""
        ids, counts = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        part = (hashes >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(hashes), np.int64)
        for p in np.unique(part):
            if p in self.maps().get("w", ()):
                _, known, n = self.maps()["w"][p]
                at = np.flatnonzero(part == p)
                i = np.minimum(np.searchsorted(known, hashes[at]), len(known) - 1)
                ok = known[i] == hashes[at]
                ids[at[ok]] = self.starts[p] + i[ok]
                counts[at[ok]] = n[i[ok]]
        return ids, counts

    def ids_of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(id, count) of each word; each distinct word is looked up once."""
        place: dict[bytes, int] = defaultdict(count().__next__)  # numbers words as they come
        at = np.fromiter(map(place.__getitem__, words), np.int64, len(words))
        ids, counts = self.lookup(np.fromiter(map(word_hash, place), np.uint64, len(place)))
        return ids[at], counts[at]

    # probabilities ----------------------------------------------------------------
    def unigram(self, ids: np.ndarray) -> np.ndarray:
        a = np.zeros(len(ids), np.int64)
        width = self.width()
        for p in np.unique(ids[ids >= 0] // width):
            at = np.flatnonzero(ids // width == p)
            if p in self.maps().get("c", ()):
                a[at] = self.maps()["c"][p][1][ids[at] - p * width]
        total = max(1, self.n_bigrams)
        return _less(a, self.d1) / total + self.rest1 / (self.n_types + 1)

    def bigram(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """p(right|left) of ids; -1 is an unseen word."""
        out = self.unigram(right)
        width = self.width()
        part = np.where(left >= 0, left // width, -1)
        for p in np.unique(part):
            if p < 0 or p not in self.maps().get("b", ()):
                continue
            _, keys, counts, total, n1, n2, n3 = self.maps()["b"][p]
            at = np.flatnonzero(part == p)
            u = left[at] - p * width
            t = total[u]
            seen = t > 0
            at, u, t = at[seen], u[seen], t[seen]
            k = (left[at].astype(np.uint64) << np.uint64(32)) | np.maximum(right[at], 0).astype(np.uint64)
            i = np.minimum(np.searchsorted(keys, k), len(keys) - 1)
            c = np.where((keys[i] == k) & (right[at] >= 0), counts[i], 0).astype(np.int64)
            rest = (self.d2[0] * n1[u] + self.d2[1] * n2[u] + self.d2[2] * n3[u]) / t
            out[at] = _less(c, self.d2) / t + rest * out[at]
        return out


def _less(c: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    """max(c - D(c), 0)."""
    return np.maximum(c - np.choose(np.minimum(c, 3), (0.0, *d)), 0.0)


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """D1, D2 and D3+ from the numbers of counts one to four. A count that does not
    occur leaves the plain steps 0.5, 1 and 1.5; none is above its count."""
    y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.0
    raw = [1 - 2 * y * n2 / n1 if n1 and n2 else 0.5,
           2 - 3 * y * n3 / n2 if n2 and n3 else 1.0,
           3 - 4 * y * n4 / n3 if n3 and n4 else 1.5]
    return tuple(min(max(d, 0.0), float(k)) for k, d in enumerate(raw, 1))


def _texts(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[list[list[bytes]]]:
    for b in small_batches(batches, column, BATCH_BYTES):
        yield [words_of(x.as_buffer().to_pybytes() if x.is_valid else None) for x in b.column(column)]


def train(docs: DataFrame, *, tokens_per_bucket: int = 4_000_000, words_per_bucket: int = 1_000_000,
          flush_words: int = 1_000_000) -> Model:
    """Count the texts of ``docs`` (column text) and store the model in the shared folder.

    The numbers of buckets follow from the bytes of text, so a task's arrays stay
    of one size whatever the corpus; ``flush_words`` distinct words (or four times
    as many bigrams) are held by a counting task before it ships them."""
    spark = docs.sparkSession
    raw = docs.select(F.col("text").cast("binary").alias("text"))
    chars = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(0, math.ceil(math.log2(max(1, chars / 60 / words_per_bucket))))

    def ship(counts: dict[int, int]) -> pa.RecordBatch:
        keys = np.fromiter(counts, np.uint64, len(counts))
        n = np.fromiter(counts.values(), np.int64, len(counts))
        keys, n = _summed(keys, n)
        cut = np.searchsorted(keys, [np.uint64(b << (64 - bits)) for b in range(1, 1 << bits)]) if bits else np.zeros(0, int)
        parts = [(b, k, c) for b, (k, c) in enumerate(zip(np.split(keys, cut), np.split(n, cut))) if len(k)]
        return _emit([p[0] for p in parts], [_squeeze(k, c) for _, k, c in parts])

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for texts in _texts(batches):
            for ws in texts:
                held.update(ws)
            if len(held) > flush_words:
                yield ship({word_hash(w): c for w, c in held.items()})
                held = Counter()
        if held:
            yield ship({word_hash(w): c for w, c in held.items()})

    def merge_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n = _gathered(batches)
        if len(keys):
            yield _payload(np.array([len(keys), n.sum()], "<i8"), keys, n)

    words = shared_path(spark, "lm-words")
    _store(_dealt(raw.mapInArrow(count_words, _SHIP), 1 << bits, merge_words), words)
    model = Model(_share(spark, words), "", "", bits, [], 0, 0, 1, (0, 0, 0), (0, 0, 0), 0, 1.0,
                  {"w": _sizes(spark, words)})
    totals = _totals(model, "w")
    for b in range(1 << bits):
        model.starts.append(model.n_types)
        model.n_types += totals.get(b, (0, 0))[0]
        model.n_tokens += totals.get(b, (0, 0))[1]
    n_types = model.n_types
    if n_types + 1 >= 1 << 32:
        raise ValueError("word ids take 32 bits: over four billion distinct words")
    model.ranges = max(1, math.ceil(model.n_tokens / tokens_per_bucket))
    width, ranges = model.width(), model.ranges

    def by_range(keys, n, shift):
        edges = [np.uint64((b * width) << shift) for b in range(1, ranges)]
        cut = np.searchsorted(keys, np.array(edges, np.uint64)) if edges else np.zeros(0, int)
        parts = [(b, k, c) for b, (k, c) in enumerate(zip(np.split(keys, cut), np.split(n, cut))) if len(k)]
        return _emit([p[0] for p in parts], [_squeeze(k, c) for _, k, c in parts])

    def count_bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for texts in _texts(batches):
            ids, _ = model.ids_of([w for ws in texts for w in ws])
            left = np.concatenate(([n_types], ids[:-1]))
            ends = np.cumsum([len(ws) for ws in texts])
            left[ends[:-1]] = n_types  # each text begins with the start mark
            held.append((left.astype(np.uint64) << np.uint64(32)) | ids.astype(np.uint64))
            size += len(ids)
            if size > 4 * flush_words:
                yield by_range(*_counted(np.concatenate(held)), 32)
                held, size = [], 0
        if size:
            yield by_range(*_counted(np.concatenate(held)), 32)

    def merge_bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n = _gathered(batches)
        if not len(keys):
            return
        left = (keys >> np.uint64(32)).astype(np.int64)
        b = int(left[0]) // width
        left -= b * width
        per = [np.bincount(left, n, width).astype("<i8")] + [
            np.bincount(left[on], minlength=width).astype("<u4") for on in (n == 1, n == 2, n >= 3)]
        yield _payload(_of_counts(n), keys, np.minimum(n, 0xFFFFFFFF).astype("<u4"), *per)

    def summed(level: str, path: str) -> dict[str, int]:
        model.files[level] = _sizes(spark, path)
        rows = [*_totals(model, level).values(), [0] * 5]
        return dict(zip(("n1", "n2", "n3", "n4", "n"), map(sum, zip(*rows))))

    bigrams = shared_path(spark, "lm-bigrams")
    _store(_dealt(raw.mapInArrow(count_bigrams, _SHIP), ranges, merge_bigrams), bigrams)
    model.bigrams = _share(spark, bigrams)
    of2 = summed("b", bigrams)
    model.d2 = discounts(*[of2[f"n{k}"] for k in (1, 2, 3, 4)])
    model.n_bigrams = of2["n"]

    def count_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in b.column(0).to_pylist():
                if p in model.maps()["b"]:
                    right = model.maps()["b"][p][1] & _LOW
                    yield by_range(*_counted(right), 0)

    def merge_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n = _gathered(batches)
        if not len(keys):
            return
        at = keys.astype(np.int64)
        full = np.zeros(width, "<u4")
        full[at - int(at[0]) // width * width] = n
        yield _payload(_of_counts(n), full)

    continuations = shared_path(spark, "lm-continuations")
    buckets = spark.range(0, ranges, 1, ranges)
    _store(_dealt(buckets.mapInArrow(count_contexts, _SHIP), ranges, merge_contexts), continuations)
    model.continuations = _share(spark, continuations)
    of1 = summed("c", continuations)
    model.d1 = discounts(*[of1[f"n{k}"] for k in (1, 2, 3, 4)])
    d, total = model.d1, max(1, model.n_bigrams)
    three = of1["n"] - of1["n1"] - of1["n2"]
    model.rest1 = (d[0] * of1["n1"] + d[1] * of1["n2"] + d[2] * three) / total if of1["n"] else 1.0
    return model


def score_texts(model: Model, texts: list[list[bytes]]) -> dict[str, np.ndarray]:
    """Per text: n_tokens, n_known, base_score (add-one unigram) and score, in log10."""
    size = np.array([len(ws) for ws in texts])
    ids, counts = model.ids_of([w for ws in texts for w in ws])
    left = np.concatenate(([model.n_types], ids[:-1]))
    begin = np.concatenate(([0], np.cumsum(size)[:-1]))
    left[begin] = model.n_types
    pair = (left << 32) ^ ids
    _, first, back = np.unique(pair, return_index=True, return_inverse=True)
    score = np.log10(model.bigram(left[first], ids[first]))[back]
    base = np.log10((counts + 1) / (model.n_tokens + model.n_types + 1))
    return {"n_tokens": size, "n_known": np.add.reduceat((counts > 0).astype(np.int64), begin),
            "base_score": np.add.reduceat(base, begin), "score": np.add.reduceat(score, begin)}


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` columns but the text, with n_tokens, n_known, train_tokens, base_score,
    score (log10 probability of the whole text) and perplexity; columns of those
    names are replaced."""
    made = ("text", "n_tokens", "n_known", "base_score", "score", "train_tokens", "perplexity")
    names = [c for c in docs.columns if c not in made]
    src = docs.select(*[F.col(f"`{c}`") for c in names], F.col("text").cast("binary").alias("text"))
    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in src.schema.fields if f.name in names)
    out = f"{kept}n_tokens bigint, n_known bigint, base_score double, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, "text", BATCH_BYTES):
            texts = [words_of(x.as_buffer().to_pybytes() if x.is_valid else None) for x in b.column("text")]
            got = score_texts(model, texts)
            cols = [b.column(c) for c in names] + [pa.array(v) for v in got.values()]
            yield pa.RecordBatch.from_arrays(cols, names=[*names, *got])

    return (src.mapInArrow(run, out).withColumn("train_tokens", F.lit(model.n_tokens).cast("bigint"))
            .withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens"))))
