"""SimHash near-duplicates.

A document's 64-bit fingerprint is the bitwise majority over the XXH64 of its
shingles. Documents link when fingerprints differ in at most ``max_bits`` bits.

1. Fingerprints are computed over whole texts in Arrow batches, then equal
   fingerprints are merged by one pre-aggregated shuffle, so a group of copies
   is one row from here on.
2. Pigeonhole: the 64 bits are cut in ``max_bits + 2`` blocks; two linked
   fingerprints agree on two blocks at least, so they meet under one of the
   block pairs (15 keys of 21 or 22 bits for 4 bits).
3. Keys held by one fingerprint are dropped. Members of a key are compared
   inside ordered Arrow streams; a key with more than ``chunk`` members is
   dealt into pairs of chunks first, so no task holds more than two chunks.
   From each, its connected parts go on as stars, never all pairs.
4. Components over the forest give each document its class.

Defined cases: null and empty texts have fingerprint 0 and link like any
other; fewer words than a shingle make one shingle; ties at exactly half set
no bit; a null doc_id takes part but is never a component's smallest id unless
it is alone there; repeated rows stay repeated; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelab.llm.common import checkpointed, fresh_name
from pagelab.llm.components import components

SEED = 42


def fingerprint(raw: bytes | None, width: int = 4) -> int:
    """Fingerprint of one text (UTF-8). A-Z fold; words end at ASCII white space."""
    words = raw.lower().split() if raw else []
    if not words:
        return 0
    line = b" ".join(words)
    n = len(words) - width + 1
    if n <= 1:
        return xxhash.xxh64_intdigest(line, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begin = np.concatenate(([0], ends[:n - 1] + 1)).tolist()
    stop = ends[width - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(line[a:b], SEED) for a, b in zip(begin, stop)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):  # bounded memory for very long texts
        bits = np.unpackbits(h[at:at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    out = 0
    for b in (2 * ones > n).tolist():
        out = out << 1 | b
    return out


def fingerprint_column(text: Column, width: int = 4) -> Column:
    """Signed 64-bit fingerprint of a string column; any text, null included."""
    @F.arrow_udf("bigint")
    def of(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            yield pa.array(np.array([fingerprint(x.as_buffer().to_pybytes() if x.is_valid else None, width)
                                     for x in part], np.uint64).astype(np.int64))
    return of(text.cast("binary"))


def fingerprints(docs: DataFrame, width: int = 4, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns with ``fp``."""
    return docs.select(*[F.col(f"`{c}`") for c in keep], fingerprint_column(F.col("text"), width).alias("fp"))


def block_masks(max_bits: int) -> list[int]:
    """Masks of the block pairs: every two of ``max_bits + 2`` even blocks."""
    n = max_bits + 2
    cuts = [64 * i // n for i in range(n + 1)]
    one = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]
    return [a | b for a, b in combinations(one, 2)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _forest(fps: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """The links among ``fps`` as stars: (centre, member) of every connected part.
    Each step compares one reached value with all values not yet reached."""
    out, left = [], np.arange(len(fps))
    while len(left):
        part, left = [int(left[0])], left[1:]
        at = 0
        while at < len(part) and len(left):
            near = np.bitwise_count(fps[left] ^ fps[part[at]]) <= max_bits
            at += 1
            if near.any():
                part += left[near].tolist()
                left = left[~near]
        if len(part) > 1:
            centre = min(part, key=lambda i: int(fps[i].astype(np.int64)))
            out += [(centre, b) for b in part if b != centre]
    return out


def _links(batches: Iterator[pa.RecordBatch], max_bits: int) -> Iterator[pa.RecordBatch]:
    """Rows (k1, k2, i, j, fp) ordered by group (k1..j) -> spanning links of each group."""
    held: pa.Table | None = None

    def solve(t: pa.Table) -> pa.RecordBatch | None:
        fp = t["fp"].to_numpy().astype(np.uint64)
        key = [t[c].to_numpy() for c in ("mask", "key", "i", "j")]
        new = np.ones(len(fp), bool)
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in key])
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(fp)))
        a, b = [], []
        two = start[size == 2]
        if len(two):
            near = np.bitwise_count(fp[two] ^ fp[two + 1]) <= max_bits
            a.append(fp[two][near])
            b.append(fp[two + 1][near])
        for s, n in zip(start[size > 2].tolist(), size[size > 2].tolist()):
            got = _forest(fp[s:s + n], max_bits)
            if got:
                ij = np.array(got) + s
                a.append(fp[ij[:, 0]])
                b.append(fp[ij[:, 1]])
        if not a:
            return None
        u, v = np.concatenate(a).astype(np.int64), np.concatenate(b).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    for batch in batches:
        t = pa.Table.from_batches([batch])
        held = t if held is None else pa.concat_tables([held, t])
        if not len(held):
            continue
        last = [held[c][len(held) - 1].as_py() for c in ("mask", "key", "i", "j")]
        whole = np.zeros(len(held), bool)
        for c, x in zip(("mask", "key", "i", "j"), last):
            whole |= held[c].to_numpy() != x
        n = int(whole.sum())  # rows of groups that have ended (the order makes them a prefix)
        if n:
            out = solve(held.slice(0, n))
            held = held.slice(n)
            if out is not None:
                yield out
    if held is not None and len(held):
        out = solve(held)
        if out is not None:
            yield out


def links(fps: DataFrame, max_bits: int = 4, chunk: int = 4096) -> DataFrame:
    """(u, v): pairs of distinct fingerprints (column ``fp``) that connect what
    any chain of pairs within ``max_bits`` bits connects."""
    masks = [_signed(m) for m in block_masks(max_bits)]
    keyed = (fps.select("fp", F.posexplode(F.array(*[F.lit(m) for m in masks])).alias("mask", "m"))
             .select("fp", "mask", F.col("fp").bitwiseAND(F.col("m")).alias("key")))
    sizes = (keyed.groupBy("mask", "key").agg(F.count("*").alias("n")).where("n > 1")
             .select(F.col("mask").alias("m2"), F.col("key").alias("k2"),
                     F.ceil(F.col("n") / chunk).cast("int").alias("g")))
    met = keyed.join(sizes, (F.col("mask") == F.col("m2")) & (F.col("key") == F.col("k2")))
    mine = F.pmod(F.xxhash64("fp"), F.col("g")).cast("int")
    pairs = (met.withColumn("c", mine)
             .select("mask", "key", "fp", "c", F.explode(F.sequence(F.lit(0), F.col("g") - 1)).alias("o"))
             .select("mask", "key", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), "fp"))
    group = ["mask", "key", "i", "j"]
    ordered = pairs.repartition(*group).sortWithinPartitions(*group)
    return ordered.mapInArrow(lambda it: _links(it, max_bits), "u bigint, v bigint")


def classes(fp_rows: DataFrame, id_col: str, max_bits: int = 4, chunk: int = 4096) -> DataFrame:
    """(fp, component, n_docs): each distinct fingerprint of ``fp_rows`` with the
    smallest ``id_col`` of its class. ``fp_rows`` should be checkpointed."""
    distinct = checkpointed(fp_rows.groupBy("fp").agg(F.min(id_col).alias("first"),
                                                     F.count("*").alias("n_docs")))
    found = components(links(distinct.select("fp"), max_bits, chunk))
    tagged = (distinct.join(found, distinct["fp"] == found["node"], "left")
              .select("fp", "first", "n_docs", F.coalesce("component", "fp").alias("root")))
    lowest = tagged.groupBy("root").agg(F.min("first").alias("component"),
                                        F.sum("n_docs").alias("class_size"))
    return (tagged.join(lowest, "root")
            .select("fp", "component", "n_docs", "class_size"))


def near_duplicates(docs: DataFrame, width: int = 4, max_bits: int = 4) -> DataFrame:
    """(doc_id, fp, component, class_size) for every row of ``docs``."""
    rows = checkpointed(fingerprints(docs, width))
    found = classes(rows, "doc_id", max_bits)
    return (rows.join(found.withColumnRenamed("fp", "fp2"), F.col("fp") == F.col("fp2"))
            .select("doc_id", "fp", "component", "class_size"))


def keep_one(docs: DataFrame, width: int = 4, max_bits: int = 4) -> DataFrame:
    """One row of each class: the smallest doc_id (then the smallest text hash),
    with the columns ``docs`` came with. Order: null ids come last.

    Only ids, hashes and fingerprints take part in the search; the texts move
    once, in the join that keeps the chosen rows by a 128-bit hash of id and text."""
    names = docs.columns
    no, ident, text = F.col("doc_id").isNull(), F.col("doc_id"), F.col("text")
    one, two = (F.xxhash64(F.lit(seed), no, ident, text.isNull(), text) for seed in (1, 2))
    thin = checkpointed(docs.select(F.struct(no.alias("no"), ident.alias("id"), one.alias("a"), two.alias("b")).alias("who"),
                                    fingerprint_column(text, width).alias("fp")))
    a, b, ka, kb = (fresh_name(names, x) for x in ("_hash_a", "_hash_b", "_keep_a", "_keep_b"))
    keep = classes(thin, "who", max_bits).select(F.col("component.a").alias(ka), F.col("component.b").alias(kb)).distinct()
    left = docs.withColumns({a: one, b: two})
    out = left.join(keep, (F.col(a) == F.col(ka)) & (F.col(b) == F.col(kb)), "left_semi")
    # repeated rows meet in the join's partitions already: one of each stays
    return out.dropDuplicates([a, b]).select(*[F.col(f"`{c}`") for c in names])
