"""Byte-level BPE encoding and decoding by a file of ranks.

A text is cut by the tokenizer's pattern. A piece that is a token stands for
itself; the bytes of any other piece are merged: always the adjacent pair whose
joined bytes have the lowest rank, the leftmost on a tie, until no pair is a
token. Distinct pieces are solved once and remembered (a bounded number of them).

Pieces to merge are dealt into buckets by length and stand as rows of a padded
matrix of token ids, beside a matrix of their pairs' ranks. In each round every
row merges its leftmost pair of least rank: the row closes up behind the merged
token, its two new pairs are looked up in a hash table of (left id, right id),
rows without a pair leave the matrix, and columns that no row needs go with them.
A row costs its length times its merges; pieces of over ``MATRIX_BYTES`` bytes
(a long run of letters or signs) follow the same rule with a heap instead, in
n log n steps, so that one endless word does not take quadratic time.

Decoding joins the bytes of the tokens.

Defined cases: null and empty texts have no ids and decode to no bytes (null ids
to null); bytes that are not UTF-8 are read as U+FFFD, as the library does with
characters that cannot be encoded; repeated rows are encoded alike; other columns
pass through, a column of the output's name is replaced; empty tables stay empty.
"""

from __future__ import annotations

import base64
import heapq
import uuid
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, count, islice, repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelab.llm.common import small_arrays

NO_PAIR = np.int32(2**31 - 1)  # a rank above all
PAD = -1
MATRIX_BYTES = 256
MATRIX_CELLS = 1 << 18  # of one matrix
TEXT_BYTES = 1 << 20  # encoded at a time
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
_FREE = np.uint64(2**64 - 1)


@dataclass(frozen=True)
class Ranks:
    """Token bytes by id (the id is the rank) and the pattern that cuts texts."""
    tokens: dict[int, bytes]
    pattern: str


def load(path: str, pattern: str, max_tokens: int = 2_000_000) -> Ranks:
    """Ranks of a file with a base64 token and its rank on each line; ``max_tokens`` bounds what is broadcast."""
    with open(path, "rb") as f:
        tokens = {int(rank): base64.b64decode(token) for token, rank in (line.split() for line in f if line.strip())}
    if len(tokens) > max_tokens:
        raise ValueError(f"{len(tokens)} tokens, over max_tokens")
    return Ranks(tokens, pattern)


class PairTable:
    """Rank of a pair of ids: open addressing in flat arrays, many pairs a call."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray):
        bits = max(4, int(4 * max(1, len(rank)) - 1).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys = np.full(1 << bits, _FREE, np.uint64)
        self.ranks = np.full(1 << bits, NO_PAIR, np.int32)
        key = self._key(left, right)
        slot = self._slot(key)
        while len(key):
            free = self.keys[slot] == _FREE
            self.keys[slot[free]] = key[free]  # of several keys one stays
            mine = self.keys[slot] == key
            self.ranks[slot[mine]] = rank[mine]
            key, rank, slot = key[~mine], rank[~mine], (slot[~mine] + 1) & self.mask

    @staticmethod
    def _key(left, right):
        return (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)

    def _slot(self, key):
        return ((key * _MULTIPLY) >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids; ``NO_PAIR`` where they make no token."""
        key = self._key(left, right)
        slot = self._slot(key)
        out = np.full(len(key), NO_PAIR, np.int32)
        at = np.arange(len(key))
        while len(at):
            there = self.keys[slot]
            hit = there == key
            out[at[hit]] = self.ranks[slot[hit]]
            on = ~hit & (there != _FREE)
            at, key, slot = at[on], key[on], (slot[on] + 1) & self.mask
        return out


class Encoder:
    """Encodes under one file of ranks; about ``hold`` pieces stay known."""

    def __init__(self, ranks: Ranks, hold: int = 250_000):
        self.cut = regex.compile(ranks.pattern).findall
        self.tokens, self.ids = ranks.tokens, {token: i for i, token in ranks.tokens.items()}
        missing = [b for b in range(256) if bytes([b]) not in self.ids]
        if missing:
            raise ValueError(f"{len(missing)} single bytes are no tokens")
        self.byte_id = np.array([self.ids[bytes([b])] for b in range(256)], np.int32)
        known = [(self.ids[t[:k]], self.ids[t[k:]], i) for t, i in self.ids.items()
                 for k in range(1, len(t)) if t[:k] in self.ids and t[k:] in self.ids]
        self.pairs = PairTable(*np.array(known or np.zeros((0, 3)), np.int64).reshape(-1, 3).T)
        self.hold = hold
        self._forget()

    # -- merging -----------------------------------------------------------------
    def _forget(self) -> None:
        self.place: dict[str, int] = defaultdict(count().__next__)  # numbers pieces as they come
        self.flat, self.start, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces one after the other, number of ids of each)."""
        n = len(pieces)
        whole = np.fromiter(map(self.ids.get, pieces, repeat(PAD)), np.int32, n)
        length = np.fromiter(map(len, pieces), np.int64, n)
        done = np.flatnonzero(whole >= 0)
        parts = [(done, whole[done], np.ones(len(done), np.int64))]
        for k in np.flatnonzero((whole < 0) & (length > MATRIX_BYTES)).tolist():
            ids = self._by_heap(pieces[k])
            parts.append((np.array([k]), ids, np.array([len(ids)])))
        rest = np.flatnonzero((whole < 0) & (length > 0) & (length <= MATRIX_BYTES))
        rest = rest[np.argsort(length[rest], kind="stable")]
        width = np.array([4, 6, 8, 12, 16, 24, 32, 64, 128, MATRIX_BYTES])  # of the buckets
        for part in np.split(rest, np.searchsorted(length[rest], width[:-1], side="right")):
            rows = max(1, MATRIX_CELLS // max(1, int(length[part].max(initial=0))))
            for at in range(0, len(part), rows):
                some = part[at:at + rows]
                parts.append((some, *self._by_matrix([pieces[k] for k in some.tolist()], length[some])))
        sizes = np.zeros(n, np.int64)
        for k, _, size in parts:
            sizes[k] = size
        start, flat = np.cumsum(sizes) - sizes, np.zeros(int(sizes.sum()), np.int32)
        for k, ids, size in parts:
            flat[_spread(start[k], size)] = ids
        return flat, sizes

    def _by_matrix(self, pieces: list[bytes], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes, width = sizes.copy(), int(sizes.max())
        inside = np.arange(width) < sizes[:, None]
        ids = np.full(inside.shape, PAD, np.int32)
        ids[inside] = self.byte_id[np.frombuffer(b"".join(pieces), np.uint8)]
        ranks = np.full(inside.shape, NO_PAIR, np.int32)  # of the pair that begins here
        r, c = np.nonzero(inside[:, 1:])
        ranks[r, c] = self.pairs.find(ids[r, c], ids[r, c + 1])
        row, done = np.arange(len(pieces)), np.full(inside.shape, PAD, np.int32)
        while len(row):
            at = ranks.argmin(axis=1)
            line = np.arange(len(row))
            best = ranks[line, at]
            stop = best == NO_PAIR
            if stop.any():  # compaction: finished rows and unused columns go
                done[row[stop], :ids.shape[1]] = ids[stop]
                go = ~stop
                row, sizes, at, best = row[go], sizes[go], at[go], best[go]
                if not len(row):
                    break
                wide = int(sizes.max())
                ids, ranks, line = ids[go, :wide], ranks[go, :wide], np.arange(len(row))
            width = ids.shape[1]
            ids[line, at] = best  # the merged token's id is its rank
            column = np.arange(width - 1)
            behind = column >= at[:, None]  # the pair's right half and what follows moves up
            ranks[:, :-1] = np.where(behind, ranks[:, 1:], ranks[:, :-1])
            ranks[:, -1] = NO_PAIR
            behind[line, at] = False  # the merged token stays
            ids[:, :-1] = np.where(behind, ids[:, 1:], ids[:, :-1])
            ids[:, -1] = PAD
            sizes -= 1
            for left in (at - 1, at):  # the two pairs that the merged token makes
                real = (left >= 0) & (left + 1 < sizes)
                k, a = line[real], left[real]
                ranks[k, a] = self.pairs.find(ids[k, a], ids[k, a + 1])
            lost = at + 1 >= sizes
            ranks[line[lost], at[lost]] = NO_PAIR
        real = done != PAD
        return done[real], real.sum(axis=1)

    def _by_heap(self, piece: bytes) -> np.ndarray:
        """The same merges with a heap of (rank, place) and links to the neighbours."""
        ids = self.byte_id[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)

        def rank_of(pair):
            both = self.tokens[pair[0]] + self.tokens[pair[1]]
            return self.ids.get(both)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := rank_of((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or rank_of((ids[i], ids[j])) != rank:
                continue  # the pair is no more
            ids[i], ids[j], after[i] = rank, PAD, after[j]
            if after[i] < n:
                before[after[i]] = i
            for a in (before[i], i):
                if a >= 0 and after[a] < n and (r := rank_of((ids[a], ids[after[a]]))) is not None:
                    heapq.heappush(heap, (r, a))
        return np.array([i for i in ids if i >= 0], np.int32)

    # -- texts -------------------------------------------------------------------
    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, number of ids of each)."""
        if len(self.place) > self.hold or len(self.flat) > 16 * self.hold:
            self._forget()
        cut = [self.cut(t) for t in texts]
        lengths = np.fromiter(map(len, cut), np.int64, len(cut))
        piece = np.fromiter(map(self.place.__getitem__, chain.from_iterable(cut)), np.int64, int(lengths.sum()))
        new = list(islice(reversed(self.place), len(self.place) - len(self.size)))[::-1]
        if new:
            flat, size = self.merge([p.encode("utf-8", "replace") for p in new])
            self.start = np.concatenate((self.start, len(self.flat) + np.cumsum(size) - size))
            self.flat, self.size = np.concatenate((self.flat, flat)), np.concatenate((self.size, size))
        size = self.size[piece]
        ends = np.concatenate(([0], np.cumsum(size)))
        per = np.diff(ends[np.concatenate(([0], np.cumsum(lengths)))])
        return self.flat[_spread(self.start[piece], size)], per


def decode(tokens: dict[int, bytes], ids: np.ndarray, per: np.ndarray) -> list[bytes]:
    """Bytes of each stretch of ids; an id that is no token raises ValueError."""
    try:
        found = list(map(tokens.__getitem__, ids.tolist()))
    except KeyError as e:
        raise ValueError(f"{e.args[0]} is no token") from None
    ends = np.cumsum(per)
    return [b"".join(found[a:b]) for a, b in zip((ends - per).tolist(), ends.tolist())]


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for size[0] numbers, then start[1], ..."""
    ends = np.cumsum(size)
    return np.repeat(start - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)


_ENCODERS: dict[str, Encoder] = {}  # of this worker, so that pieces stay known between tasks


class Tokenizer:
    """Spark side: broadcast ranks (bounded where they are loaded), columns in, columns out."""

    def __init__(self, docs: DataFrame, ranks: Ranks):
        self.shared, self.key = docs.sparkSession.sparkContext.broadcast(ranks), uuid.uuid4().hex

    def _encoder(self) -> Encoder:
        if self.key not in _ENCODERS:
            _ENCODERS.clear()  # one vocabulary at a time
            _ENCODERS[self.key] = Encoder(self.shared.value)
        return _ENCODERS[self.key]

    def with_ids(self, docs: DataFrame, text: str = "text", out: str = "ids") -> DataFrame:
        """``docs`` with the ids of each whole text."""
        get = self._encoder

        @F.arrow_udf("array<int>")
        def ids_of(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for part in parts:
                for piece in small_arrays(part, TEXT_BYTES):
                    texts = [x.as_buffer().to_pybytes().decode("utf-8", "replace") if x.is_valid else "" for x in piece]
                    ids, per = get().encode(texts)
                    ends = np.concatenate(([0], np.cumsum(per))).astype(np.int32)
                    yield pa.ListArray.from_arrays(pa.array(ends), pa.array(ids, pa.int32()))

        return docs.withColumn(out, ids_of(F.col(f"`{text}`").cast("binary")))

    def with_bytes(self, docs: DataFrame, ids: str = "ids", out: str = "decoded") -> DataFrame:
        """``docs`` with the bytes that the ids stand for."""
        shared = self.shared

        @F.arrow_udf("binary")
        def bytes_of(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
            tokens = shared.value.tokens
            for part in parts:
                for piece in small_arrays(part, TEXT_BYTES):
                    null = piece.is_null().to_numpy(zero_copy_only=False)
                    per = np.where(null, 0, np.diff(piece.offsets.to_numpy()))
                    got = decode(tokens, piece.flatten().to_numpy(zero_copy_only=False), per)
                    yield pa.array(got, pa.binary(), mask=null)

        return docs.withColumn(out, bytes_of(F.col(f"`{ids}`")))
