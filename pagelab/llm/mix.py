"""Mixing sources to target weights with DataFrame operations only.

1. Each source's documents stand in hash order, which is a random permutation.
   Running word sums over (source, hash range) cut that order into blocks of
   ``block_words`` words.
2. Targets: every source asks for its weight of the words to mix; a source
   stops at ``max_epochs`` times its size and the excess goes to the others by
   weight. A target becomes an exact quota of blocks: whole passes over all
   blocks, then a part of one more pass whose last block ends at the document
   nearest to the target.
3. Splitting tree: the quotas of all sources are split between the two halves
   of the output shards by a multivariate hypergeometric draw, and again for
   each half, until every node is a shard. Quotas stay exact at every level.
4. A shard owns a range of each source's draw positions, so shards draw
   disjoint blocks; positions are permuted within a pass. Inside a shard a
   hash orders the documents (``order_key``).

Only (doc_id, source, size, hash) move until the rows come out. All randomness
is hashing with ``seed``, so reruns and retried tasks agree. The tree and the
targets are tables with one row per node and per source.

Defined cases: a null text has size 0; null is a source of its own and sorts
last; empty documents are taken with their block but add no words; repeated
rows are documents of their own; with no words at all every target is 0.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelab.llm.common import SPACE_WORD, checkpointed, fresh_name

#: Primes below 2^31: multipliers of the permutations of draw positions.
PRIMES = [2147483647, 2147483629, 2147483587, 2147483579, 2147483563, 2147483549]


def sizes(docs: DataFrame, seed: int = 7) -> DataFrame:
    """(doc_id, source, size, h, h2): words of the text, the permuting hash, and a
    second one that names the row together with it."""
    words = F.coalesce(F.regexp_count(F.col("text"), F.lit(SPACE_WORD)), F.lit(0)).cast("bigint")
    return docs.select("doc_id", "source", words.alias("size"), _hash(seed).alias("h"), _hash(seed + 9).alias("h2"))


def _hash(seed: int) -> Column:
    # nulls leave a hash as it is, so each column stands with its null flag
    return F.xxhash64(F.lit(seed), *[x for c in ("doc_id", "source", "text") for x in (F.col(c).isNull(), F.col(c))])


def targets(per_source: DataFrame, weights: tuple[int, ...], share: float, max_epochs: float) -> DataFrame:
    """(idx, source, source_size, weight, target) from (source, source_size).

    Sources in order of their limit per weight: those before the level fill up
    to the limit, the others get the level times their weight."""
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.col("idx") % len(weights) + 1)
    named = per_source.select(
        (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1).alias("idx"),
        "source", "source_size").withColumn("weight", w)
    limit = F.col("source_size") * F.lit(float(max_epochs))
    by = Window.orderBy("ratio", "idx")
    rest = by.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    level = ((F.sum("source_size").over(everything) * F.lit(float(share))
              - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
    out = (named.withColumn("limit", limit).withColumn("ratio", F.col("limit") / F.col("weight"))
           .withColumn("level", level)
           .withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"),
                                             F.struct("ratio", "idx", "level"))).over(everything)["level"]))
    target = F.least("limit", F.coalesce(F.col("level") * F.col("weight"), F.col("limit")))
    return out.select("idx", "source", "source_size", "weight", target.alias("target"))


# -- splitting tree ------------------------------------------------------------
def _log_gamma(x: str) -> str:
    """ln Gamma(x) for x >= 1, shifted by 8 and by Stirling's series."""
    y = f"({x} + 8D)"
    low = " + ".join(f"ln({x} + {i}D)" for i in range(8))
    return (f"(({y} - 0.5D) * ln({y}) - {y} + {0.5 * math.log(2 * math.pi)!r}D + 1D/(12D*{y})"
            f" - 1D/(360D*{y}*{y}*{y}) + 1D/(1260D*pow({y}, 5)) - ({low}))")


def _log_choose(n: str, k: str) -> str:
    return f"({_log_gamma(f'({n} + 1D)')} - {_log_gamma(f'({k} + 1D)')} - {_log_gamma(f'({n} - {k} + 1D)')})"


def hypergeometric(total: str, good: str, draws: str, uniform: str) -> str:
    """SQL for a draw: how many of ``good`` among ``total`` are in ``draws``.

    Inversion that starts at the mode and walks outwards on both sides; twelve
    standard deviations hold everything a 53-bit uniform can reach."""
    bound = (f"transform(array(named_struct('tot', cast({total} as double), 'good', cast({good} as double),"
             f" 'take', cast({draws} as double), 'u', {uniform})), q -> named_struct('tot', q.tot, 'good', q.good, 'take', q.take,"
             " 'u', q.u, 'm', floor((q.take + 1D) * (q.good + 1D) / (q.tot + 2D)),"
             " 'w', cast(ceil(12D * sqrt(q.take * (q.good / greatest(q.tot, 1D)) * (1D - q.good / greatest(q.tot, 1D)))) + 20 as int)))")
    p0 = f"exp({_log_choose('s.good', 's.m')} + {_log_choose('(s.tot - s.good)', '(s.take - s.m)')} - {_log_choose('s.tot', 's.take')})"
    start = (f"transform({bound}, s -> named_struct('s', s, 'p', {p0}))")
    walk = ("""aggregate(sequence(1, t.s.w),
      named_struct('u', t.s.u - t.p, 'hi', cast(t.s.m as double), 'lo', cast(t.s.m as double), 'ph', t.p, 'pl', t.p,
                   'x', if(t.s.u < t.p, cast(t.s.m as double), -1D)),
      (a, i) -> transform(array(named_struct(
          'ph', a.ph * (t.s.good - a.hi) * (t.s.take - a.hi) / ((a.hi + 1D) * (t.s.tot - t.s.good - t.s.take + a.hi + 1D)),
          'pl', if(a.lo <= 0D, 0D, a.pl * a.lo * (t.s.tot - t.s.good - t.s.take + a.lo) / ((t.s.good - a.lo + 1D) * (t.s.take - a.lo + 1D))))),
        b -> named_struct('u', a.u - b.ph - b.pl, 'hi', a.hi + 1D, 'lo', a.lo - 1D, 'ph', b.ph, 'pl', b.pl,
             'x', case when a.x >= 0D then a.x when a.u < b.ph then a.hi + 1D
                       when a.u < b.ph + b.pl then a.lo - 1D else -1D end))[0],
      a -> cast(if(a.x >= 0D, a.x, cast(t.s.m as double)) as bigint))""")
    return f"transform({start}, t -> {walk})[0]"


def split_tree(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """(idx, shard, n): the exact quota of every source in every shard, from (idx, quota).

    One row per tree node; ``shards`` is a power of two."""
    if shards < 1 or shards & (shards - 1):
        raise ValueError("shards is a power of two")
    node = quotas.agg(F.array_sort(F.collect_list(F.struct("idx", F.col("quota").alias("n")))).alias("q"))
    node = node.select(F.lit(0).cast("bigint").alias("node"), "q")
    for depth in range(int(math.log2(shards))):
        uniform = (f"shiftrightunsigned(xxhash64({seed}, 'split', {depth}, node, e.idx), 11) / {float(1 << 53)!r}D")
        draw = hypergeometric("a.tot", "e.n", "a.take", uniform)
        left = (f"""aggregate(q, named_struct('tot', aggregate(q, 0L, (t, e) -> t + e.n),
                 'take', aggregate(q, 0L, (t, e) -> t + e.n) div 2,
                 'out', cast(array() as array<bigint>)),
               (a, e) -> transform(array({draw}), x -> named_struct(
                  'tot', a.tot - e.n, 'take', a.take - x, 'out', concat(a.out, array(x))))[0],
               a -> a.out)""")
        halves = node.withColumn("l", F.expr(left))
        sides = F.expr("""array(
            named_struct('node', node * 2, 'q', transform(q, (e, i) -> named_struct('idx', e.idx, 'n', l[i]))),
            named_struct('node', node * 2 + 1, 'q', transform(q, (e, i) -> named_struct('idx', e.idx, 'n', e.n - l[i]))))""")
        node = checkpointed(halves.select(F.explode(sides).alias("s")).select("s.node", "s.q"))
    return node.select(F.col("node").alias("shard"), F.explode("q").alias("e")).select("e.idx", "shard", "e.n")


def _count_upto(ends: Column, pos: Column) -> Column:
    """Number of shards whose range ends at or before ``pos``."""
    return F.size(F.filter(ends, lambda x: x <= pos))


def plan(docs: DataFrame, *, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5,
         max_epochs: int = 2, block_words: int = 8192, shards: int = 16, seed: int = 7,
         rows_per_range: int = 20_000, max_broadcast: int = 100_000) -> DataFrame:
    """(doc_id, source, size, h, h2, source_size, target, copies): for each row the
    passes that take it, as an array of (epoch, shard)."""
    thin = checkpointed(sizes(docs, seed))
    n = thin.count()
    bits = max(0, math.ceil(math.log2(max(1, n / rows_per_range))))
    # hash ranges: the top bits of the hash, moved to 0 .. 2^bits - 1
    top = F.shiftrightunsigned("h", 64 - bits) if bits else F.lit(0).cast("bigint")
    thin = thin.withColumn("range", top)
    ranges = thin.groupBy("source", "range").agg(F.sum("size").alias("words"))
    order = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.withColumn("offset", F.coalesce(F.sum("words").over(order), F.lit(0)))
    per_source = ranges.groupBy("source").agg(F.sum("words").alias("source_size"))
    goal = checkpointed(targets(per_source, weights, share, max_epochs))

    size, target = F.col("source_size"), F.col("target")
    full = F.when(size > 0, F.floor(target / size)).otherwise(0).cast("int")
    goal = (goal.withColumn("full", full).withColumn("rest", target - F.col("full") * size)
            .withColumn("blocks", F.ceil(size / F.lit(block_words)))
            .withColumn("part", F.ceil(F.col("rest") / F.lit(block_words)))
            .withColumn("quota", F.col("full") * F.col("blocks") + F.col("part")))
    dealt = split_tree(goal, shards, seed)
    ends = F.sum("n").over(Window.partitionBy("idx").orderBy("shard"))
    ends = (dealt.withColumn("end", ends).groupBy("idx")
            .agg(F.array_sort(F.collect_list("end")).alias("ends")))
    per = checkpointed(goal.join(ends, "idx"))
    n_sources = per.count()
    side = F.broadcast if n_sources * shards <= max_broadcast else (lambda d: d)

    run = Window.partitionBy("source", "range").orderBy("h", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = thin.withColumn("run", F.sum("size").over(run))
    off = offsets.select(F.col("source").alias("s2"), F.col("range").alias("r2"), "offset")
    small = n_sources << bits <= max_broadcast
    off = F.broadcast(off) if small else off
    placed = within.join(off, F.col("source").eqNullSafe(F.col("s2")) & (F.col("range") == F.col("r2")))
    placed = placed.select("doc_id", "source", "size", "h", "h2",
                           (F.col("offset") + F.col("run") - F.col("size")).alias("before"))
    rows = placed.join(side(per.withColumnRenamed("source", "s3")), F.col("source").eqNullSafe(F.col("s3")))
    block = F.floor(F.col("before") / F.lit(block_words))
    in_part = (F.col("before") < F.col("rest")) & (F.col("before") + F.col("size") / 2 <= F.col("rest"))
    copies = []
    for e in range(max_epochs):
        whole = F.lit(e) < F.col("full")
        span = F.when(whole, F.col("blocks")).otherwise(F.col("part"))
        prime = F.element_at(F.array(*[F.lit(p) for p in PRIMES]),
                             (F.pmod(F.xxhash64(F.lit(seed), F.lit(e), F.col("idx")), F.lit(len(PRIMES))) + 1).cast("int"))
        shift = F.pmod(F.xxhash64(F.lit(seed + 1), F.lit(e), F.col("idx")), F.greatest(span, F.lit(1)))
        pos = F.lit(e) * F.col("blocks") + F.pmod(block * prime + shift, F.greatest(span, F.lit(1)))
        shard = _count_upto(F.col("ends"), pos)
        taken = whole | ((F.lit(e) == F.col("full")) & in_part)
        # a last block may begin past the words of an all-empty tail: it stays inside the pass
        copies.append(F.when(taken, F.struct(F.lit(e).alias("epoch"), F.least(shard, F.lit(shards - 1)).alias("shard"))))
    return rows.select("doc_id", "source", "size", "h", "h2", "source_size", "target",
                       F.filter(F.array(*copies), lambda c: c.isNotNull()).alias("copies"))


def mix(docs: DataFrame, *, seed: int = 7, **options) -> DataFrame:
    """The mixed rows: ``docs`` columns with shard, order_key, epoch; a document
    appears once for each pass that takes it. Texts move once, in one join."""
    names = docs.columns
    h, h2, ka, kb, copies, at, one = (fresh_name(names, x) for x in (
        "_mix_a", "_mix_b", "_take_a", "_take_b", "_copies", "_copy_no", "_copy"))
    take = (plan(docs, seed=seed, **options).where(F.size("copies") > 0)
            .groupBy("h", "h2").agg(F.flatten(F.collect_list("copies")).alias(copies))
            .select(F.col("h").alias(ka), F.col("h2").alias(kb), copies))
    met = docs.withColumns({h: _hash(seed), h2: _hash(seed + 9)}).join(
        take, (F.col(h) == F.col(ka)) & (F.col(h2) == F.col(kb)))
    # repeated rows share one list of copies: one row, then as many as the list says
    out = (met.dropDuplicates([h, h2])
           .select(*[F.col(f"`{c}`") for c in names], h, F.posexplode(copies).alias(at, one)))
    extra = {"shard": F.col(f"{one}.shard"), "epoch": F.col(f"{one}.epoch"),
             "order_key": F.xxhash64(F.lit(seed + 2), h, at)}
    return out.select(*[F.col(f"`{c}`") for c in names],
                      *[c.alias(fresh_name(names, k)) for k, c in extra.items()])


def write_shards(mixed: DataFrame, path: str) -> None:
    """One folder per shard, rows in the shard's shuffled order."""
    (mixed.repartition("shard").sortWithinPartitions("shard", "order_key")
     .write.partitionBy("shard").parquet(path))
