"""Sequence-matcher ratio of two strings as a column expression.

The ratio is 2 M / (length of both), M the characters in matching blocks: the longest
common block of the two strings (of several, that which begins first in the left, then
in the right string), and recursively the blocks left and right of it. The recursion is a stack of
ranges in a fold; a block is found by dynamic programming over one row of common-suffix
lengths. In a right string of 200 characters or more, characters that make up over one
per cent (and one more) do not begin a block; found blocks extend over them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagelab.functions.url import bind

# ---------------------------------------------------------------------------
# Fixed values
# ---------------------------------------------------------------------------
POPULAR_FROM = 200  # length of the right string from which popular characters are left out
POPULAR_SHARE = 100  # popular: more often than length / 100 + 1
# ---------------------------------------------------------------------------

_RANGE = "struct<alo:int,ahi:int,blo:int,bhi:int>"


def _range(alo, ahi, blo, bhi) -> Column:
    return F.struct(alo.alias("alo"), ahi.alias("ahi"), blo.alias("blo"), bhi.alias("bhi"))


def _steps(n: Column) -> Column:
    return F.when(n >= 1, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))


def _longest(a, b, begins, r) -> Column:
    """struct(i, j, k): the first longest common block inside ranges ``r`` (positions from 0)."""
    right = F.slice(begins, r["blo"] + 1, r["bhi"] - r["blo"])

    def row(acc, c, at):
        lens = F.transform(right, lambda x, j: F.when(x == c, F.coalesce(F.get(acc["row"], j - 1), F.lit(0)) + 1).otherwise(F.lit(0)))
        return bind(lens, lambda v: bind(F.array_max(v), lambda m: F.when(m > acc["k"], F.struct(
            (at - m + 1).alias("i"), (r["blo"] + F.array_position(v, m).cast("int") - m).alias("j"), m.alias("k"), v.alias("row")
        )).otherwise(F.struct(acc["i"].alias("i"), acc["j"].alias("j"), acc["k"].alias("k"), v.alias("row")))))

    left = F.transform(F.slice(a, r["alo"] + 1, r["ahi"] - r["alo"]), lambda c, p: F.struct(c.alias("c"), (r["alo"] + p).alias("at")))
    none = F.struct(r["alo"].alias("i"), r["blo"].alias("j"), F.lit(0).alias("k"), F.array().cast("array<int>").alias("row"))
    return F.aggregate(left, none, lambda acc, x: row(acc, x["c"], x["at"]))


def _extended(a, b, r, f) -> Column:
    """The block ``f`` extended over equal neighbours inside the ranges."""
    def run(n, i_of, j_of):
        return F.aggregate(_steps(n), F.lit(0), lambda acc, s: F.when(
            (acc == s - 1) & (F.get(a, i_of(s)) == F.get(b, j_of(s))), acc + 1).otherwise(acc))
    back = run(F.least(f["i"] - r["alo"], f["j"] - r["blo"]), lambda s: f["i"] - s, lambda s: f["j"] - s)
    on = run(F.least(r["ahi"] - f["i"] - f["k"], r["bhi"] - f["j"] - f["k"]),
             lambda s: f["i"] + f["k"] + s - 1, lambda s: f["j"] + f["k"] + s - 1)
    return bind(back, lambda n: F.struct((f["i"] - n).alias("i"), (f["j"] - n).alias("j"), (f["k"] + n + on).alias("k")))


def _matched(a, b) -> Column:
    """Characters in matching blocks of the character arrays ``a`` and ``b``."""
    def popular(x):
        return F.size(F.filter(b, lambda y: y == x)) > F.floor(F.size(b) / POPULAR_SHARE) + 1

    begins = F.when(F.size(b) >= POPULAR_FROM, F.transform(b, lambda x: F.when(~popular(x), x))).otherwise(b)

    def of(begins):
        def found(r):
            return bind(_longest(a, b, begins, r), lambda f: F.when(F.size(b) >= POPULAR_FROM, _extended(a, b, r, f)).otherwise(
                F.struct(f["i"].alias("i"), f["j"].alias("j"), f["k"].alias("k"))))

        def step(acc, _):
            def cut(r):
                def parts(f):
                    sides = F.array(_range(r["alo"], f["i"], r["blo"], f["j"]),
                                    _range(f["i"] + f["k"], r["ahi"], f["j"] + f["k"], r["bhi"]))
                    open_ = F.when(f["k"] > 0, F.filter(sides, lambda s: (s["alo"] < s["ahi"]) & (s["blo"] < s["bhi"]))) \
                        .otherwise(F.array().cast(f"array<{_RANGE}>"))
                    rest = F.slice(acc["open"], 2, F.size(acc["open"]))
                    return F.struct((acc["n"] + f["k"]).alias("n"), F.concat(rest, open_).alias("open"))
                return bind(found(r), parts)
            return F.when(F.size(acc["open"]) == 0, acc).otherwise(bind(F.get(acc["open"], F.lit(0)), cut))

        whole = F.array(_range(F.lit(0), F.size(a), F.lit(0), F.size(b)))
        start = F.struct(F.lit(0).alias("n"), whole.cast(f"array<{_RANGE}>").alias("open"))
        # a block takes a character at least, and leaves two ranges at most
        return F.aggregate(F.sequence(F.lit(0), 2 * F.least(F.size(a), F.size(b))), start, step, lambda acc: acc["n"])
    return bind(begins, of)


def sequence_ratio(left, right) -> Column:
    """Ratio in [0, 1]; 1 for two empty strings, nulls count as empty."""
    def chars(s):
        s = F.coalesce(F.col(s) if isinstance(s, str) else s, F.lit(""))
        return F.filter(F.split(s, ""), lambda c: c != "")

    def of(a, b):
        n = F.size(a) + F.size(b)
        return F.when(n == 0, F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(2.0 * _matched(a, b) / n)
    return bind(chars(left), lambda a: bind(chars(right), lambda b: of(a, b)))


def brand_discrepancy(title, domain) -> Column:
    """C11 by definition: 1 - ratio of cleaned title and alphanumeric domain; 0 when the
    title is empty or, longer than 3, part of the domain."""
    def of(t, d):
        return F.when((t == "") | ((F.length(t) > 3) & d.contains(t)), F.lit(0.0)).otherwise(1 - sequence_ratio(t, d))
    t, d = (F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")) for c in (title, domain))
    return bind(t, lambda t: bind(d, lambda d: of(t, d)))
