"""Quality rules as a learned decision list.

Sequential covering: rules for the rejected class are grown one threshold
condition at a time on two thirds of the labelled statistics (FOIL gain),
pruned on the remaining third, and the rows a rule covers are taken out before
the next rule grows. The list is emitted as one ordered Spark conditional
expression over statistic columns, so scoring is a narrow projection.

Statistics are computed from whole texts inside Arrow batches. The fit reads the
texts of at most ``max_fit_rows`` labels (the smallest hashes of doc_id) and learns
from at most as many distinct (statistics, label) rows with their counts, so that a
labelled document that is repeated without end weighs as often and reaches the driver once.

Defined cases: a null text has no words and all statistics are 0; labels that
are null are ignored; rows with contradicting labels all count; with no
labelled row of either class the list is empty and rejects nothing; repeated
documents are scored once each; extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelab.llm.common import fresh_name

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
          "n_distinct_words", "n_lines", "n_upper", "n_letters", "n_digits", "n_marks", "n_bytes"]
STATS_TYPE = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS])

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in "!?;:\"'()[]{}/\\@^_~=+"]] = True
_MIX = np.uint64(0x9E3779B97F4A7C15)


def repeat_words(words: list[bytes], width: int = 5) -> int:
    """Words inside a window of ``width`` words that the text holds twice or more."""
    m = len(words) - width + 1
    if m < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.uint64, len(words))
    if len(number) == len(words):
        return 0
    # pairs are renumbered densely after each step, so window codes are exact
    code = ids
    base = len(number)
    for k in range(1, width):
        joined = code[: len(words) - k] * np.uint64(base) + ids[k:]
        if k == width - 1:
            code = joined
            break
        _, code = np.unique(joined, return_inverse=True)
        code = code.astype(np.uint64)
        if int(code.max()) + 1 == len(code):
            return 0
    order = np.argsort(code, kind="stable")
    same = code[order][1:] == code[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(m, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    hit = np.zeros(len(words), bool)
    for k in range(width):
        hit[k:k + m] |= twice
    return int(hit.sum())


def text_counts(raw: bytes | None) -> tuple[int, ...]:
    """The counts of one text (UTF-8), in the order of ``COUNTS``."""
    if not raw:
        return (0,) * len(COUNTS)
    by = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = raw.split()  # bytes split on exactly space, \t \n \v \f \r
    lines = [x for x in raw.split(b"\n") if x.strip()]
    points = len(raw) - int(by[0x80:0xC0].sum())
    return (len(words), points - int(by[_SPACE].sum()), int(by[_SYMBOL].sum()),
            len(lines) - len(set(lines)), repeat_words(words), len(set(words)), len(lines),
            int(by[65:91].sum()), int(by[65:91].sum() + by[97:123].sum()),
            int(by[48:58].sum()), int(by[_MARK].sum()), len(raw))


def _counts_of(column: pa.Array) -> pa.Array:
    rows = np.array([text_counts(x.as_buffer().to_pybytes() if x.is_valid else None)
                     for x in column], np.int64).reshape(-1, len(COUNTS))
    return pa.StructArray.from_arrays([pa.array(rows[:, i]) for i in range(len(COUNTS))], names=COUNTS)


@F.arrow_udf(STATS_TYPE)
def stats_udf(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for column in parts:
        yield _counts_of(column)


def with_stats(docs: DataFrame, text: str = "text", out: str = "stats") -> DataFrame:
    """``docs`` with a struct column of the counts of each whole text."""
    return docs.withColumn(out, stats_udf(F.col(f"`{text}`").cast("binary")))


def features(s: str) -> dict[str, Column]:
    """Ratios that thresholds apply to, from the struct column ``s``."""
    c = {k: F.col(f"`{s}`.{k}") for k in COUNTS}
    words, size = F.greatest(c["n_words"], F.lit(1)), F.greatest(c["word_chars"], F.lit(1))
    return {
        "words": c["n_words"].cast("double"),
        "mean_word_chars": c["word_chars"] / words,
        "symbol_share": c["n_symbols"] / size,
        "dup_line_share": c["n_dup_lines"] / F.greatest(c["n_lines"], F.lit(1)),
        "repeat_share": c["n_repeat_words"] / words,
        "distinct_share": c["n_distinct_words"] / words,
        "words_per_line": c["n_words"] / F.greatest(c["n_lines"], F.lit(1)),
        "upper_share": c["n_upper"] / F.greatest(c["n_letters"], F.lit(1)),
        "digit_share": c["n_digits"] / size,
        "mark_share": c["n_marks"] / size,
    }


# -- sequential covering -----------------------------------------------------
@dataclass(frozen=True)
class Condition:
    feature: str
    op: str  # "<=" or ">"
    value: float


Rule = tuple[Condition, ...]


def _covers(rule: Rule, names: list[str], x: np.ndarray) -> np.ndarray:
    m = np.ones(len(x), bool)
    for c in rule:
        v = x[:, names.index(c.feature)]
        m &= v <= c.value if c.op == "<=" else v > c.value
    return m


def _best_condition(names, x, y, w, cuts):
    """The condition of largest FOIL gain on the rows (of weights ``w``) still covered."""
    p0, n0 = w[y].sum(), w[~y].sum()
    base = np.log2(p0 / (p0 + n0))
    best = (0.0, None)
    for j, name in enumerate(names):
        if not len(cuts[j]):
            continue
        at = np.searchsorted(cuts[j], x[:, j], side="left")  # v <= cut[k] iff at <= k
        k = len(cuts[j])
        pos = np.cumsum(np.bincount(at[y], w[y], k + 1))[:k]
        neg = np.cumsum(np.bincount(at[~y], w[~y], k + 1))[:k]
        for op, p, n in (("<=", pos, neg), (">", p0 - pos, n0 - neg)):
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(p > 0, p * (np.log2(p / np.maximum(p + n, 1)) - base), -1.0)
            i = int(np.argmax(gain))
            if gain[i] > best[0] + 1e-9:
                best = (float(gain[i]), Condition(name, op, float(cuts[j][i])))
    return best[1]


def _worth(rule, names, x, y, w) -> float:
    m = _covers(rule, names, x)
    p, n = w[m & y].sum(), w[m & ~y].sum()
    return (p - n) / (p + n) if p + n else -1.0


def fit_rules(names: list[str], x: np.ndarray, y: np.ndarray, *, max_rules: int = 32,
              max_conditions: int = 6, cuts_per_feature: int = 200,
              min_precision: float = 0.9, min_covered: int = 4, counts: np.ndarray | None = None) -> list[Rule]:
    """Ordered rules for rows where ``y`` is true; everything else is the default class.

    A rule must keep ``min_precision`` on the rows it covers (grow and prune
    parts together) and cover ``min_covered`` positive rows, else learning ends.
    A row stands for as many as ``counts`` says: one of three or more is divided
    between the two parts, of fewer each is dealt to one of them."""
    rules: list[Rule] = []
    counts = np.ones(len(y), np.int64) if counts is None else np.asarray(counts, np.int64)
    single = np.repeat(np.arange(len(y)), np.where(counts < 3, counts, 0))
    single = single[np.random.default_rng(7).permutation(len(single))]
    many = np.flatnonzero(counts >= 3)
    row = np.concatenate((single, many, many))
    w = np.concatenate((np.ones(len(single)), counts[many] - counts[many] // 3, counts[many] // 3)).astype(float)
    part = np.concatenate((np.arange(len(single)) % 3 == 2, np.zeros(len(many), bool), np.ones(len(many), bool)))  # the prune part
    x, y = x[row], y[row].astype(bool)
    cuts = []
    for j in range(x.shape[1]):
        v = np.unique(x[:, j])
        mid = (v[1:] + v[:-1]) / 2  # thresholds lie midway between values seen
        if len(mid) > cuts_per_feature:
            at = np.quantile(x[:, j], np.linspace(0, 1, cuts_per_feature + 2)[1:-1])
            mid = mid[np.unique(np.minimum(np.searchsorted(v, at), len(mid) - 1))]
        cuts.append(mid)
    left = np.ones(len(y), bool)
    while len(rules) < max_rules:
        grow, prune = left & ~part, left & part
        if w[y & grow].sum() < 2 or not (~y & grow).any():
            break
        rule: Rule = ()
        m = grow.copy()
        while len(rule) < max_conditions and (~y & m).any():
            c = _best_condition(names, x[m], y[m], w[m], cuts)
            if c is None:
                break
            rule += (c,)
            m &= _covers((c,), names, x)
        if not rule:
            break
        best = max(range(1, len(rule) + 1),
                   key=lambda k: (_worth(rule[:k], names, x[prune], y[prune], w[prune]), -k))
        rule = rule[:best]
        m = _covers(rule, names, x) & left
        p, n = w[m & y].sum(), w[m & ~y].sum()
        if p < min_covered or p < min_precision * (p + n):
            break
        rules.append(rule)
        left &= ~m
    return rules


def rule_column(rules: list[Rule], columns: dict[str, Column]) -> Column:
    """1-based number of the first rule that fires, else 0: ordered WHEN branches."""
    out = None
    for i, rule in enumerate(rules, 1):
        test = None
        for c in rule:
            one = columns[c.feature] <= c.value if c.op == "<=" else columns[c.feature] > c.value
            test = one if test is None else test & one
        out = F.when(test, F.lit(i)) if out is None else out.when(test, F.lit(i))
    return F.lit(0) if out is None else out.otherwise(F.lit(0))


def learn(docs: DataFrame, labels: DataFrame, *, max_fit_rows: int = 12_000,
          target: str = "quality", **options) -> list[Rule]:
    """Rules that reject ``target = 0``, from the documents of at most ``max_fit_rows``
    labels (the smallest hashes of doc_id: a fixed pseudo-random sample). Rows that fail
    the base limits are rejected anyway, so the list learns from the others. Of more than
    ``max_fit_rows`` distinct (statistics, label) rows the smallest hashes are taken."""
    chosen = (labels.where(F.col(target).isNotNull() & F.col("doc_id").isNotNull())
              .select("doc_id", F.col(target).alias("_y"))
              .orderBy(F.xxhash64("doc_id", F.lit(10)), "doc_id", "_y").limit(max_fit_rows))
    labelled = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    # not deterministic to the optimizer: no filter on statistics moves below the join, where it would read all texts
    rows = labelled.select("_y", stats_udf.asNondeterministic()(F.col("text").cast("binary")).alias("stats"))
    equal = (rows.where(~base_failed()).groupBy("stats", "_y").agg(F.count(F.lit(1)).alias("_n"))
             .orderBy(F.xxhash64("stats", "_y", F.lit(10)), "stats", "_y").limit(max_fit_rows))
    cols = features("stats")
    got = equal.select("_y", "_n", *[c.alias(k) for k, c in cols.items()]).toPandas()
    if not len(got):
        return []
    names = list(cols)
    got = got.sort_values([*names, "_y"], kind="stable")
    return fit_rules(names, got[names].to_numpy(float), (got["_y"] == 0).to_numpy(), counts=got["_n"].to_numpy(), **options)


def base_failed(s: str = "stats") -> Column:
    """Fixed limits: under 10 words, or over a fifth of the words repeated."""
    n, r = F.col(f"`{s}`.n_words"), F.col(f"`{s}`.n_repeat_words")
    return (n < 10) | (100 * r > 20 * n)


def judge(docs: DataFrame, rules: list[Rule], out: str = "stats") -> DataFrame:
    """``docs`` with ``stats``, ``base_failed``, ``rule`` (first that fired, else 0), ``kept``;
    columns of those names are replaced."""
    scored = with_stats(docs, out=out)
    return scored.withColumns({
        "base_failed": base_failed(out),
        "rule": rule_column(rules, features(out)),
    }).withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def keep_good(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """The documents that pass, with the columns they came with."""
    names = docs.columns
    s = fresh_name(names, "_stats")
    scored = with_stats(docs, out=s)
    ok = ~base_failed(s) & (rule_column(rules, features(s)) == 0)
    return scored.where(ok).select(*[F.col(f"`{c}`") for c in names])
