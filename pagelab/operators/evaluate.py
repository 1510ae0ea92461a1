"""H: metrics of scored rows, computed as conditional aggregates.

Every metric of a threshold grid comes from ONE aggregate with a pair of
conditional sums per threshold (no join with the grid, no per-threshold job).
Rank metrics (AUC, ROC) pre-aggregate rows per distinct score and use the
scalable running sums of :mod:`pagelab.operators.stats`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelab.operators.stats import grouped_cumsum

# ---------------------------------------------------------------------------
# Fixed values of the reference's evaluation scripts
# ---------------------------------------------------------------------------
ACCURACY_SWEEP = [round(0.10 + 0.05 * i, 2) for i in range(16)]      # 0.10 .. 0.85, prob > t
F1_SWEEP_POINTS = 100                                                # t = i / 99, prob >= t
TABLE_THRESHOLDS = [0.5, 0.4, 0.3, 0.2, 0.1, 0.05]                   # prob >= t
PROB_BANDS = [("<0.1", None, 0.1), ("0.1-0.3", 0.1, 0.3), ("0.3-0.5", 0.3, 0.5),
              ("0.5-0.7", 0.5, 0.7), (">=0.7", 0.7, None)]
# ---------------------------------------------------------------------------


def threshold_predict(prob, t: float = 0.5, strict: bool = True) -> Column:
    """1 when prob > t (strict) or prob >= t."""
    p = F.col(prob) if isinstance(prob, str) else prob
    return (p > t if strict else p >= t).cast("int")


def _safe_div(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def confusion_counts(df: DataFrame, label: str = "label", pred: str = "prediction", groups=()) -> DataFrame:
    y, p = F.col(label), F.col(pred)
    return df.groupBy(*groups).agg(
        F.sum(((y == 1) & (p == 1)).cast("long")).alias("tp"),
        F.sum(((y == 0) & (p == 1)).cast("long")).alias("fp"),
        F.sum(((y == 1) & (p == 0)).cast("long")).alias("fn"),
        F.sum(((y == 0) & (p == 0)).cast("long")).alias("tn"))


def confusion_matrix(df: DataFrame, label: str = "label", pred: str = "prediction", groups=()) -> DataFrame:
    """H1: the four cells as rows (label, prediction, count)."""
    c = confusion_counts(df, label, pred, groups)
    cells = F.array(*[F.struct(F.lit(a).alias(label), F.lit(b).alias(pred), F.col(n).alias("count"))
                      for a, b, n in [(0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn"), (1, 1, "tp")]])
    return c.select(*groups, F.explode(cells).alias("c")).select(*groups, "c.*")


def metrics_from_counts(c: DataFrame, groups=()) -> DataFrame:
    """H2/H3/H4: accuracy; support-weighted precision, recall, F1; positive
    class precision, recall, F1, F2 (0 when undefined)."""
    tp, fp, fn, tn = (F.col(x).cast("double") for x in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    p1, r1 = _safe_div(tp, tp + fp), _safe_div(tp, tp + fn)
    p0, r0 = _safe_div(tn, tn + fn), _safe_div(tn, tn + fp)
    f1_1, f1_0 = _safe_div(2 * p1 * r1, p1 + r1), _safe_div(2 * p0 * r0, p0 + r0)
    s1, s0 = tp + fn, tn + fp
    return c.select(
        *groups, "tp", "fp", "fn", "tn",
        _safe_div(tp + tn, n).alias("accuracy"),
        _safe_div(p1 * s1 + p0 * s0, n).alias("precision_weighted"),
        _safe_div(r1 * s1 + r0 * s0, n).alias("recall_weighted"),
        _safe_div(f1_1 * s1 + f1_0 * s0, n).alias("f1_weighted"),
        p1.alias("precision_pos"), r1.alias("recall_pos"), f1_1.alias("f1_pos"),
        _safe_div(5 * p1 * r1, 4 * p1 + r1).alias("f2_pos"),
        s1.cast("long").alias("support_pos"))


def score_counts(df: DataFrame, label: str = "label", score: str = "prob", groups=()) -> DataFrame:
    """Rows per distinct score: (groups, score, pos, neg)."""
    y = F.col(label)
    return df.groupBy(*groups, score).agg(F.sum((y == 1).cast("long")).alias("pos"),
                                          F.sum((y == 0).cast("long")).alias("neg"))


def roc_auc(df: DataFrame, label: str = "label", score: str = "prob", groups=()) -> DataFrame:
    """H5: area under ROC with tied scores counted half (Mann-Whitney);
    NULL when a class is missing."""
    groups = list(groups)
    s = grouped_cumsum(score_counts(df, label, score, groups), groups, score, ["neg"])
    part = F.col("pos") * (F.col("cum_neg") - F.col("neg") + 0.5 * F.col("neg"))
    a = s.groupBy(*groups).agg(F.sum(part).alias("_u"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    auc = F.when((F.col("n_pos") == 0) | (F.col("n_neg") == 0), F.lit(None).cast("double")) \
        .otherwise(F.col("_u") / (F.col("n_pos") * F.col("n_neg")))
    return a.select(*groups, "n_pos", "n_neg", auc.alias("roc_auc"))


def roc_curve(df: DataFrame, label: str = "label", score: str = "prob", groups=()) -> DataFrame:
    """H6: (threshold, tpr, fpr) at every distinct score, score >= threshold."""
    groups = list(groups)
    c = score_counts(df, label, score, groups).withColumn("_neg_score", -F.col(score))
    s = grouped_cumsum(c, groups, "_neg_score", ["pos", "neg"])
    tot = c.groupBy(*groups).agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    s = s.join(F.broadcast(tot), groups) if groups else s.join(F.broadcast(tot), how="inner")
    return s.select(*groups, F.col(score).alias("threshold"),
                    _safe_div(F.col("cum_pos"), F.col("_p")).alias("tpr"),
                    _safe_div(F.col("cum_neg"), F.col("_n")).alias("fpr"))


def _cell(score, thresholds: list[float], strict: bool):
    """How many of the ascending ``thresholds`` a score passes: a binary search of comparisons."""
    def search(lo: int, hi: int):
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        passed = score > thresholds[mid] if strict else score >= thresholds[mid]
        return F.when(passed, search(mid + 1, hi)).otherwise(search(lo, mid))
    return search(0, len(thresholds))


def threshold_sweep(df: DataFrame, thresholds, label: str = "label", score: str = "prob",
                    strict: bool = True, groups=()) -> DataFrame:
    """Counts (tp, fp, fn, tn) at every threshold from a histogram: one pass counts rows per
    class and cell between thresholds; a threshold's counts are sums of the cells above it.
    A row costs a binary search, whatever the number of thresholds."""
    groups, ts = list(groups), sorted({float(t) for t in thresholds})
    y = F.col(label)
    cells = df.groupBy(*groups, _cell(F.col(score), ts, strict).alias("_c")).agg(
        F.sum((y == 1).cast("long")).alias("p"), F.sum((y == 0).cast("long")).alias("n"))
    # at most one cell more than thresholds per group
    per = cells.groupBy(*groups).agg(F.collect_list(F.struct("_c", "p", "n")).alias("_h"))
    add = lambda least, side: F.aggregate(
        F.filter("_h", lambda h: h["_c"] >= least), F.lit(0).cast("long"), lambda a, h: a + F.coalesce(h[side], F.lit(0)))
    at = F.explode(F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.lit(ts.index(float(t)) + 1).alias("least")) for t in thresholds]))
    x = per.select(*groups, "_h", at.alias("_t"))
    x = x.select(*groups, "_t.threshold", add(F.col("_t.least"), "p").alias("tp"), add(F.col("_t.least"), "n").alias("fp"),
                 add(F.lit(0), "p").alias("_p"), add(F.lit(0), "n").alias("_n"))
    return x.select(*groups, "threshold", "tp", "fp", (F.col("_p") - F.col("tp")).alias("fn"), (F.col("_n") - F.col("fp")).alias("tn"))


def sweep_accuracy(df: DataFrame, label="label", score="prob", thresholds=ACCURACY_SWEEP) -> DataFrame:
    """H7: accuracy at each threshold (prob > t); the first best is flagged."""
    s = threshold_sweep(df, thresholds, label, score, strict=True)
    s = s.withColumn("accuracy", (F.col("tp") + F.col("tn")) / (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")))
    best = s.agg(F.max_by(F.col("threshold"), F.struct(F.col("accuracy"), -F.col("threshold"))).alias("_best"))
    return s.join(F.broadcast(best), how="inner").select(  # one-row side
        "threshold", "accuracy", (F.col("threshold") == F.col("_best")).alias("is_best"))


def sweep_f1(df: DataFrame, label="label", score="prob", points: int = F1_SWEEP_POINTS) -> DataFrame:
    """H8: precision, recall, F1 at ``points`` evenly spaced thresholds on
    [0, 1] (prob >= t); arg-max F1 (first) flagged, with its accuracy."""
    ts = [i / (points - 1) for i in range(points)]
    s = threshold_sweep(df, ts, label, score, strict=False)
    tp, fp, fn, tn = (F.col(x).cast("double") for x in ("tp", "fp", "fn", "tn"))
    p, r = _safe_div(tp, tp + fp), _safe_div(tp, tp + fn)
    s = s.select("threshold", p.alias("precision"), r.alias("recall"), _safe_div(2 * p * r, p + r).alias("f1"),
                 ((tp + tn) / (tp + fp + fn + tn)).alias("accuracy"))
    best = s.agg(F.max_by(F.col("threshold"), F.struct(F.col("f1"), -F.col("threshold"))).alias("_best"))
    return s.join(F.broadcast(best), how="inner").withColumn("is_best", F.col("threshold") == F.col("_best")).drop("_best")


def threshold_table(df: DataFrame, label="label", score="prob", thresholds=TABLE_THRESHOLDS) -> DataFrame:
    """H9: recall, precision, false and true positives at listed thresholds."""
    s = threshold_sweep(df, thresholds, label, score, strict=False)
    tp, fp, fn = (F.col(x).cast("double") for x in ("tp", "fp", "fn"))
    return s.select("threshold", _safe_div(tp, tp + fn).alias("recall"), _safe_div(tp, tp + fp).alias("precision"),
                    F.col("fp").alias("false_positives"), F.col("tp").alias("true_positives"))


def probability_bands(df: DataFrame, label="label", score="prob") -> DataFrame:
    """Mean probability and band counts per class."""
    s = F.col(score)
    aggs = [F.avg(s).alias("mean_prob")]
    for name, lo, hi in PROB_BANDS:
        cond = F.lit(True)
        if lo is not None:
            cond = cond & (s >= lo)
        if hi is not None:
            cond = cond & (s < hi)
        aggs.append(F.sum(cond.cast("long")).alias("band_" + name.replace("<", "lt").replace(">=", "ge")
                                                   .replace(".", "").replace("-", "_")))
    return df.groupBy(label).agg(*aggs)
