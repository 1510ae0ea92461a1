"""Registered queries G13 and H (evaluation) on deterministic scores.

Scores are fixed logistic functions of page features (no training), so every
metric has an exact SQL oracle. Trained models reuse the same operators.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from pagelab.functions import html as H, url as U
from pagelab.operators import evaluate as EV
from pagelab.plans import catalog
from pagelab.plans import sqlfrag as S
from pagelab.plans.q_pages import PAGES_L
from pagelab.plans.registry import register

# ---------------------------------------------------------------------------
# Fixed weights of the deterministic scorers
# ---------------------------------------------------------------------------
URL_W = {"bias": 0.8, "en_path": -1.8, "len": 0.02, "len_c": 40.0, "sub": 0.3, "https": -0.4, "digits": 1.5}
HTML_W = {"bias": -0.4, "len": 0.0002, "len_c": 5000.0, "text": 3.0, "text_c": 0.85, "tags": 0.01, "tags_c": 80.0}
# ---------------------------------------------------------------------------


def url_logit(url) -> F.Column:
    f = U.structural_url_features(url)
    z = (F.lit(URL_W["bias"]) + URL_W["en_path"] * F.col(url).contains("/en/").cast("double")
         + URL_W["len"] * (f["url_length"] - URL_W["len_c"]) + URL_W["sub"] * f["url_num_subdomains"]
         + URL_W["https"] * f["is_https"] + URL_W["digits"] * f["url_digit_ratio"])
    return 1.0 / (1.0 + F.exp(-z))


def html_logit(url, html) -> F.Column:
    f = H.pattern_features(url, html)
    z = (F.lit(HTML_W["bias"]) + HTML_W["len"] * (f["html_length"] - HTML_W["len_c"])
         + HTML_W["text"] * (f["html_text_ratio"] - HTML_W["text_c"])
         + HTML_W["tags"] * (f["html_num_tags"] - HTML_W["tags_c"]))
    return 1.0 / (1.0 + F.exp(-z))


def _url_logit_sql():
    f = S.structural_url()
    z = (f"({URL_W['bias']} + ({URL_W['en_path']}) * CAST(contains(url, '/en/') AS DOUBLE) + {URL_W['len']} * ({f['url_length']} - {URL_W['len_c']})"
         f" + {URL_W['sub']} * {f['url_num_subdomains']} + ({URL_W['https']}) * {f['is_https']} + {URL_W['digits']} * ({f['url_digit_ratio']}))")
    return f"1.0 / (1.0 + exp(-{z}))"


def _html_logit_sql():
    f = S.pattern_html()
    z = (f"(({HTML_W['bias']}) + {HTML_W['len']} * ({f['html_length']} - {HTML_W['len_c']})"
         f" + {HTML_W['text']} * ({f['html_text_ratio']} - {HTML_W['text_c']}) + {HTML_W['tags']} * ({f['html_num_tags']} - {HTML_W['tags_c']}))")
    return f"1.0 / (1.0 + exp(-{z}))"


SCORED = f"""{PAGES_L}, scored AS (SELECT page_id, label, era, {_url_logit_sql()} AS prob,
  CAST({_url_logit_sql()} > 0.5 AS INTEGER) AS prediction FROM pages_l)"""
MODELS = f"""{PAGES_L}, m AS (
  SELECT 'url_logit' AS model, page_id, label, {_url_logit_sql()} AS prob FROM pages_l
  UNION ALL SELECT 'html_logit', page_id, label, {_html_logit_sql()} FROM pages_l
  UNION ALL SELECT 'blend', page_id, label, ({_url_logit_sql()} + {_html_logit_sql()}) / 2 FROM pages_l),
mp AS (SELECT *, CAST(prob > 0.5 AS INTEGER) AS prediction FROM m)"""


def scored(spark, sf):
    p = catalog.pages(spark, sf)
    return p.select("page_id", "label", "era", url_logit("url").alias("prob")) \
        .withColumn("prediction", EV.threshold_predict("prob", 0.5))


def model_scores(spark, sf):
    p = catalog.pages(spark, sf)
    u, h = url_logit("url"), html_logit("url", "html")
    x = p.select("page_id", "label", F.explode(F.array(
        F.struct(F.lit("url_logit").alias("model"), u.alias("prob")),
        F.struct(F.lit("html_logit").alias("model"), h.alias("prob")),
        F.struct(F.lit("blend").alias("model"), ((u + h) / 2).alias("prob")))).alias("m"))
    x = x.select("m.model", "page_id", "label", "m.prob")
    return x.withColumn("prediction", EV.threshold_predict("prob", 0.5))


@register("threshold_predict", sql=f"""WITH {SCORED}
SELECT page_id, round(prob, 6) AS prob, prediction::BIGINT AS prediction,
  CAST(prob >= 0.5 AS BIGINT) AS prediction_ge FROM scored""")
def q_thr(spark, sf):
    """Strict (>) and non-strict (>=) predictions at 0.5."""
    return scored(spark, sf).select("page_id", "prob", "prediction",
                                    EV.threshold_predict("prob", 0.5, strict=False).alias("prediction_ge"))


@register("confusion_matrix", sql=f"""WITH {SCORED},
cells AS (SELECT * FROM (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS t(label, prediction))
SELECT c.label::BIGINT AS label, c.prediction::BIGINT AS prediction, count(s.page_id)::BIGINT AS count
FROM cells c LEFT JOIN scored s ON s.label = c.label AND s.prediction = c.prediction GROUP BY c.label, c.prediction""")
def q_cm(spark, sf):
    """H1: 2x2 confusion counts."""
    return EV.confusion_matrix(scored(spark, sf))


_MET_SQL = """tp, fp, fn, tn,
  round(CASE WHEN n = 0 THEN 0 ELSE (tp + tn) / n END, 6) AS accuracy,
  round(CASE WHEN n = 0 THEN 0 ELSE (p1 * (tp + fn) + p0 * (tn + fp)) / n END, 6) AS precision_weighted,
  round(CASE WHEN n = 0 THEN 0 ELSE (r1 * (tp + fn) + r0 * (tn + fp)) / n END, 6) AS recall_weighted,
  round(CASE WHEN n = 0 THEN 0 ELSE ((CASE WHEN p1 + r1 = 0 THEN 0 ELSE 2 * p1 * r1 / (p1 + r1) END) * (tp + fn)
        + (CASE WHEN p0 + r0 = 0 THEN 0 ELSE 2 * p0 * r0 / (p0 + r0) END) * (tn + fp)) / n END, 6) AS f1_weighted,
  round(p1, 6) AS precision_pos, round(r1, 6) AS recall_pos,
  round(CASE WHEN p1 + r1 = 0 THEN 0 ELSE 2 * p1 * r1 / (p1 + r1) END, 6) AS f1_pos,
  round(CASE WHEN 4 * p1 + r1 = 0 THEN 0 ELSE 5 * p1 * r1 / (4 * p1 + r1) END, 6) AS f2_pos,
  (tp + fn)::BIGINT AS support_pos"""


def _counts_sql(src, groups=""):
    g = f"{groups}, " if groups else ""
    return f"""c AS (SELECT {g}count(*) FILTER (WHERE label = 1 AND prediction = 1)::DOUBLE AS tp,
  count(*) FILTER (WHERE label = 0 AND prediction = 1)::DOUBLE AS fp,
  count(*) FILTER (WHERE label = 1 AND prediction = 0)::DOUBLE AS fn,
  count(*) FILTER (WHERE label = 0 AND prediction = 0)::DOUBLE AS tn FROM {src} {'GROUP BY ' + groups if groups else ''}),
k AS (SELECT *, tp + fp + fn + tn AS n,
  CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS p1, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS r1,
  CASE WHEN tn + fn = 0 THEN 0 ELSE tn / (tn + fn) END AS p0, CASE WHEN tn + fp = 0 THEN 0 ELSE tn / (tn + fp) END AS r0 FROM c)"""


@register("weighted_metrics", sql=f"""WITH {SCORED}, {_counts_sql('scored')}
SELECT tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, tn::BIGINT AS tn, {_MET_SQL.split(',', 4)[4]} FROM k""")
def q_wm(spark, sf):
    """H2-H4: accuracy, weighted and positive-class precision/recall/F1, F2."""
    return EV.metrics_from_counts(EV.confusion_counts(scored(spark, sf)))


_AUC = """a AS (SELECT {g}label, (rank() OVER (PARTITION BY {g0} ORDER BY prob) + count(*) OVER (PARTITION BY {g0} ORDER BY prob)) / 2.0 AS r FROM {src}),
auc AS (SELECT {g}count(*) FILTER (WHERE label = 1) AS n_pos, count(*) FILTER (WHERE label = 0) AS n_neg,
  CASE WHEN count(*) FILTER (WHERE label = 1) = 0 OR count(*) FILTER (WHERE label = 0) = 0 THEN NULL
  ELSE (sum(r) FILTER (WHERE label = 1) - count(*) FILTER (WHERE label = 1) * (count(*) FILTER (WHERE label = 1) + 1) / 2.0)
       / (count(*) FILTER (WHERE label = 1) * count(*) FILTER (WHERE label = 0)) END AS roc_auc FROM a {gb})"""


@register("roc_auc", sql=f"""WITH {SCORED}, {_AUC.format(g='', g0='1', src='scored', gb='')}
SELECT n_pos::BIGINT AS n_pos, n_neg::BIGINT AS n_neg, round(roc_auc, 6) AS roc_auc FROM auc""")
def q_auc(spark, sf):
    """H5: ROC AUC with tie-averaged ranks."""
    return EV.roc_auc(scored(spark, sf))


@register("roc_curve", sql=f"""WITH {SCORED},
d AS (SELECT prob, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg FROM scored GROUP BY prob),
t AS (SELECT sum(pos) AS P, sum(neg) AS N FROM d)
SELECT round(prob, 6) AS threshold, round(sum(pos) OVER (ORDER BY prob DESC) / P, 6) AS tpr,
  round(sum(neg) OVER (ORDER BY prob DESC) / N, 6) AS fpr FROM d, t""")
def q_roc(spark, sf):
    """H6: true and false positive rates at every distinct score."""
    return EV.roc_curve(scored(spark, sf))


@register("threshold_sweep_accuracy", sql=f"""WITH {SCORED},
t AS (SELECT round(0.10 + 0.05 * i, 2)::DOUBLE AS threshold FROM range(16) r(i)),
a AS (SELECT threshold, avg(CASE WHEN CAST(prob > threshold AS INTEGER) = label THEN 1.0 ELSE 0.0 END) AS accuracy
      FROM t, scored GROUP BY threshold)
SELECT round(threshold, 6) AS threshold, round(accuracy, 6) AS accuracy,
  (row_number() OVER (ORDER BY accuracy DESC, threshold) = 1)::BIGINT AS is_best FROM a""")
def q_sweep_acc(spark, sf):
    """H7: accuracy at t = 0.10..0.85 (prob > t), first best flagged."""
    return EV.sweep_accuracy(scored(spark, sf))


@register("threshold_sweep_f1", sql=f"""WITH {SCORED},
t AS (SELECT i / 99.0 AS threshold FROM range(100) r(i)),
c AS (SELECT threshold, count(*) FILTER (WHERE prob >= threshold AND label = 1)::DOUBLE AS tp,
  count(*) FILTER (WHERE prob >= threshold AND label = 0)::DOUBLE AS fp,
  count(*) FILTER (WHERE prob < threshold AND label = 1)::DOUBLE AS fn,
  count(*) FILTER (WHERE prob < threshold AND label = 0)::DOUBLE AS tn FROM t, scored GROUP BY threshold),
m AS (SELECT threshold, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS precision,
  CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS recall, (tp + tn) / (tp + fp + fn + tn) AS accuracy FROM c),
f AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM m)
SELECT round(threshold, 6) AS threshold, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
  round(accuracy, 6) AS accuracy, (row_number() OVER (ORDER BY f1 DESC, threshold) = 1)::BIGINT AS is_best FROM f""")
def q_sweep_f1(spark, sf):
    """H8: precision, recall, F1 on 100 thresholds (prob >= t), best F1 flagged."""
    return EV.sweep_f1(scored(spark, sf))


@register("threshold_table", sql=f"""WITH {SCORED},
t AS (SELECT * FROM (VALUES (0.5::DOUBLE), (0.4::DOUBLE), (0.3::DOUBLE), (0.2::DOUBLE), (0.1::DOUBLE), (0.05::DOUBLE)) AS v(threshold)),
c AS (SELECT threshold, count(*) FILTER (WHERE prob >= threshold AND label = 1)::DOUBLE AS tp,
  count(*) FILTER (WHERE prob >= threshold AND label = 0)::DOUBLE AS fp,
  count(*) FILTER (WHERE prob < threshold AND label = 1)::DOUBLE AS fn FROM t, scored GROUP BY threshold)
SELECT round(threshold, 6) AS threshold, round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END, 6) AS recall,
  round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, 6) AS precision,
  fp::BIGINT AS false_positives, tp::BIGINT AS true_positives FROM c""")
def q_thr_table(spark, sf):
    """H9: recall / precision / FP / TP at listed thresholds (prob >= t)."""
    return EV.threshold_table(scored(spark, sf))


@register("probability_bands", sql=f"""WITH {SCORED}
SELECT label::BIGINT AS label, round(avg(prob), 6) AS mean_prob,
  count(*) FILTER (WHERE prob < 0.1) AS band_lt01, count(*) FILTER (WHERE prob >= 0.1 AND prob < 0.3) AS band_01_03,
  count(*) FILTER (WHERE prob >= 0.3 AND prob < 0.5) AS band_03_05, count(*) FILTER (WHERE prob >= 0.5 AND prob < 0.7) AS band_05_07,
  count(*) FILTER (WHERE prob >= 0.7) AS band_ge07 FROM scored GROUP BY label""")
def q_bands(spark, sf):
    """Mean probability and probability bands per class."""
    return EV.probability_bands(scored(spark, sf))


@register("metrics_percent_report", sql=f"""WITH {MODELS}, {_counts_sql('mp', 'model')}
SELECT model, round(coalesce(CASE WHEN n = 0 THEN 0 ELSE (tp + tn) / n END, 0) * 100, 2) AS accuracy,
  round(coalesce(CASE WHEN n = 0 THEN 0 ELSE (p1 * (tp + fn) + p0 * (tn + fp)) / n END, 0) * 100, 2) AS precision,
  round(coalesce(CASE WHEN n = 0 THEN 0 ELSE (r1 * (tp + fn) + r0 * (tn + fp)) / n END, 0) * 100, 2) AS recall,
  round(coalesce(CASE WHEN n = 0 THEN 0 ELSE ((CASE WHEN p1 + r1 = 0 THEN 0 ELSE 2 * p1 * r1 / (p1 + r1) END) * (tp + fn)
        + (CASE WHEN p0 + r0 = 0 THEN 0 ELSE 2 * p0 * r0 / (p0 + r0) END) * (tn + fp)) / n END, 0) * 100, 2) AS f1
FROM k""")
def q_pct(spark, sf):
    """Accuracy / precision / recall / F1 in percent per model, missing -> 0."""
    m = EV.metrics_from_counts(EV.confusion_counts(model_scores(spark, sf), groups=["model"]), groups=["model"])
    return m.select("model", *[F.round(F.coalesce(F.col(c), F.lit(0.0)) * 100, 2).alias(o) for c, o in
                               [("accuracy", "accuracy"), ("precision_weighted", "precision"),
                                ("recall_weighted", "recall"), ("f1_weighted", "f1")]])


@register("metrics_heatmap_table", sql=f"""WITH {MODELS}, {_counts_sql('mp', 'model')},
{_AUC.format(g='model, ', g0='model', src='mp', gb='GROUP BY model')},
long AS (SELECT model, 'accuracy' AS metric, (tp + tn) / n AS value FROM k
  UNION ALL SELECT model, 'f1_weighted', ((CASE WHEN p1 + r1 = 0 THEN 0 ELSE 2 * p1 * r1 / (p1 + r1) END) * (tp + fn)
        + (CASE WHEN p0 + r0 = 0 THEN 0 ELSE 2 * p0 * r0 / (p0 + r0) END) * (tn + fp)) / n FROM k
  UNION ALL SELECT model, 'roc_auc', roc_auc FROM auc)
SELECT metric, round(max(value) FILTER (WHERE model = 'url_logit'), 6) AS url_logit,
  round(max(value) FILTER (WHERE model = 'html_logit'), 6) AS html_logit,
  round(max(value) FILTER (WHERE model = 'blend'), 6) AS blend FROM long GROUP BY metric""")
def q_heat(spark, sf):
    """Metric x model matrix (pivot)."""
    ms = model_scores(spark, sf)
    m = EV.metrics_from_counts(EV.confusion_counts(ms, groups=["model"]), groups=["model"])
    a = EV.roc_auc(ms, groups=["model"])
    long = (m.select("model", F.lit("accuracy").alias("metric"), F.col("accuracy").alias("value"))
            .unionByName(m.select("model", F.lit("f1_weighted").alias("metric"), F.col("f1_weighted").alias("value")))
            .unionByName(a.select("model", F.lit("roc_auc").alias("metric"), F.col("roc_auc").alias("value"))))
    return long.groupBy("metric").pivot("model", ["url_logit", "html_logit", "blend"]).agg(F.max("value"))
