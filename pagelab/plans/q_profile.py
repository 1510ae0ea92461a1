"""Registered queries F (scaling, assembly) and I (drift and profiles) on the
28 base structural columns."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pagelab.operators import drift as DR, scale as SC
from pagelab.operators.features import BASE_28, structural_base
from pagelab.plans import catalog
from pagelab.plans import q_text as QT
from pagelab.plans import sqlfrag as S
from pagelab.plans.q_pages import PAGES_L
from pagelab.plans.registry import register
from pagelab.session import scratch_path

#: (application, data folder) -> path of the written base columns
_BASE: dict[tuple[str, str], str] = {}

_ALL = {**S.structural_url(), **S.pattern_html(), "brand_discrepancy": S.brand_lev(), **S.tree()}
_COLS = ",\n  ".join(f"CAST({_ALL[c]} AS DOUBLE) AS {c}" for c in BASE_28)
BASE = f"""{PAGES_L}, evs AS ({S.events_cte('pages_l')}),
f AS (SELECT page_id, label, era, {_COLS} FROM evs)"""
LONG = f"""{BASE}, lg AS (SELECT page_id, label, era, feature, value FROM f
  UNPIVOT (value FOR feature IN ({', '.join(BASE_28)})))"""

FLAGS = ["is_https", "url_has_login", "url_hyphen_domain", "html_password_input_count",
         "css_hidden_count", "foreign_form_action", "iframe_count"]
# count features (fixed values)
DISCRETE = ["iframe_count", "css_hidden_count", "html_password_input_count", "url_num_subdomains", "url_path_depth"]
RADAR = {
    "DOM Complexity": ["dom_depth", "html_num_tags", "tag_diversity"],
    "Lexical Suspicion": ["url_length", "url_entropy", "url_num_special_chars"],
    "CSS Evasion": ["css_hidden_count"],
    "External Links": ["html_external_link_ratio"],
    "Form Actions": ["foreign_form_action", "html_password_input_count"],
}


def base(spark, sf):
    """The 28 base columns per page, written once per session and data folder: the profile
    operators read them in several branches, whose tasks on other executors would extract them again."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _BASE:
        path = scratch_path(spark, f"base_{uuid.uuid4().hex}")
        structural_base(catalog.pages(spark, sf), keep=("page_id", "label", "era")).write.parquet(path)
        _BASE[key] = path
    return spark.read.parquet(_BASE[key])


def r6(x: str) -> str:
    return f"round({x}, 6)"


# ======================================================================= F
@register("clip_upper_p99", sql=f"""WITH {BASE},
ub AS (SELECT {', '.join(f"quantile_cont({c}, 0.99) FILTER (WHERE era = 'old') AS ub_{c}" for c in BASE_28)} FROM f)
SELECT page_id, {', '.join(f"{r6(f'least({c}, ub_{c})')} AS {c}" for c in BASE_28)} FROM f, ub""")
def q_clip(spark, sf):
    """clip above the 99th percentile fitted on the old era."""
    b = base(spark, sf)
    st = SC.clip_fit(b.where("era = 'old'"), BASE_28)
    return SC.clip_apply(b, st, BASE_28).select("page_id", *BASE_28)


@register("zscore", sql=f"""WITH {BASE},
st AS (SELECT {', '.join(f"avg({c}) FILTER (WHERE era = 'old') AS m_{c}, CASE WHEN stddev_pop({c}) FILTER (WHERE era = 'old') = 0 THEN 1 ELSE stddev_pop({c}) FILTER (WHERE era = 'old') END AS s_{c}" for c in BASE_28)} FROM f)
SELECT page_id, {', '.join(f"{r6(f'({c} - m_{c}) / s_{c}')} AS {c}" for c in BASE_28)} FROM f, st""")
def q_z(spark, sf):
    """F2: z-score with population sigma fitted on the old era (sigma 0 -> 1)."""
    b = base(spark, sf)
    return SC.zscore_apply(b, SC.zscore_fit(b.where("era = 'old'"), BASE_28), BASE_28).select("page_id", *BASE_28)


@register("minmax", sql=f"""WITH {BASE},
st AS (SELECT {', '.join(f"min({c}) AS lo_{c}, max({c}) AS hi_{c}" for c in BASE_28)} FROM f)
SELECT page_id, {', '.join(f"{r6(f'CASE WHEN hi_{c} = lo_{c} THEN 0.0 ELSE ({c} - lo_{c}) / (hi_{c} - lo_{c}) END')} AS {c}" for c in BASE_28)} FROM f, st""")
def q_minmax(spark, sf):
    """min-max scaling to [0, 1]."""
    b = base(spark, sf)
    return SC.minmax_apply(b, SC.minmax_fit(b, BASE_28), BASE_28).select("page_id", *BASE_28)


@register("log1p_clip", sql=f"""WITH {BASE}
SELECT page_id, {', '.join(f"{r6(f'ln(1 + greatest({c}, 0))')} AS {c}" for c in BASE_28)} FROM f""")
def q_log1p(spark, sf):
    """log1p of max(x, 0)."""
    return SC.log1p_clip(base(spark, sf), BASE_28).select("page_id", *BASE_28)


@register("melt_features", sql=f"""WITH {LONG}
SELECT page_id, label::BIGINT AS label, feature, {r6('value')} AS value FROM lg WHERE value IS NOT NULL""")
def q_melt(spark, sf):
    """F8: wide -> long (page, class, feature, value)."""
    return SC.melt(base(spark, sf), ["page_id", "label"], BASE_28)


@register("drop_top_quantile", sql=f"""WITH {LONG},
q AS (SELECT feature, quantile_cont(value, 0.99) AS q99 FROM lg GROUP BY feature)
SELECT page_id, feature, {r6('value')} AS value FROM lg JOIN q USING (feature) WHERE value <= q99""")
def q_drop_q(spark, sf):
    """per feature, keep values at or below the 0.99 quantile."""
    long = SC.melt(base(spark, sf), ["page_id"], BASE_28)
    return DR.drop_top_quantile(long, 0.99).select("page_id", "feature", "value")


@register("drop_top_quantile_scaled", sql=f"""WITH {LONG},
q AS (SELECT feature, quantile_cont(value, 0.95) AS q95 FROM lg GROUP BY feature)
SELECT page_id, feature, factor, {r6('value')} AS value FROM lg JOIN q USING (feature), (VALUES (1.5::DOUBLE), (2.0::DOUBLE)) AS x(factor)
WHERE q95 <= 0 OR value <= q95 * factor""")
def q_drop_q_scaled(spark, sf):
    """values up to 1.5 and 2 times the 0.95 quantile; features without a positive quantile stay whole."""
    long = SC.melt(base(spark, sf), ["page_id"], BASE_28)
    cut = [DR.drop_top_quantile(long, 0.95, factor=x).select("page_id", "feature", F.lit(x).alias("factor"), "value") for x in (1.5, 2.0)]
    return cut[0].unionByName(cut[1])


@register("null_top_quantile", sql=f"""WITH {LONG},
q AS (SELECT feature, quantile_cont(value, 0.99) AS q99 FROM lg GROUP BY feature)
SELECT page_id, feature, CASE WHEN value <= q99 THEN {r6('value')} END AS value FROM lg JOIN q USING (feature)""")
def q_null_q(spark, sf):
    """values above the 0.99 quantile become null, rows stay."""
    long = SC.melt(base(spark, sf), ["page_id"], BASE_28)
    return DR.drop_top_quantile(long, 0.99, null_out=True).select("page_id", "feature", "value")


@register("select_top_variance", sql=f"""WITH {LONG}
SELECT feature, {r6('v')} AS variance, rank::BIGINT AS rank FROM (
  SELECT feature, var_samp(value) AS v, row_number() OVER (ORDER BY round(var_samp(value), 9) DESC, feature) AS rank
  FROM lg GROUP BY feature) WHERE rank <= 15""")
def q_topvar(spark, sf):
    """the 15 highest-variance features."""
    return DR.top_variance(SC.melt(base(spark, sf), ["page_id"], BASE_28), 15)


#: The five term lists of each page, by block: number, name, number of terms.
_BLOCKS = [(1, "tag_tfidf_", 50), (2, "xpath_tfidf_", 25), (3, "z1_tfidf_", 20), (4, "z2_tfidf_", 20), (5, "z3_tfidf_", 20)]


def _terms_sql(fitted: str) -> str:
    """CTEs docs(blk, page_id, era, g), tf and voc(blk, term, idx, name, idf) of the vocabularies of
    the pages that meet ``fitted``; ``evs`` stands before."""
    third = "greatest(len(t) // 3, 1)"
    name = " ".join(f"WHEN {k} THEN '{p}'" for k, p, _ in _BLOCKS)
    most = " ".join(f"WHEN {k} THEN {n}" for k, _, n in _BLOCKS)
    return f"""tagged AS (SELECT page_id, era, {QT.TAGS} AS t FROM evs),
zones AS (SELECT page_id, era, t, {third} AS c FROM tagged),
docs AS (
  SELECT 1 AS blk, page_id, era, {QT.ngrams_sql('t', 2, 3)} AS g FROM tagged
  UNION ALL SELECT 2, page_id, era, {QT.ngrams_sql('x', 2, 3)} FROM (SELECT page_id, era, {QT.XP} AS x FROM evs)
  UNION ALL SELECT blk, page_id, era, {QT.ngrams_sql('z', 1, 2)} FROM (
    SELECT 3 AS blk, page_id, era, list_slice(t, 1, c) AS z FROM zones
    UNION ALL SELECT 4, page_id, era, list_slice(t, c + 1, 2 * c) FROM zones
    UNION ALL SELECT 5, page_id, era, list_slice(t, 2 * c + 1, len(t)) FROM zones)),
tf AS (SELECT blk, page_id, era, term, count(*) AS tf FROM (SELECT blk, page_id, era, unnest(g) AS term FROM docs) GROUP BY ALL),
top AS (SELECT blk, term, count(*) AS df FROM tf WHERE {fitted} GROUP BY blk, term
  QUALIFY row_number() OVER (PARTITION BY blk ORDER BY sum(tf) DESC, term) <= CASE blk {most} END),
voc AS (SELECT blk, term, 27 + row_number() OVER (ORDER BY blk, term) AS idx,
    CASE blk {name} END || term AS name, ln((1 + (SELECT count(*) FROM evs WHERE {fitted})) / (1 + df)) + 1 AS idf FROM top)"""


_VECTOR_SQL = f"""WITH {BASE}, {_terms_sql("era = 'old'")},
lg AS (SELECT page_id, era, feature AS name, value FROM f UNPIVOT (value FOR feature IN ({', '.join(BASE_28)}))),
ub AS (SELECT name, quantile_cont(value, 0.99) AS ub FROM lg WHERE era = 'old' GROUP BY name),
w AS (SELECT tf.page_id, voc.idx, tf.tf * voc.idf / sqrt(sum(tf.tf * voc.idf * tf.tf * voc.idf) OVER (PARTITION BY tf.blk, tf.page_id)) AS w
  FROM tf JOIN voc USING (blk, term)),
v AS (SELECT page_id, era, list_position({BASE_28!r}, name) - 1 AS idx, name, least(value, ub) AS value FROM lg JOIN ub USING (name)
  UNION ALL SELECT f.page_id, f.era, voc.idx, voc.name, coalesce(w.w, 0) FROM f CROSS JOIN voc
  LEFT JOIN w ON w.page_id = f.page_id AND w.idx = voc.idx),
st AS (SELECT idx, avg(value) AS mu, stddev_pop(value) AS sd FROM v WHERE era = 'old' GROUP BY idx)
SELECT page_id, idx::BIGINT AS idx, name, round((value - mu) / CASE WHEN sd < 1e-12 THEN 1 ELSE sd END, 6) AS value FROM v JOIN st USING (idx)"""


# the same with the sequence ratio in the place of the edit distance
_VECTOR_RATIO_SQL = f"WITH RECURSIVE {S.brand_ratio_ctes()}, " + _VECTOR_SQL.removeprefix("WITH ").replace(
    S.brand_lev(), "(SELECT bd FROM sm_brand WHERE sm_brand.page_id = evs.page_id)")


@register("structural_vector_163", sql=_VECTOR_RATIO_SQL)
def q_vec163(spark, sf):
    """28 clipped + 50 tag + 25 XPath + 3x20 zone TF-IDF, z-scored, fitted
    on the old era and applied to every page."""
    return _vector(spark, sf, "difflib")


@register("structural_vector_163_lev", sql=_VECTOR_SQL)
def q_vec163_lev(spark, sf):
    """F3 with the edit-distance form of the brand discrepancy, which SQL can express."""
    return _vector(spark, sf, "lev")


def _vector(spark, sf, brand):
    from pagelab.operators.vector import StructuralFeaturizer
    p = catalog.pages(spark, sf)
    model = StructuralFeaturizer(brand=brand).fit(p.where("era = 'old'"))
    out = model.transform(p)
    names = F.array(*[F.lit(n) for n in model.feature_names()])
    pairs = F.arrays_zip(names.alias("name"), F.col("features").alias("value"))
    return out.select("page_id", F.posexplode(pairs).alias("idx", "p")).select("page_id", "idx", "p.name", "p.value")


@register("feature_names", sql=f"""WITH {PAGES_L}, evs AS ({S.events_cte('pages_l')}), {_terms_sql("TRUE")}
SELECT (i - 1)::BIGINT AS idx, n[i] AS name FROM (SELECT {BASE_28!r} AS n), range(1, 29) AS r(i)
UNION ALL SELECT idx::BIGINT, name FROM voc""")
def q_names(spark, sf):
    """ordered feature names of the fitted structural vector."""
    from pagelab.operators.vector import StructuralFeaturizer
    p = catalog.pages(spark, sf)
    names = StructuralFeaturizer().fit(p).feature_names()
    return spark.createDataFrame([(i, n) for i, n in enumerate(names)], "idx int, name string")


# ======================================================================= I
@register("ks_drift", sql=f"""WITH {LONG},
n AS (SELECT count(*) FILTER (WHERE era = 'old') / 28 AS n_old, count(*) FILTER (WHERE era = 'new') / 28 AS n_new FROM lg),
c AS (SELECT feature, value, count(*) FILTER (WHERE era = 'old') AS o, count(*) FILTER (WHERE era = 'new') AS w FROM lg GROUP BY feature, value),
e AS (SELECT feature, sum(o) OVER (PARTITION BY feature ORDER BY value) / n_old AS fo,
  sum(w) OVER (PARTITION BY feature ORDER BY value) / n_new AS fw FROM c, n)
SELECT feature, {r6('max(abs(fo - fw))')} AS ks FROM e GROUP BY feature""")
def q_ks(spark, sf):
    """Two-sample KS statistic per feature between the eras."""
    return DR.ks_drift(SC.melt(base(spark, sf), ["page_id", "era"], BASE_28), "era", "old", "new")


_SHIFT = """m AS (SELECT feature, avg(value) FILTER (WHERE era = 'old') AS old_mean, avg(value) FILTER (WHERE era = 'new') AS new_mean FROM lg {w} GROUP BY feature)"""


@register("mean_shift_pct", sql=f"""WITH {LONG}, {_SHIFT.format(w='')}
SELECT feature, {r6('old_mean')} AS old_mean, {r6('new_mean')} AS new_mean,
  {r6('CASE WHEN old_mean = 0 THEN 0 ELSE (new_mean - old_mean) / abs(old_mean) * 100 END')} AS shift_pct FROM m""")
def q_shift(spark, sf):
    """Relative mean shift in percent (0 when the old mean is 0)."""
    return DR.mean_shift(SC.melt(base(spark, sf), ["page_id", "era"], BASE_28), "era", "old", "new")


@register("drift_top_bottom", sql=f"""WITH {LONG},
n AS (SELECT count(*) FILTER (WHERE era = 'old') / 28 AS n_old, count(*) FILTER (WHERE era = 'new') / 28 AS n_new FROM lg),
c AS (SELECT feature, value, count(*) FILTER (WHERE era = 'old') AS o, count(*) FILTER (WHERE era = 'new') AS w FROM lg GROUP BY feature, value),
e AS (SELECT feature, sum(o) OVER (PARTITION BY feature ORDER BY value) / n_old AS fo,
  sum(w) OVER (PARTITION BY feature ORDER BY value) / n_new AS fw FROM c, n),
k AS (SELECT feature, max(abs(fo - fw)) AS ks FROM e GROUP BY feature),
r AS (SELECT *, row_number() OVER (ORDER BY round(ks, 9), feature) AS r_stable, row_number() OVER (ORDER BY round(ks, 9) DESC, feature) AS r_drift FROM k)
SELECT 'stable' AS side, feature, {r6('ks')} AS ks, r_stable::BIGINT AS rank FROM r WHERE r_stable <= 15
UNION ALL SELECT 'drifted', feature, {r6('ks')}, r_drift::BIGINT FROM r WHERE r_drift <= 15""")
def q_topbottom(spark, sf):
    """15 most stable and 15 most drifted features by KS."""
    ks = DR.ks_drift(SC.melt(base(spark, sf), ["page_id", "era"], BASE_28), "era", "old", "new")
    return DR.top_bottom(ks, "ks", 15)


@register("mean_shift_filter", sql=f"""WITH {LONG}, {_SHIFT.format(w='WHERE label = 0')},
s AS (SELECT feature, old_mean, new_mean, CASE WHEN old_mean = 0 THEN (CASE WHEN new_mean > 0 THEN 'inf'::DOUBLE ELSE 0 END)
  ELSE (new_mean - old_mean) / old_mean * 100 END AS shift_pct FROM m)
SELECT feature, {r6('old_mean')} AS old_mean, {r6('new_mean')} AS new_mean, {r6('shift_pct')} AS shift_pct FROM s WHERE abs(shift_pct) > 50""")
def q_shift_filter(spark, sf):
    """I4: legitimate-page features whose mean moved by more than 50 %."""
    b = base(spark, sf).where("label = 0")
    return DR.mean_shift_filter(SC.melt(b, ["page_id", "era"], BASE_28), "era", "old", "new", 50.0)


@register("era_class_means", sql=f"""WITH {LONG}
SELECT era, label::BIGINT AS label, feature, round(avg(value), 3) AS mean FROM lg GROUP BY era, label, feature""")
def q_ecm(spark, sf):
    """Feature means by era and class, 3 decimals."""
    long = SC.melt(base(spark, sf), ["era", "label"], BASE_28)
    return long.groupBy("era", "label", "feature").agg(F.round(F.avg("value"), 3).alias("mean"))


@register("binary_proportions", sql=f"""WITH {LONG}
SELECT label::BIGINT AS label, feature, {r6('avg(CASE WHEN value > 0 THEN 100.0 ELSE 0.0 END)')} AS pct_positive
FROM lg WHERE feature IN ({S.qlist(FLAGS)}) GROUP BY label, feature""")
def q_binprop(spark, sf):
    """Percent of rows with a flag above 0, by class."""
    long = SC.melt(base(spark, sf).select("label", *FLAGS), ["label"], FLAGS)
    return long.groupBy("label", "feature").agg(F.avg(F.when(F.col("value") > 0, 100.0).otherwise(0.0)).alias("pct_positive"))


@register("class_averages", sql=f"""WITH {LONG}
SELECT label::BIGINT AS label, feature, {r6('avg(value)')} AS mean, count(*)::BIGINT AS n FROM lg GROUP BY label, feature""")
def q_classavg(spark, sf):
    """I8: mean of each feature by class."""
    return DR.class_averages(base(spark, sf), BASE_28, "label")


_CVP = ["url_num_subdomains", "url_path_depth", "dom_depth"]


@register("class_value_proportion", sql=f"""WITH {LONG}
SELECT label::BIGINT AS label, feature, {r6('value')} AS value, count(*)::BIGINT AS count,
  {r6('count(*) / sum(count(*)) OVER (PARTITION BY label, feature)')} AS share
FROM lg WHERE feature IN ({S.qlist(_CVP)}) GROUP BY label, feature, value""")
def q_cvp(spark, sf):
    """Share of each value within its class, for discrete features."""
    long = SC.melt(base(spark, sf).select("label", *_CVP), ["label"], _CVP)
    return DR.class_value_proportion(long)


@register("describe_by_class", sql=f"""WITH {LONG}
SELECT label::BIGINT AS label, feature, count(*)::BIGINT AS count, {r6('avg(value)')} AS mean, {r6('stddev_samp(value)')} AS std,
  {r6('min(value)')} AS min, {r6('quantile_cont(value, 0.25)')} AS p25, {r6('quantile_cont(value, 0.5)')} AS p50,
  {r6('quantile_cont(value, 0.75)')} AS p75, {r6('max(value)')} AS max FROM lg GROUP BY label, feature""")
def q_describe(spark, sf):
    """Count, mean, sd, min, quartiles, max by class."""
    return DR.describe(SC.melt(base(spark, sf), ["label"], BASE_28), ["label"])


@register("boxplot_stats", sql=f"""WITH {LONG},
q AS (SELECT label, feature, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM lg GROUP BY label, feature)
SELECT label::BIGINT AS label, feature, {r6('q1')} AS q1, {r6('q3')} AS q3, {r6('q3 - q1')} AS iqr,
  {r6('min(value) FILTER (WHERE value >= q1 - 1.5 * (q3 - q1))')} AS whisker_low,
  {r6('max(value) FILTER (WHERE value <= q3 + 1.5 * (q3 - q1))')} AS whisker_high,
  count(*) FILTER (WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1))::BIGINT AS outliers
FROM lg JOIN q USING (label, feature) GROUP BY label, feature, q1, q3""")
def q_box(spark, sf):
    """Quartiles, 1.5 IQR whiskers and outlier counts by class."""
    return DR.boxplot_stats(SC.melt(base(spark, sf), ["label"], BASE_28), ["label"])


_LV = [0.0625, 0.125, 0.25, 0.5, 0.75, 0.875, 0.9375]


@register("letter_values", sql=f"""WITH {LONG}
SELECT label::BIGINT AS label, feature, {', '.join(f"{r6(f'quantile_cont(value, {q})')} AS q_{str(q).replace('.', '_')}" for q in _LV)}
FROM lg GROUP BY label, feature""")
def q_lv(spark, sf):
    """Nested quantiles at 2^-k tails (k = 1..4)."""
    return DR.quantiles(SC.melt(base(spark, sf), ["label"], BASE_28), ["label"], _LV)


@register("histogram", sql=f"""WITH {LONG},
r AS (SELECT feature, CASE WHEN max(value) = min(value) THEN min(value) - 0.5 ELSE min(value) END AS lo,
  CASE WHEN max(value) = min(value) THEN max(value) + 0.5 ELSE max(value) END AS hi FROM lg GROUP BY feature)
SELECT label::BIGINT AS label, feature, bin::BIGINT AS bin, count(*)::BIGINT AS count FROM (
  SELECT label, feature, least(floor((value - lo) / (hi - lo) * 20), 19) AS bin FROM lg JOIN r USING (feature))
GROUP BY label, feature, bin""")
def q_hist(spark, sf):
    """20 equal-width bins per feature (shared range), counts by class."""
    return DR.histogram(SC.melt(base(spark, sf), ["label"], BASE_28), ["label"], 20)


@register("histogram_density", sql=f"""WITH {LONG},
r AS (SELECT feature, CASE WHEN max(value) = min(value) THEN min(value) - 0.5 ELSE min(value) END AS lo,
  CASE WHEN max(value) = min(value) THEN max(value) + 0.5 ELSE max(value) END AS hi FROM lg GROUP BY feature),
b AS (SELECT label, feature, lo, hi, least(floor((value - lo) / (hi - lo) * 30), 29) AS bin FROM lg JOIN r USING (feature)),
c AS (SELECT label, feature, bin, (hi - lo) / 30 AS width, count(*) AS count FROM b GROUP BY ALL)
SELECT label::BIGINT AS label, feature, bin::BIGINT AS bin, count::BIGINT AS count,
  {r6('count / (sum(count) OVER (PARTITION BY label, feature) * width)')} AS density FROM c""")
def q_hist_density(spark, sf):
    """30 bins per feature with each class's own density."""
    return DR.histogram(SC.melt(base(spark, sf), ["label"], BASE_28), ["label"], 30, density=True)


@register("value_counts_p99", sql=f"""WITH {LONG},
q AS (SELECT feature, quantile_cont(value, 0.99) AS q99 FROM lg GROUP BY feature)
SELECT label::BIGINT AS label, feature, {r6('value')} AS value, count(*)::BIGINT AS count
FROM lg JOIN q USING (feature) WHERE value <= q99 AND feature IN ({S.qlist(DISCRETE)}) GROUP BY label, feature, value""")
def q_counts_p99(spark, sf):
    """Counts of each value of the count features by class, up to the feature's 0.99 quantile."""
    return DR.value_counts(SC.melt(base(spark, sf), ["label"], DISCRETE), ["label"], 0.99)


@register("pearson_corr", sql=f"""WITH {LONG},
lv AS (SELECT page_id, feature, value FROM lg UNION ALL SELECT page_id, 'label', label FROM f),
tv AS (SELECT feature FROM (SELECT feature, row_number() OVER (ORDER BY round(var_samp(value), 9) DESC, feature) AS r FROM lg GROUP BY feature) WHERE r <= 15
       UNION ALL SELECT 'label'),
x AS (SELECT * FROM lv WHERE feature IN (SELECT feature FROM tv))
SELECT a.feature AS feature_a, b.feature AS feature_b,
  {r6('CASE WHEN stddev_pop(a.value) * stddev_pop(b.value) = 0 THEN NULL ELSE covar_pop(a.value, b.value) / (stddev_pop(a.value) * stddev_pop(b.value)) END')} AS corr
FROM x a JOIN x b ON a.page_id = b.page_id AND a.feature > b.feature GROUP BY a.feature, b.feature""")
def q_pearson(spark, sf):
    """Pearson correlation, top-15-variance features + class, lower triangle."""
    b = base(spark, sf)
    top = [r["feature"] for r in DR.top_variance(SC.melt(b, ["page_id"], BASE_28), 15).collect()]  # 15 names
    return DR.pairwise_corr(b.withColumn("label", F.col("label").cast("double")), top + ["label"])


_SP = BASE_28[:26]


_SP_PAIRS = [(max(x, y), min(x, y)) for i, x in enumerate(_SP) for y in _SP[:i]]


@register("spearman_corr", sql=f"""WITH {BASE},
rk AS (SELECT {', '.join(f"(rank() OVER (ORDER BY round({c}, 9)) + count(*) OVER (ORDER BY round({c}, 9))) / 2.0 AS {c}" for c in _SP)} FROM f)
SELECT a AS feature_a, b AS feature_b, {r6('c')} AS corr FROM (
  {' UNION ALL '.join(f"SELECT '{a}' AS a, '{b}' AS b, CASE WHEN stddev_pop({a}) * stddev_pop({b}) = 0 THEN NULL ELSE covar_pop({a}, {b}) / (stddev_pop({a}) * stddev_pop({b})) END AS c FROM rk" for a, b in _SP_PAIRS)})""")
def q_spearman(spark, sf):
    """I16: Spearman rank correlation (mid-ranks) of the first 26 base features."""
    return DR.spearman(base(spark, sf), _SP)


@register("radar_profile", sql=f"""WITH {BASE},
st AS (SELECT {', '.join(f"min({c}) AS lo_{c}, max({c}) AS hi_{c}" for c in BASE_28)} FROM f),
n AS (SELECT label, {', '.join(f"CASE WHEN hi_{c} = lo_{c} THEN 0.0 ELSE ({c} - lo_{c}) / (hi_{c} - lo_{c}) END AS {c}" for c in BASE_28)} FROM f, st),
m AS (SELECT label, {', '.join(f"avg({c}) AS {c}" for c in BASE_28)} FROM n GROUP BY label)
{' UNION ALL '.join(f"SELECT label::BIGINT AS label, '{k}' AS category, {r6('(' + ' + '.join(v) + f') / {len(v)}')} AS score FROM m" for k, v in RADAR.items())}""")
def q_radar(spark, sf):
    """Min-max scaled mean per feature group and class (mean of means)."""
    return DR.radar_profile(base(spark, sf), BASE_28, RADAR)


@register("standardised_gap", sql=f"""WITH {LONG},
s AS (SELECT feature, avg(value) AS mu, stddev_samp(value) AS sd FROM lg GROUP BY feature),
g AS (SELECT feature, avg(CASE WHEN sd = 0 OR sd IS NULL THEN 0 ELSE (value - mu) / sd END) FILTER (WHERE label = 1)
   - avg(CASE WHEN sd = 0 OR sd IS NULL THEN 0 ELSE (value - mu) / sd END) FILTER (WHERE label = 0) AS gap FROM lg JOIN s USING (feature) GROUP BY feature)
SELECT feature, {r6('gap')} AS gap, row_number() OVER (ORDER BY round(abs(gap), 9) DESC, feature)::BIGINT AS rank FROM g""")
def q_gap(spark, sf):
    """Class-mean gap after z-scoring with the sample sigma, ranked."""
    return DR.standardised_gap(SC.melt(base(spark, sf), ["label"], BASE_28))


@register("length_vs_entropy", sql=f"""WITH {BASE}
SELECT page_id, label::BIGINT AS label, {r6('url_length')} AS url_length, {r6('url_entropy')} AS url_entropy FROM f""")
def q_lve(spark, sf):
    """URL length vs entropy pairs."""
    return base(spark, sf).select("page_id", "label", "url_length", "url_entropy")


@register("era_shift_quantile_view", sql=f"""WITH {BASE},
l AS (SELECT era, url_length, url_num_special_chars FROM f WHERE label = 0),
p AS (SELECT quantile_cont(url_length, 0.95) AS p_len, quantile_cont(url_num_special_chars, 0.95) AS p_sp FROM l)
SELECT era, 'url_length' AS feature, {r6('quantile_cont(url_length, 0.25)')} AS q1, {r6('quantile_cont(url_length, 0.5)')} AS median,
  {r6('quantile_cont(url_length, 0.75)')} AS q3, count(*)::BIGINT AS n FROM l, p WHERE url_length <= p_len GROUP BY era
UNION ALL SELECT era, 'url_num_special_chars', {r6('quantile_cont(url_num_special_chars, 0.25)')}, {r6('quantile_cont(url_num_special_chars, 0.5)')},
  {r6('quantile_cont(url_num_special_chars, 0.75)')}, count(*)::BIGINT FROM l, p WHERE url_num_special_chars <= p_sp GROUP BY era""")
def q_eraq(spark, sf):
    """URL length / special chars of legitimate pages by era, up to the
    pooled 95th percentile, quartiles."""
    b = base(spark, sf).where("label = 0")
    return DR.era_shift_quantile_view(b, "era", ["url_length", "url_num_special_chars"], 0.95)


@register("dataset_class_counts", sql=f"""WITH {PAGES_L}
SELECT era, label::BIGINT AS label, count(*)::BIGINT AS count FROM pages_l GROUP BY era, label""")
def q_dcc(spark, sf):
    """Rows by era and class."""
    return catalog.pages(spark, sf).groupBy("era", "label").agg(F.count(F.lit(1)).alias("count"))


_KDE = ["url_length", "url_entropy", "html_length", "html_text_ratio", "dom_depth"]


@register("kde_curve", sql=f"""WITH {LONG},
l AS (SELECT * FROM lg WHERE feature IN ({S.qlist(_KDE)})),
d AS (SELECT label, feature, value, count(*) AS c FROM l GROUP BY label, feature, value),
st AS (SELECT label, feature, count(*) AS n, stddev_samp(value) * pow(count(*)::DOUBLE, -0.2) AS h FROM l GROUP BY label, feature),
rg AS (SELECT feature, min(value) AS lo, max(value) AS hi FROM l GROUP BY feature),
x AS (SELECT d.label, d.feature, i, lo + i * (hi - lo) / 99 AS gx, c * exp(-0.5 * pow((lo + i * (hi - lo) / 99 - value) / h, 2)) AS k, n, h
      FROM d JOIN st USING (label, feature) JOIN rg USING (feature), range(100) r(i) WHERE h > 0)
SELECT label::BIGINT AS label, feature, i::BIGINT AS i, {r6('gx')} AS x, {r6('sum(k) / (n * h * sqrt(2 * pi()))')} AS density
FROM x GROUP BY label, feature, i, gx, n, h""")
def q_kde(spark, sf):
    """Per-class Gaussian KDE of five continuous features on 100 points."""
    long = SC.melt(base(spark, sf).select("label", *_KDE), ["label"], _KDE)
    return DR.kde_curve(long, ["label"], 100)


@register("export_features", sql=f"""WITH {BASE}
SELECT page_id, label::BIGINT AS label, {', '.join(f"{r6(c)} AS {c}" for c in BASE_28)} FROM f""")
def q_export(spark, sf):
    """Feature rows + label written as CSV to the shared folder and read back."""
    import time as _t
    from pyspark.sql import types as T
    from pagelab.session import scratch_path
    from pagelab.sources.pages import write_table
    b = base(spark, sf).select("page_id", "label", *BASE_28)
    path = scratch_path(spark, f"export_{int(_t.time() * 1000)}")
    write_table(b, path, fmt="csv")
    schema = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("label", T.IntegerType())] +
                          [T.StructField(c, T.DoubleType()) for c in BASE_28])
    return spark.read.schema(schema).option("header", "true").csv(path)


@register("bhattacharyya_overlap", sql=f"""WITH {BASE},
r AS (SELECT era, url_length AS x0, html_text_ratio AS y0 FROM f),
zs AS (SELECT avg(x0) AS mx, CASE WHEN stddev_pop(x0) = 0 THEN 1 ELSE stddev_pop(x0) END AS sx,
              avg(y0) AS my, CASE WHEN stddev_pop(y0) = 0 THEN 1 ELSE stddev_pop(y0) END AS sy FROM r),
z AS (SELECT era, (x0 - mx) / sx AS x, (y0 - my) / sy AS y FROM r, zs),
st AS (SELECT era, var_samp(x) * pow(count(*)::DOUBLE, -1.0 / 3.0) AS a, var_samp(y) * pow(count(*)::DOUBLE, -1.0 / 3.0) AS d,
              covar_samp(x, y) * pow(count(*)::DOUBLE, -1.0 / 3.0) AS b FROM z GROUP BY era),
inv AS (SELECT era, d / (a * d - b * b) AS ixx, a / (a * d - b * b) AS iyy, -b / (a * d - b * b) AS ixy FROM st),
rg AS (SELECT min(x) - 1 AS x0, max(x) + 1 AS x1, min(y) - 1 AS y0, max(y) + 1 AS y1 FROM z),
pts AS (SELECT era, x, y, count(*) AS c FROM z GROUP BY era, x, y),
g AS (SELECT k, x0 + (k // 100) * (x1 - x0) / 99 AS gx, y0 + (k % 100) * (y1 - y0) / 99 AS gy FROM rg, range(10000) t(k)),
zz AS (SELECT pts.era, g.k, sum(c * exp(-0.5 * ((gx - x) * (gx - x) * ixx + 2 * (gx - x) * (gy - y) * ixy + (gy - y) * (gy - y) * iyy))) AS z
       FROM pts JOIN inv USING (era), g GROUP BY pts.era, g.k),
p AS (SELECT era, k, z / sum(z) OVER (PARTITION BY era) AS p FROM zz)
SELECT {r6('sum(sqrt(o.p * w.p))')} AS bhattacharyya FROM p o JOIN p w ON o.k = w.k AND o.era = 'old' AND w.era = 'new'""")
def q_bhatt(spark, sf):
    """2-D KDE overlap of the eras on (URL length, HTML text ratio), z-scored."""
    return DR.bhattacharyya_overlap(base(spark, sf), "era", "old", "new", "url_length", "html_text_ratio", 100)
