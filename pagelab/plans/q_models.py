"""Registered queries G (models), H11-H21 (evaluation loops), F9/F10, J
(explanation). Training is randomised or iterative: rows-only checks, except
k-NN and the false-positive set, which have SQL oracles.

All models read one table per session and data folder: the 163 structural
columns (clipped, TF-IDF blocks, z-scored by a featuriser fitted on all pages),
written once to the shared folder. Hyper-parameters are the reference's.
"""

from __future__ import annotations

import math
import time
import uuid

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import PCA, HashingTF
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from pagelab.operators import evaluate as EV, explain as XP, forest as FO, models as M, sample as SA, search as SR
from pagelab.operators.features import BASE_28, structural_base
from pagelab.operators.vector import StructuralFeaturizer
from pagelab.plans import catalog
from pagelab.plans.q_eval import MODELS, _counts_sql
from pagelab.plans.registry import register
from pagelab.session import scratch_path
from pagelab.sources import pages as P

#: (application, data folder) -> (path of the written features, column names)
_FEATURES: dict[tuple[str, str], tuple[str, list[str]]] = {}
_SHAPLEY: dict[tuple[str, str], str] = {}


def _features(spark, sf):
    key = (spark.sparkContext.applicationId, sf)
    if key not in _FEATURES:
        model, x = StructuralFeaturizer().fit_transform(catalog.pages(spark, sf), keep=("label", "era"))
        path = scratch_path(spark, f"features_{uuid.uuid4().hex}")
        x.write.parquet(path)
        _FEATURES[key] = (path, model.feature_names())
    return _FEATURES[key]


def feats(spark, sf):
    """(page_id, label, era, features): the z-scored structural vector of every page,
    one task per 20,000 rows: learners run thousands of short jobs over it."""
    x = spark.read.parquet(_features(spark, sf)[0])
    return x.withColumn("features", array_to_vector("features")).coalesce(max(1, math.ceil(x.count() / 20_000)))


def names(spark, sf) -> list[str]:
    return _features(spark, sf)[1]


def split(df):
    s = SA.stratified_split(df, 0.2)
    return s.where("split = 'train'"), s.where("split = 'test'")


def metrics_row(pred, name: str):
    """Accuracy / weighted F1 / AUC of a prediction table (prediction, p1)."""
    p = pred.select("label", F.col("prediction").cast("int").alias("prediction"), "p1")
    m = EV.metrics_from_counts(EV.confusion_counts(p))
    a = EV.roc_auc(p, score="p1")
    return m.join(a, how="inner").select(F.lit(name).alias("model"), "accuracy", "f1_weighted", "precision_weighted",
                                         "recall_weighted", "roc_auc")  # one-row sides


def fit_eval(spark, sf, name, est):
    tr, te = split(feats(spark, sf))
    model = est.setLabelCol("label").setFeaturesCol("features").fit(tr)
    return metrics_row(model.transform(te).withColumn("p1", M.prob1()), name)


@register("random_forest")
def q_rf(spark, sf):
    """G1: random forest (200 trees, depth 20) train/test metrics."""
    return fit_eval(spark, sf, "structural_rf", M.create_model("structural_rf"))


@register("gradient_boosting")
def q_gb(spark, sf):
    """Gradient-boosted trees (200 rounds, depth 5, rate 0.1)."""
    return fit_eval(spark, sf, "structural_gb", M.create_model("structural_gb"))


@register("boosted_trees_regularised")
def q_gbr(spark, sf):
    """Second-order boosted trees with 0.8 row / feature subsampling (250 rounds, depth 8, rate 0.05)."""
    return fit_eval(spark, sf, "boosted_trees", M.create_model("boosted_trees"))


def _stack(spark, sf, mode):
    tr, te = split(feats(spark, sf))
    st = M.FusionStack(len(names(spark, sf)), mode).fit(tr)
    return metrics_row(st.transform(te).withColumn("p1", M.prob1()), f"{mode}_fusion_stack")


@register("late_fusion_stack")
def q_late(spark, sf):
    """URL expert (cols 0-9) + HTML expert (the rest), 5-fold out-of-fold
    probabilities -> logistic regression."""
    return _stack(spark, sf, "late")


@register("mid_fusion_stack")
def q_mid(spark, sf):
    """As G4 with raw features passed to a boosted meta model."""
    return _stack(spark, sf, "mid")


def _experts(tr, te, n):
    u = M._slice(tr, range(10), "fu")
    h = M._slice(tr, range(10, n), "fh")
    mu = M.create_model("url_rf").setFeaturesCol("fu").setLabelCol("label").fit(u)
    mh = M.create_model("structural_rf").setFeaturesCol("fh").setLabelCol("label").fit(h)
    x = M._slice(M._slice(te, range(10), "fu"), range(10, n), "fh")
    pu = mu.transform(x).select("page_id", "label", M.prob1().alias("p_url"))
    ph = mh.transform(M._slice(te, range(10, n), "fh")).select("page_id", M.prob1().alias("p_html"))
    return pu.join(ph, "page_id")


@register("soft_ensemble")
def q_soft(spark, sf):
    """Logistic regression over the URL and HTML expert probabilities,
    trained on the held-out split; coefficients reported."""
    tr, te = split(feats(spark, sf))
    j = M.assemble(_experts(tr, te, len(names(spark, sf))), ["p_url", "p_html"], "pp")
    lr = LogisticRegression(featuresCol="pp", labelCol="label").fit(j)
    c = lr.coefficients.toArray().tolist()
    return spark.createDataFrame([("p_url", float(c[0])), ("p_html", float(c[1])), ("intercept", float(lr.intercept))],
                                 "term string, coefficient double")


@register("kernel_svm")
def q_svm(spark, sf):
    """RBF SVM (random Fourier features + LinearSVC + calibration) on the
    z-scored vector, kernel width by its variance."""
    tr, te = split(feats(spark, sf))
    m = M.KernelSVM(len(names(spark, sf))).fit(tr)
    out = m.transform(te).withColumn("p1", F.col("p_svm")).withColumn("prediction", F.col("svm_prediction"))
    return metrics_row(out, "kernel_svm")


@register("soft_vote_svm_knn")
def q_vote(spark, sf):
    """Mean of the SVM probability and the 5-NN class-1 vote share, on the 48
    manual URL columns."""
    from pagelab.functions import url as U
    p = catalog.pages(spark, sf).select("page_id", "label", array_to_vector(U.manual_vector("url", 48)).alias("features"))
    tr, te = split(p)
    return metrics_row(M.create_model("hybrid_svm_knn").fit(tr).transform(te), "hybrid_svm_knn")


_KNN_TRAIN = "tr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r FROM embeddings) WHERE r <= 20)"


@register("knn_classify", sql=f"""WITH {_KNN_TRAIN},
te AS (SELECT * FROM embeddings WHERE vec_id NOT IN (SELECT vec_id FROM tr)),
d AS (SELECT te.vec_id, tr.label, row_number() OVER (PARTITION BY te.vec_id ORDER BY
        list_sum(list_transform(list_zip(te.embedding, tr.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) ** 2)), tr.vec_id) AS rk
      FROM te, tr),
v AS (SELECT vec_id, label, count(*) AS n FROM d WHERE rk <= 5 GROUP BY vec_id, label)
SELECT vec_id, arg_min(label, (-n, label))::BIGINT AS prediction,
  round(coalesce(sum(n) FILTER (WHERE label = 1), 0) / 5.0, 6) AS share_1 FROM v GROUP BY vec_id""")
def q_knn(spark, sf):
    """Exact 5-NN on embeddings, 20 training vectors per class (the
    first by id), every other vector classified."""
    e = P.table(spark, sf, "embeddings")
    tr = SA.exact_rank(e, "vec_id", ["label"]).where("_rank <= 20").drop("_rank")
    te = e.join(tr.select("vec_id"), "vec_id", "left_anti")
    return M.knn_classify(tr, te, 5)


@register("dense_network")
def q_mlp(spark, sf):
    """ReLU network 128-64-32 with batch normalisation and dropout on the structural vector."""
    return fit_eval(spark, sf, "structural_dnn", M.create_model("structural_dnn"))


@register("dense_network_64_32_16")
def q_mlp_small(spark, sf):
    """The few-shot base network 64-32-16, trained on the old era and tested on the new."""
    x = feats(spark, sf)
    m = M.create_model("few_shot_dnn").setLabelCol("label").fit(x.where("era = 'old'"))
    return metrics_row(m.transform(x.where("era = 'new'")).withColumn("p1", M.prob1()), "few_shot_dnn")


@register("meta_logreg")
def q_meta(spark, sf):
    """Logistic regression on [base probability, features]: the base model is
    fitted on the old era, the transfer model on a part of the new one."""
    x = feats(spark, sf)
    tr, te = split(x.where("era = 'new'"))
    base = M.create_model("structural_rf").setLabelCol("label").fit(x.where("era = 'old'"))

    def add(df):
        x = base.transform(df).withColumn("pb", M.prob1()).drop("prediction", "probability", "rawPrediction")
        return M.prepend(x, "pb")
    lr = LogisticRegression(labelCol="label", maxIter=100).fit(add(tr))
    return metrics_row(lr.transform(add(te)).withColumn("p1", M.prob1()), "meta_logreg")


@register("sequence_baseline")
def q_seq(spark, sf):
    """Hashed URL sub-words, character ids and hybrid HTML tokens -> logistic regression."""
    from pagelab.operators import text as T
    p = catalog.pages(spark, sf)
    x = p.select("page_id", "label", F.concat(
        T.url_subword_tokens("url"),
        F.transform(T.url_char_ids("url"), lambda i: F.concat(F.lit("c"), i.cast("string"))),
        F.transform(T.hybrid_tokens("html"), lambda t: F.concat(F.lit("h"), t))).alias("toks"))
    x = HashingTF(inputCol="toks", outputCol="features", numFeatures=1 << 12).transform(x).drop("toks")
    tr, te = split(M._written(x))  # pages are tokenised once, whatever the passes over the split
    m = LogisticRegression(labelCol="label", maxIter=100).fit(tr)
    return metrics_row(m.transform(te).withColumn("p1", M.prob1()), "url_sequence_lr")


@register("persist_model")
def q_persist(spark, sf):
    """Save a fitted pipeline to the shared folder, load it, score."""
    b = structural_base(catalog.pages(spark, sf), keep=("page_id", "label"))
    pm = M.fit_pipeline(b, BASE_28, M.create_model("structural_rf").setLabelCol("label"))
    path = scratch_path(spark, f"model_rf_{int(time.time() * 1000)}")
    M.save_pipeline(pm, path)
    return M.load_pipeline(path).transform(b).select("page_id", F.col("prediction").cast("int").alias("prediction"),
                                                     M.prob1().alias("p1"))


@register("cv_metrics")
def q_cv(spark, sf):
    """5-fold metrics; numeric metrics averaged, confusion cells of fold 1."""
    from concurrent.futures import ThreadPoolExecutor
    f = M._written(SA.stratified_kfold(feats(spark, sf), 5))

    def fold(k):  # independent fits, submitted as concurrent Spark jobs
        m = M.create_model("structural_rf").setLabelCol("label").fit(f.where(F.col("fold") != k))
        p = m.transform(f.where(F.col("fold") == k)).withColumn("p1", M.prob1())
        p = p.select("label", F.col("prediction").cast("int").alias("prediction"), "p1")
        c = EV.metrics_from_counts(EV.confusion_counts(p)).join(EV.roc_auc(p, score="p1"), how="inner")  # one-row sides
        return c.withColumn("fold", F.lit(k))
    with ThreadPoolExecutor(max_workers=5) as ex:
        parts = list(ex.map(fold, range(5)))
    rows = parts[0]
    for r in parts[1:]:
        rows = rows.unionByName(r)
    averaged = ["accuracy", "precision_weighted", "recall_weighted", "f1_weighted", "roc_auc"]
    return rows.groupBy(F.lit("structural_rf").alias("model")).agg(
        *[F.avg(c).alias(c) for c in averaged],
        *[F.max(F.when(F.col("fold") == 0, F.col(c))).cast("long").alias(f"fold1_{c}") for c in ("tn", "fp", "fn", "tp")],
        F.count(F.lit(1)).alias("folds"))


@register("out_of_fold_predict")
def q_oof(spark, sf):
    """Out-of-fold probabilities of both experts and of the stack, for every row."""
    st = M.FusionStack(len(names(spark, sf)), "late", expert=lambda: M.create_model("structural_rf"))
    return st.out_of_fold_stack(feats(spark, sf)).select("page_id", "label", "fold", "p_url", "p_html", "p_stack")


_F1 = ("((CASE WHEN p1 + r1 = 0 THEN 0 ELSE 2 * p1 * r1 / (p1 + r1) END) * (tp + fn)"
       " + (CASE WHEN p0 + r0 = 0 THEN 0 ELSE 2 * p0 * r0 / (p0 + r0) END) * (tn + fp)) / n")


@register("leaderboard", sql=f"""WITH {MODELS}, {_counts_sql('mp', 'model')}
SELECT model, round((tp + tn) / n, 6) AS accuracy, round({_F1}, 6) AS f1_weighted,
  round((p1 * (tp + fn) + p0 * (tn + fp)) / n, 6) AS precision_weighted,
  round((r1 * (tp + fn) + r0 * (tn + fp)) / n, 6) AS recall_weighted FROM k""")
def q_lb(spark, sf):
    """Per-model result JSON written to the shared folder, read back
    into one table with the model name from the directory."""
    from pagelab.plans.q_eval import model_scores
    ms = model_scores(spark, sf)
    m = EV.metrics_from_counts(EV.confusion_counts(ms, groups=["model"]), groups=["model"])
    root = scratch_path(spark, f"results_{int(time.time() * 1000)}")
    m.write.partitionBy("model").mode("overwrite").json(root)
    back = spark.read.json(root)
    return back.select("model", "accuracy", "f1_weighted", "precision_weighted", "recall_weighted")


@register("ood_leaderboard")
def q_ood(spark, sf):
    """Processors and models fitted on the old era, saved, loaded and applied
    to the new era."""
    p = catalog.pages(spark, sf)
    old, new = p.where("era = 'old'"), p.where("era = 'new'")
    root = scratch_path(spark, f"ood_{uuid.uuid4().hex}")
    StructuralFeaturizer().fit(old).save(spark, f"{root}/processor")
    from pagelab.operators.vector import StructuralModel
    proc = StructuralModel.load(spark, f"{root}/processor")
    n = len(proc.feature_names())

    def table(df):
        x = proc.transform(df, keep=("label",))
        return M._written(x).withColumn("features", array_to_vector("features"))
    tr, te = table(old), table(new)
    out = None
    for name in ("structural_rf", "structural_gb", "structural_xgb", "logistic_regression", "structural_stacking", "mid_fusion_xgb"):
        r = metrics_row(_reloaded(spark, name, tr, f"{root}/{name}", n).transform(te).withColumn("p1", M.prob1()), name)
        out = r if out is None else out.unionByName(r)
    return out


def _reloaded(spark, name, tr, path, n):
    """The named model fitted on ``tr``, saved below ``path`` and loaded again."""
    if name in ("structural_stacking", "mid_fusion_xgb"):
        M.create_model(name, n_features=n).fit(tr).save(path)
        return M.create_model(name, n_features=n).load(path)
    model = M.create_model(name).setLabelCol("label").fit(tr)
    if isinstance(model, M.HistBoosterModel):
        model.save(spark, path)
        return M.HistBoosterModel.load(spark, path)
    from pyspark.ml.util import DefaultParamsReader
    model.write().overwrite().save(path)
    return DefaultParamsReader.loadParamsInstance(path, spark)


@register("cross_era_matrix")
def q_cross(spark, sf):
    """Train era x test era metrics."""
    x = feats(spark, sf)
    out = None
    for a in ("old", "new"):
        m = M.create_model("structural_rf").setLabelCol("label").fit(x.where(F.col("era") == a))
        for b in ("old", "new"):
            r = metrics_row(m.transform(x.where(F.col("era") == b)).withColumn("p1", M.prob1()), "structural_rf") \
                .select(F.lit(a).alias("train_era"), F.lit(b).alias("test_era"), "accuracy", "f1_weighted", "roc_auc")
            out = r if out is None else out.unionByName(r)
    return out


def _accuracy(pred):
    return pred.agg(F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("a")).first()["a"]


def _curve(spark, sf, mixed: bool):
    """Accuracy per (N, seed, method); the independent fits run as concurrent
    Spark jobs from a small thread pool. A size that leaves no test row is left out."""
    from concurrent.futures import ThreadPoolExecutor
    x, n_in, par = feats(spark, sf), len(names(spark, sf)), M.FEW_SHOT
    old, new = x.where("era = 'old'"), x.where("era = 'new'")
    base = M.create_model("structural_rf").setLabelCol("label").fit(old)
    scored = base.transform(new).withColumn("pb", M.prob1()).drop("prediction", "probability", "rawPrediction")
    meta = M._written(M.prepend(scored.withColumnRenamed("features", "raw"), "pb", "raw").withColumn("_row", F.monotonically_increasing_id()))
    n_new = meta.count()
    meta = meta.coalesce(max(1, math.ceil(n_new / 20_000)))

    def run(task):
        n, seed = task
        s = SA.stratified_split(meta.select("_row", "page_id", "label"), train_size=n, seed=seed)
        drawn = F.col("_row").isin([r["_row"] for r in s.where("split = 'train'").select("_row").collect()])  # about n rows
        tr, te = M._written(meta.where(drawn).coalesce(1)), meta.where(~drawn)
        raw = lambda df: df.drop("features").withColumnRenamed("raw", "features")
        forest = M.create_model("structural_rf", numTrees=par["trees"], maxDepth=20, seed=seed)
        got = {}
        if mixed:
            more = SA.sample_n(old, par["old_rows"], seed).select("page_id", "label", "features")
            both = raw(tr).select("page_id", "label", "features").unionByName(more)
            return [(n, seed, "rf_mixed", _accuracy(forest.setLabelCol("label").fit(both).transform(raw(te))))]
        got["rf_scratch"] = _accuracy(forest.setLabelCol("label").fit(raw(tr)).transform(raw(te)))
        # an L2 weight of 1 over n rows is the inverse strength C = 1 of the reference's regression
        lr = LogisticRegression(labelCol="label", maxIter=1000, regParam=1.0 / n, standardization=False)
        got["meta_lr"] = _accuracy(lr.fit(tr).transform(te))
        svm = M.KernelSVM(n_in + 1).fit(tr).transform(te)
        got["meta_svm"] = _accuracy(svm.select("label", F.col("svm_prediction").alias("prediction")))
        v = lambda df: raw(df).select("page_id", "label", vector_to_array("features").alias("v"))
        near = M.knn_classify(v(tr), v(te), min(par["neighbours"], n), "v", "label", "page_id", "page_id")
        got["knn"] = _accuracy(near.join(te.select("page_id", "label"), "page_id"))
        return [(n, seed, k, a) for k, a in got.items()]

    grid = [(n, seed) for n in par["sizes"] if n < n_new for seed in range(3 if mixed else par["seeds"])]
    with ThreadPoolExecutor(max_workers=8) as ex:
        rows = [r for part in ex.map(run, grid) for r in part]
    long = spark.createDataFrame(rows, "n_samples int, seed int, method string, accuracy double")
    methods = ["rf_mixed"] if mixed else ["knn", "meta_lr", "meta_svm", "rf_scratch"]
    return long.groupBy("n_samples").pivot("method", methods).agg(F.avg("accuracy"))


@register("few_shot_curve")
def q_fewshot(spark, sf):
    """Accuracy vs N new-era training rows, five seeds and four methods: a
    forest from scratch, and logistic regression, SVM and k-NN on top of the old era."""
    return _curve(spark, sf, False)


@register("mixed_retrain_curve")
def q_mixed_curve(spark, sf):
    """A forest on N new rows and up to 3,000 old ones, three seeds."""
    return _curve(spark, sf, True)


@register("scoring_throughput")
def q_tp(spark, sf):
    """Milliseconds per scored row (timed noop write of the scoring job)."""
    x = feats(spark, sf)
    m = M.create_model("structural_rf").setLabelCol("label").fit(x)
    n = x.count()
    t0 = time.time()
    m.transform(x).write.format("noop").mode("overwrite").save()
    dt = time.time() - t0
    return spark.createDataFrame([("structural_rf", n, dt * 1000.0 / max(n, 1))], "model string, rows long, ms_per_row double")


@register("param_search")
def q_ps(spark, sf):
    """3-fold cross-validated accuracy over a grid of trees and depth; the best trial is marked."""
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
    rf = M.create_model("structural_rf").setLabelCol("label")
    grid = ParamGridBuilder().addGrid(rf.numTrees, [50, 100, 200]).addGrid(rf.maxDepth, [10, 20]).build()
    cv = CrossValidator(estimator=rf, estimatorParamMaps=grid, numFolds=3, seed=42, parallelism=4,
                        evaluator=MulticlassClassificationEvaluator(labelCol="label", metricName="accuracy")).fit(feats(spark, sf))
    best = max(range(len(grid)), key=lambda i: (cv.avgMetrics[i], -i))
    rows = [(int(pm[rf.numTrees]), int(pm[rf.maxDepth]), float(a), i == best) for i, (pm, a) in enumerate(zip(grid, cv.avgMetrics))]
    return spark.createDataFrame(rows, "num_trees int, max_depth int, cv_accuracy double, best boolean")


@register("param_search_halving")
def q_halving(spark, sf):
    """Successive halving over the space of the boosted trees, nine trials, all folds
    and trials of a rung fitted together."""
    return SR.successive_halving(feats(spark, sf), "boosted_trees")


@register("param_search_network")
def q_halving_network(spark, sf):
    """Successive halving over the space of the dense network, nine trials."""
    return SR.successive_halving(feats(spark, sf), "dense_network")


@register("pca")
def q_pca(spark, sf):
    """PCA to 2 components of the jointly z-scored eras."""
    a = vector_to_array("pc")
    return _projected(spark, sf, 2).select("page_id", "era", "label", a[0].alias("pc1"), a[1].alias("pc2"))


def _projected(spark, sf, k: int):
    from pyspark.ml.feature import StandardScaler
    x = feats(spark, sf)
    z = StandardScaler(inputCol="features", outputCol="z", withMean=True, withStd=True).fit(x).transform(x)
    return PCA(k=k, inputCol="z", outputCol="pc").fit(z).transform(z)


@register("pca_50")
def q_pca50(spark, sf):
    """PCA to 50 components of the jointly z-scored eras."""
    return _projected(spark, sf, 50).select("page_id", "era", "label", vector_to_array("pc").alias("pc"))


@register("select_by_importance")
def q_sel(spark, sf):
    """features whose booster importance is at least the median."""
    m = M.create_model("structural_gb").setLabelCol("label").fit(feats(spark, sf))
    imp = [float(v) for v in m.featureImportances.toArray()]
    order = sorted(imp)
    med = (order[(len(imp) - 1) // 2] + order[len(imp) // 2]) / 2
    rows = [(i, n, v, v >= med) for i, (n, v) in enumerate(zip(names(spark, sf), imp))]
    return spark.createDataFrame(rows, "idx int, feature string, importance double, selected boolean")


# ======================================================================= J
def _rf_model(spark, sf):
    x = feats(spark, sf)
    return x, M.create_model("structural_rf").setLabelCol("label").fit(x)


@register("feature_importance")
def q_imp(spark, sf):
    """Ranked importances of a random forest."""
    _, m = _rf_model(spark, sf)
    return XP.feature_importance(spark, m, names(spark, sf))


def _spread(x, rows: int = 64, most: int = 256):
    """Explaining a row costs far more than moving it: one task per ``rows`` rows, up to
    ``most`` where all cores have tasks (a task looks at the whole forest)."""
    n, cores = x.count(), x.sparkSession.sparkContext.defaultParallelism
    return x.repartition(max(1, math.ceil(n / most), min(math.ceil(n / rows), cores)))


def _shap(spark, sf):
    """J2 of all pages, written once per session: ranking and dependence read it."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _SHAPLEY:
        x, m = _rf_model(spark, sf)
        path = scratch_path(spark, f"shapley_{uuid.uuid4().hex}")
        FO.tree_shapley(_spread(x), m.forest, names(spark, sf), XP.background_points(x)).write.parquet(path)
        _SHAPLEY[key] = path
    return spark.read.parquet(_SHAPLEY[key])


@register("shapley_sampling")
def q_shap(spark, sf):
    """Exact interventional Shapley values of the forest's P(class 1) per row and
    feature, against five k-means centres."""
    return _shap(spark, sf)


@register("shap_global_ranking")
def q_shap_rank(spark, sf):
    """Mean |contribution| per feature and era, top 15."""
    return XP.global_ranking(_shap(spark, sf).join(feats(spark, sf).select("page_id", "era"), "page_id"), ["era"], 15)


@register("shap_dependence")
def q_shap_dep(spark, sf):
    """Value vs contribution of the top-ranked feature."""
    s = _shap(spark, sf)
    top = XP.global_ranking(s, [], 1).first()["feature"]  # one name
    vals = feats(spark, sf).select("page_id", vector_to_array("features")[names(spark, sf).index(top)].alias("value"))
    return s.where(F.col("feature") == top).join(vals, "page_id").select("page_id", "feature", "value", "contribution")


@register("shap_local")
def q_shap_local(spark, sf):
    """Contributions of the first row predicted positive, with the base value;
    no other row is explained."""
    x, m = _rf_model(spark, sf)
    first = m.transform(x).where("prediction = 1").agg(F.min("page_id").alias("_first"))  # one row
    row = x.join(F.broadcast(first), F.col("page_id") == F.col("_first"), "left_semi")
    return FO.tree_shapley(row, m.forest, names(spark, sf), XP.background_points(x)) \
        .select("page_id", "feature", "contribution", "base_value")


@register("expert_attribution")
def q_expert_attr(spark, sf):
    """Shapley ranking of the mid-fusion meta model's inputs: both expert
    probabilities and the structural columns."""
    x, cols = feats(spark, sf), names(spark, sf)
    st = M.create_model("mid_fusion_xgb", n_features=len(cols))
    inputs = st._meta_input(st.out_of_fold(x)).select("page_id", "label", F.col("meta_features").alias("features"))
    meta = M.HistBooster(**M.XGB_META).setLabelCol("label").fit(inputs)
    s = FO.tree_shapley(_spread(inputs), meta.boosted.forest, ["p_url", "p_html", *cols], XP.background_points(inputs))
    return XP.global_ranking(s, [], 15)


@register("false_positive_set", sql=f"""WITH {MODELS}
SELECT page_id, round(prob, 6) AS prob FROM mp WHERE model = 'html_logit' AND label = 0 AND prediction = 1""")
def q_fp(spark, sf):
    """Legitimate rows predicted positive by the HTML scorer."""
    from pagelab.plans.q_eval import model_scores
    ms = model_scores(spark, sf)
    return ms.where("model = 'html_logit' AND label = 0 AND prediction = 1").select("page_id", "prob")


@register("domain_shift_overlap")
def q_shift_overlap(spark, sf):
    """I5 (full form): pooled z-scoring of the structural vector, PCA to two
    components, then the 2-D KDE overlap of the eras on those components."""
    from pyspark.ml.feature import StandardScaler
    from pagelab.operators import drift as DR
    x = feats(spark, sf)
    z = StandardScaler(inputCol="features", outputCol="z", withMean=True, withStd=True).fit(x).transform(x)
    p = PCA(k=2, inputCol="z", outputCol="pc").fit(z).transform(z)
    a = vector_to_array("pc")
    pcs = p.select("era", a[0].alias("pc1"), a[1].alias("pc2"))
    return DR.bhattacharyya_overlap(pcs, "era", "old", "new", "pc1", "pc2", 100)
