"""G: classifiers on Spark ML, stacking, kernel SVM, k-NN, and the
name -> estimator registry (M1/M2).

Models train with Spark ML; forests and boosted trees are this package's (``bagged``,
``boost``; the driver only holds the fitted trees). Stacks are
built from DataFrame pieces: a fold column (class-balanced, hash-seeded), out-of-fold
expert probabilities, a meta learner on top, experts refitted on all rows. The experts
of all folds are fitted in common passes over the rows.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC, LinearSVCModel, LogisticRegression, LogisticRegressionModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler, VectorSlicer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelab.operators.bagged import BaggedForest
from pagelab.operators.boost import Boosted, HistBooster, HistBoosterModel, Settings, Spec, fit_many
from pagelab.operators.forest import _matrix
from pagelab.operators.neighbours import nearest
from pagelab.operators.network import Layer, ReluNetwork
from pagelab.operators.sample import stratified_kfold

# ---------------------------------------------------------------------------
# Fixed hyper-parameters of the reference configurations. (Forests have no "least
# rows to split a node"; 5 of them are met as nearly by 1 row per leaf as by 2.)
# ---------------------------------------------------------------------------
RF_STRUCTURAL = dict(numTrees=200, maxDepth=20, minInstancesPerNode=1)
RF_URL = dict(numTrees=100, maxDepth=15, minInstancesPerNode=1)
GB_STRUCTURAL = dict(rounds=200, depth=5, rate=0.1, second_order=False, reg_lambda=0.0)
XGB_STRUCTURAL = dict(rounds=200, depth=5, rate=0.1)
XGB_REGULARISED = dict(rounds=250, depth=8, rate=0.05, row_share=0.8, column_share=0.8)
XGB_META = dict(rounds=300, depth=6, rate=0.05)
XGB_URL_EXPERT = dict(rounds=200, depth=6, rate=0.1)
XGB_HTML_EXPERT = dict(rounds=200, depth=8, rate=0.1)
FEW_SHOT = dict(sizes=(10, 20, 50, 100, 200), seeds=5, trees=50, neighbours=5, old_rows=3000)
DNN_STRUCTURAL = dict(layers=[Layer(128, True, 0.3), Layer(64, True, 0.3), Layer(32)], epochs=15, batch=128, rate=0.001)
DNN_FEW_SHOT = dict(layers=[Layer(64, False, 0.2), Layer(32, False, 0.2), Layer(16)], epochs=3, batch=256, rate=0.001)
URL_EXPERT_COLS = 10
# ---------------------------------------------------------------------------


def prob1(col: str = "probability"):
    """P(class 1) from a probability vector column."""
    return vector_to_array(F.col(col))[1]


def assemble(df: DataFrame, cols: list[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=cols, outputCol=out, handleInvalid="keep").transform(df)


def prepend(df: DataFrame, scalar: str, vector: str = "features", out: str = "features") -> DataFrame:
    """``out`` = [scalar, *vector], of any vector width."""
    return df.withColumn(out, array_to_vector(F.concat(F.array(F.col(scalar)), vector_to_array(F.col(vector)))))


# ------------------------------------------------------------------ registry
def _rf(**kw):
    return BaggedForest(**{"seed": 42, **RF_STRUCTURAL, **kw})


def _booster(**fixed):
    return lambda **kw: HistBooster(**{**fixed, **kw})


def _lr(**kw):
    return LogisticRegression(**{"maxIter": 100, **kw})


MODEL_REGISTRY = {
    "structural_rf": _rf,
    "url_rf": lambda **kw: _rf(**{**RF_URL, **kw}),
    "structural_gb": _booster(**GB_STRUCTURAL),
    "structural_xgb": _booster(**XGB_STRUCTURAL),
    "boosted_trees": _booster(**XGB_REGULARISED),  # the same class under a second name
    "logistic_regression": _lr,
    "structural_dnn": lambda **kw: ReluNetwork(**{**DNN_STRUCTURAL, **kw}),
    "few_shot_dnn": lambda **kw: ReluNetwork(**{**DNN_FEW_SHOT, **kw}),
    "structural_stacking": lambda n_features=163, **kw: FusionStack(n_features, "late", **kw),
    "mid_fusion_xgb": lambda n_features=163, **kw: FusionStack(n_features, "mid", **kw),
    "hybrid_svm_knn": lambda n_features=48, **kw: SvmKnn(n_features, **kw),
}


def create_model(name: str, **params):
    """M2: estimator by name; unknown names raise ValueError."""
    if name not in MODEL_REGISTRY:
        raise ValueError(f"no estimator is registered as {name!r}; names: {', '.join(sorted(MODEL_REGISTRY))}")
    return MODEL_REGISTRY[name](**params)


def merge_settings(model_cfg: dict, global_cfg: dict, keys=("batch_size", "epochs", "random_seed")) -> dict:
    """M3: a model setting inherits the global value only when unset."""
    out = dict(model_cfg)
    for k in keys:
        if k not in out and k in global_cfg:
            out[k] = global_cfg[k]
    return out


# ------------------------------------------------------------------ stacking
def _slice(df, idx, out):
    return VectorSlicer(inputCol="features", outputCol=out, indices=list(idx)).transform(df)


def _context():
    return SparkSession.getActiveSession()


def _written(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again."""
    import uuid

    from pagelab.session import scratch_path
    path = scratch_path(df.sparkSession, f"ml_{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _probabilities(df: DataFrame, experts: dict[int, tuple[Boosted, ...]], fold: str | None = None) -> DataFrame:
    """``df`` with the array ``_p`` of P(class 1) by each expert: those of the row's own fold,
    or of key -1 where ``fold`` is not given. One Arrow pass whatever the number of experts."""
    shared = df.sparkSession.sparkContext.broadcast({k: [b.forest for b in e] for k, e in experts.items()})
    width = next(iter(experts.values()))[0].width

    @F.pandas_udf("array<double>")
    def of(v: pd.Series, k: pd.Series) -> pd.Series:
        x, k = _matrix(v, width), k.to_numpy()
        out = [None] * len(x)
        for one in np.unique(k):
            at = np.flatnonzero(k == one)
            margin = np.stack([f.score(x[at]) for f in shared.value[int(one)]], axis=1)
            for i, p in zip(at.tolist(), 1 / (1 + np.exp(-margin))):
                out[i] = p
        return pd.Series(out, dtype=object)

    return df.withColumn("_p", of(vector_to_array("features"), F.col(fold) if fold else F.lit(-1)))


class FusionStack:
    """G4 (late fusion: meta = LR on [p_url, p_html]) and G5 (mid fusion:
    meta = boosted trees on [p_url, p_html] + raw features). The experts are boosted
    trees; ``expert`` puts any other estimator in their place."""

    def __init__(self, n_features: int, mode: str = "late", folds: int = 5, expert=None, meta=None,
                 key: str = "page_id", label: str = "label", url: dict | None = None, html: dict | None = None):
        self.n, self.mode, self.folds, self.key, self.label = n_features, mode, folds, key, label
        self.expert, self.url, self.html = expert, url or XGB_URL_EXPERT, html or XGB_HTML_EXPERT
        self.meta = meta or (lambda: _lr() if mode == "late" else HistBooster(key=key, **XGB_META))

    # experts -----------------------------------------------------------------
    def _boosted(self, df: DataFrame, folds) -> dict[int, tuple[Boosted, Boosted]]:
        """URL and HTML expert of each of ``folds`` (without its rows; -1: of all rows), fitted together."""
        specs = [Spec(Settings(**s), cols, None if k < 0 else k) for k in folds
                 for s, cols in ((self.url, tuple(range(URL_EXPERT_COLS))), (self.html, tuple(range(URL_EXPERT_COLS, self.n))))]
        got = fit_many(df, specs, self.label, "features", self.key, fold="fold" if "fold" in df.columns else None)
        return {k: (got[2 * i], got[2 * i + 1]) for i, k in enumerate(folds)}

    def _other(self, df: DataFrame):
        """URL and HTML experts of any kind, fitted as two concurrent Spark jobs."""
        from concurrent.futures import ThreadPoolExecutor
        made = []
        for cols, out, p in ((range(URL_EXPERT_COLS), "f_url", "p_u"), (range(URL_EXPERT_COLS, self.n), "f_html", "p_h")):
            e = self.expert().setFeaturesCol(out).setLabelCol(self.label).setProbabilityCol(p)
            made.append((e.setPredictionCol(f"y_{p}").setRawPredictionCol(f"r_{p}"), _slice(df, cols, out)))
        with ThreadPoolExecutor(max_workers=2) as ex:
            return tuple(ex.map(lambda t: t[0].fit(t[1]), made))

    def _apply(self, df: DataFrame, experts) -> DataFrame:
        if self.expert is None:
            x = _probabilities(df, {-1: experts})
            return x.select(*df.columns, F.col("_p")[0].alias("p_url"), F.col("_p")[1].alias("p_html"))
        x = _slice(_slice(df, range(URL_EXPERT_COLS), "f_url"), range(URL_EXPERT_COLS, self.n), "f_html")
        x = experts[1].transform(experts[0].transform(x))
        return x.select(*df.columns, prob1("p_u").alias("p_url"), prob1("p_h").alias("p_html"))

    def _meta_input(self, df):
        x = assemble(df, ["p_url", "p_html"], "_pp")
        if self.mode == "mid":
            return VectorAssembler(inputCols=["_pp", "features"], outputCol="meta_features").transform(x)
        return x.withColumnRenamed("_pp", "meta_features")

    def _crossed(self, df: DataFrame, final: bool) -> tuple[DataFrame, tuple | None]:
        """Out-of-fold probabilities of every row and, with ``final``, the experts of all rows."""
        f = _written(stratified_kfold(df, self.folds, self.label, key=self.key))  # read by every pass
        folds = list(range(self.folds))
        if self.expert is None:
            experts = self._boosted(f, [*folds, -1] if final else folds)
            x = _probabilities(f, experts, "fold")
            oof = x.select(*f.columns, F.col("_p")[0].alias("p_url"), F.col("_p")[1].alias("p_html"))
            return _written(oof), experts.get(-1)
        from concurrent.futures import ThreadPoolExecutor

        def one(k):
            return self._apply(f.where(F.col("fold") == k), self._other(f.where(F.col("fold") != k)))
        with ThreadPoolExecutor(max_workers=self.folds) as ex:  # independent fits
            parts = list(ex.map(one, folds))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return _written(out), self._other(df) if final else None

    def out_of_fold(self, df: DataFrame) -> DataFrame:
        """Expert probabilities for every row from models that did not see it."""
        return self._crossed(df, False)[0]

    def _meta(self):
        return self.meta().setFeaturesCol("meta_features").setLabelCol(self.label)

    def fit(self, df: DataFrame) -> "FusionStack":
        oof, self.experts = self._crossed(df, True)
        self.meta_model = self._meta().fit(self._meta_input(oof))
        return self

    def out_of_fold_stack(self, df: DataFrame) -> DataFrame:
        """Out-of-fold expert probabilities and, from meta models that did not
        see the row either, the stack's own probability ``p_stack``."""
        oof = self.out_of_fold(df)
        parts = None
        for k in range(self.folds):
            m = self._meta().fit(self._meta_input(oof.where(F.col("fold") != k)))
            part = m.transform(self._meta_input(oof.where(F.col("fold") == k)))
            part = part.select(self.key, self.label, "fold", "p_url", "p_html", prob1().alias("p_stack"))
            parts = part if parts is None else parts.unionByName(part)
        return parts

    def save(self, path: str) -> None:
        """Write the fitted experts and the meta model below ``path``."""
        for name, m in zip(("url", "html", "meta"), (*self.experts, self.meta_model)):
            m = HistBoosterModel(m, {"features": "features"}) if isinstance(m, Boosted) else m
            if isinstance(m, HistBoosterModel):
                m.save(_context(), f"{path}/{name}")
            else:
                m.write().overwrite().save(f"{path}/{name}")

    def load(self, path: str) -> "FusionStack":
        """Read what ``save`` wrote into this (equally configured) stack."""
        from pyspark.ml.util import DefaultParamsReader
        read = lambda n: DefaultParamsReader.loadParamsInstance(f"{path}/{n}", _context())
        boosted = lambda n: HistBoosterModel.load(_context(), f"{path}/{n}")
        self.experts = (read("url"), read("html")) if self.expert else (boosted("url").boosted, boosted("html").boosted)
        self.meta_model = boosted("meta") if self.mode == "mid" else read("meta")
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return self.meta_model.transform(self._meta_input(self._apply(df, self.experts)))


# ------------------------------------------------------------------ kernel SVM
def landmarks(df: DataFrame, n: int, col: str = "features", seed: int = 42) -> np.ndarray:
    """At most ``n`` rows that stand for all: the rows themselves where there are no more, else
    k-means centres (k-means++ in a few passes)."""
    rows = df.select(vector_to_array(F.col(col)).alias("v")).limit(n + 1).collect()  # n is a parameter
    if len(rows) > n:
        return np.array([c.tolist() for c in KMeans(k=n, seed=seed, featuresCol=col, maxIter=10).fit(df.select(col)).clusterCenters()])
    return np.unique(np.array([r["v"] for r in rows], float).reshape(len(rows), -1), axis=0)


def _rbf(x: np.ndarray, y: np.ndarray, gamma: float) -> np.ndarray:
    d = (x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * (x @ y.T)
    return np.exp(-gamma * np.maximum(d, 0.0))


class Nystroem:
    """RBF kernel features from landmark rows L: K(x, L) K(L, L)^(-1/2), whose inner products
    approximate the kernel and equal it between landmarks (Williams & Seeger 2001)."""

    def __init__(self, points: np.ndarray, gamma: float):
        self.points, self.gamma = points, gamma
        value, vector = np.linalg.eigh(_rbf(points, points, gamma))
        kept = value > 1e-10 * max(1.0, float(value.max(initial=0.0)))
        self.map = vector[:, kept] / np.sqrt(value[kept])

    def features(self, x: np.ndarray) -> np.ndarray:
        return _rbf(x, self.points, self.gamma) @ self.map

    def transform(self, df: DataFrame, col: str = "features", out: str = "kernel") -> DataFrame:
        shared, width = df.sparkSession.sparkContext.broadcast(self), self.points.shape[1]

        @F.pandas_udf("array<double>")
        def project(v: pd.Series) -> pd.Series:
            return pd.Series(list(shared.value.features(_matrix(v, width))))
        return df.withColumn(out, array_to_vector(project(vector_to_array(F.col(col)))))

    def error(self, df: DataFrame, col: str = "features", key: str = "page_id", rows: int = 200) -> float:
        """Mean absolute error of the kernel between ``rows`` rows (the smallest hashes of the key)."""
        got = df.select(vector_to_array(F.col(col)).alias("v"), F.xxhash64(key).alias("h")).orderBy("h").limit(rows).collect()
        x = np.array([r["v"] for r in got], float)
        z = self.features(x)
        return float(np.abs(z @ z.T - _rbf(x, x, self.gamma)).mean())


def scale_gamma(df: DataFrame, col: str = "features") -> float:
    """1 / (columns x variance of all entries), the kernel width that follows the data."""
    v = vector_to_array(F.col(col))
    add = lambda f: F.aggregate(v, F.lit(0.0), lambda a, x: a + f(x))
    r = df.select(F.size(v).alias("d"), add(lambda x: x).alias("s"), add(lambda x: x * x).alias("q")).agg(
        F.max("d").alias("d"), F.sum("d").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")).first()
    if not r["n"]:
        return 1.0
    var = r["q"] / r["n"] - (r["s"] / r["n"]) ** 2
    return 1.0 / (r["d"] * var) if var > 0 else 1.0


class KernelSVM:
    """RBF SVM as Nystroem kernel features of at most ``n_out`` landmarks and a linear SVM
    with loss weight C, with a sigmoid (logistic) calibration of the margin for probabilities.
    The kernel width follows the variance of the training features."""

    def __init__(self, n_in: int, n_out: int = 100, C: float = 1.0, label: str = "label", gamma: float | None = None):
        self.n_in, self.n_out, self.C, self.label, self.gamma = n_in, n_out, C, label, gamma

    def _mapped(self, df):
        return self.map.transform(df)

    @staticmethod
    def _margin(df):
        return df.withColumn("_m", array_to_vector(F.array(vector_to_array("rawPrediction")[1])))

    def fit(self, df):
        if self.gamma is None:
            self.gamma = scale_gamma(df)
        self.map = Nystroem(landmarks(df, self.n_out), self.gamma)
        x = _written(self._mapped(df).select(self.label, "kernel"))  # read by every step of both fits
        self.svm = LinearSVC(featuresCol="kernel", labelCol=self.label, regParam=1.0 / (self.C * max(1, x.count())),
                             maxIter=100, standardization=False).fit(x)
        self.cal = LogisticRegression(featuresCol="_m", labelCol=self.label, probabilityCol="svm_probability",
                                      predictionCol="svm_prediction", rawPredictionCol="svm_raw").fit(
            self._margin(self.svm.transform(x)))
        return self

    def transform(self, df):
        x = self._margin(self.svm.transform(self._mapped(df)))
        return self.cal.transform(x.drop("prediction", "rawPrediction")).withColumn("p_svm", prob1("svm_probability"))

    def save(self, path: str) -> None:
        self.svm.write().overwrite().save(f"{path}/svm")
        self.cal.write().overwrite().save(f"{path}/calibration")
        _context().createDataFrame([(self.n_in, self.n_out, float(self.gamma), self.map.points.tolist())],
                                   "n_in int, n_out int, gamma double, points array<array<double>>") \
            .write.mode("overwrite").parquet(f"{path}/kernel")

    def load(self, path: str) -> "KernelSVM":
        self.svm, self.cal = LinearSVCModel.load(f"{path}/svm"), LogisticRegressionModel.load(f"{path}/calibration")
        r = _context().read.parquet(f"{path}/kernel").first()
        self.n_in, self.n_out, self.gamma = r["n_in"], r["n_out"], r["gamma"]
        self.map = Nystroem(np.array(r["points"], float), self.gamma)
        return self


class SvmKnn:
    """Mean of the kernel SVM's probability and the k-NN vote share. The
    training rows of the k-NN stay a table; they are written by ``save``."""

    def __init__(self, n_in: int = 48, k: int = 5, key: str = "page_id", label: str = "label"):
        self.svm, self.k, self.key, self.label = KernelSVM(n_in, label=label), k, key, label

    def fit(self, df: DataFrame) -> "SvmKnn":
        self.svm.fit(df)
        self.train = df.select(self.key, self.label, vector_to_array("features").alias("v"))
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        x = self.svm.transform(df)
        near = knn_classify(self.train, df.select(self.key, vector_to_array("features").alias("v")), self.k, "v",
                            self.label, self.key, self.key).select(self.key, "share_1")
        x = x.join(near, self.key).withColumn("p1", (F.col("p_svm") + F.col("share_1")) / 2)
        return x.withColumn("prediction", (F.col("p1") > 0.5).cast("int"))

    def save(self, path: str) -> None:
        self.svm.save(f"{path}/svm")
        self.train.write.mode("overwrite").parquet(f"{path}/train")

    def load(self, path: str) -> "SvmKnn":
        self.svm.load(f"{path}/svm")
        self.train = _context().read.parquet(f"{path}/train")
        return self


# ------------------------------------------------------------------ k-NN
def knn_classify(train: DataFrame, test: DataFrame, k: int = 5, vec: str = "embedding", label: str = "label",
                 train_key: str = "vec_id", key: str = "vec_id", block_rows: int = 4_096,
                 n_pivots: int = 64) -> DataFrame:
    """Exact k nearest neighbours (Euclidean; ties by training key), majority
    vote (ties to the smaller label) and the vote share of class 1.

    Both sides are cut into blocks around pivots; pairs of blocks that the triangle
    inequality rules out never meet (``neighbours``). The nearest of the blocks that a
    test row met are merged."""
    t = train.select(F.col(train_key).cast("long").alias("_id"), F.col(label).cast("int").alias("_y"), F.col(vec).alias("_v"))
    q = test.select(F.col(key).cast("long").alias("_id"), F.col(vec).alias("_v"))
    met = nearest(t, q, k, block_rows, n_pivots)
    # at most k rows per test row and training block
    best = met.groupBy("_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "t", "y"))), 1, k).alias("_n"))
    votes = F.transform("_n", lambda s: s["y"])
    counts = F.transform(F.array_distinct(votes), lambda v: F.struct(
        (-F.size(F.filter(votes, lambda w: w == v))).alias("c"), v.alias("y")))
    return best.select(F.col("_id").alias(key), F.array_min(counts)["y"].alias("prediction"),
                       (F.size(F.filter(votes, lambda v: v == 1)) / F.size("_n")).alias("share_1"))


# ------------------------------------------------------------------ persistence
def save_pipeline(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_pipeline(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def fit_pipeline(df: DataFrame, cols: list[str], estimator) -> PipelineModel:
    return Pipeline(stages=[VectorAssembler(inputCols=cols, outputCol="features", handleInvalid="keep"),
                            estimator]).fit(df)
