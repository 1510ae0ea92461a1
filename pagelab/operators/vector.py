"""the 163-column structural vector (28 clipped base columns, 50 tag
TF-IDF, 25 XPath TF-IDF, 3 x 20 zone TF-IDF), z-scored.

Fitting runs a handful of aggregates (clip bounds, five vocabularies, column
statistics); the fitted state is small and bounded by the configured sizes
(28 bounds, at most 135 vocabulary terms, 163 means and sigmas). Applying it
is a single narrow projection: the vocabularies are literal arrays, term
counts are taken inside each row, so scoring new pages needs no shuffle.
"""

from __future__ import annotations

import json
import math

from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelab.functions import dom as DF
from pagelab.operators import scale as SC, text as T
from pagelab.operators.features import BASE_28, structural_base


def _tokens(df: DataFrame, key: str, keep=()) -> DataFrame:
    """Tag list ``_t`` and XPath list ``_x`` per page (plus ``keep`` columns), of which the term lists are made."""
    keep = list(keep)
    x = DF.with_events(df.select(key, "html", *keep), "html", "_ev").withColumn("_paths", F.expr(DF.xpath_sql("_ev")))
    return x.select(key, *keep, DF.tag_sequence("html").alias("_t"), F.expr(DF.xpath_below_root_sql("_paths")).alias("_x"))


def _grams(tokens: DataFrame, key: str, keep=()) -> DataFrame:
    """Term lists of the five TF-IDF blocks per page (plus ``keep`` columns) from :func:`_tokens`."""
    z1, z2, z3 = DF.spatial_zones("_t")
    return tokens.select(key, *keep,
                         T.word_ngrams("_t", 2, 3).alias("g_tag"), T.word_ngrams("_x", 2, 3).alias("g_xpath"),
                         T.word_ngrams(z1, 1, 2).alias("g_z1"), T.word_ngrams(z2, 1, 2).alias("g_z2"),
                         T.word_ngrams(z3, 1, 2).alias("g_z3"))


BLOCKS = [("g_tag", "tag_tfidf_", 50), ("g_xpath", "xpath_tfidf_", 25),
          ("g_z1", "z1_tfidf_", 20), ("g_z2", "z2_tfidf_", 20), ("g_z3", "z3_tfidf_", 20)]


def tfidf_in_row(grams: Column, terms: list[str], idfs: list[float]) -> Column:
    """L2-normalised TF-IDF of one document over a literal vocabulary."""
    if not terms:
        return F.array().cast("array<double>")
    from pagelab.functions.url import bind
    tv = F.array(*[F.lit(t) for t in terms])
    iv = F.array(*[F.lit(float(i)) for i in idfs])

    def weights(known):
        tf = F.transform(tv, lambda t: F.size(F.filter(known, lambda g: g == t)).cast("double"))
        return F.zip_with(tf, iv, lambda a, b: a * b)

    def normalise(w):
        norm = F.sqrt(F.aggregate(w, F.lit(0.0), lambda acc, x: acc + x * x))
        return F.transform(w, lambda x: F.when(norm > 0, x / norm).otherwise(F.lit(0.0)))
    # one hashed look-up a gram leaves those of the vocabulary, which are then counted term by term
    return bind(bind(F.filter(grams, lambda g: g.isin(terms)), weights), normalise)


def base_and_tokens(df: DataFrame, key: str, keep=(), brand: str = "difflib") -> DataFrame:
    """One narrow pass: the 28 base columns (brand discrepancy by the sequence
    ratio, or as ``structural_base`` names it) and the two token lists per page."""
    x = df.select(key, "url", "html", F.col("html").alias("_h"), *keep)
    b = structural_base(x, keep=(key, "_h", *keep), brand=brand).withColumnRenamed("_h", "html")
    return _tokens(b, key, keep=[*BASE_28, *keep])


def base_and_grams(df: DataFrame, key: str, keep=(), brand: str = "difflib") -> DataFrame:
    """The 28 base columns and the five term lists per page."""
    return _grams(base_and_tokens(df, key, keep, brand), key, keep=[*BASE_28, *keep])


class StructuralModel:
    def __init__(self, bounds, vocabs, mean=None, sd=None, key="page_id", brand="difflib"):
        self.bounds, self.vocabs, self.mean, self.sd, self.key, self.brand = bounds, vocabs, mean, sd, key, brand

    def feature_names(self) -> list[str]:
        names = list(BASE_28)
        for col, prefix, _ in BLOCKS:
            names += [prefix + t for t, _ in self.vocabs[col]]
        return names

    def vector(self, g: DataFrame, keep=()) -> DataFrame:
        """Raw 163-column array from a frame holding the 28 base columns and
        the five term lists (see :func:`_grams`)."""
        clipped = [F.least(F.col(c), F.lit(float(u))) for c, u in zip(BASE_28, self.bounds)]
        blocks = [tfidf_in_row(F.col(col), [t for t, _ in self.vocabs[col]], [i for _, i in self.vocabs[col]])
                  for col, _, _ in BLOCKS]
        return g.select(self.key, *keep, F.concat(F.array(*clipped), *blocks).alias("raw"))

    def raw(self, df: DataFrame, keep=()) -> DataFrame:
        return self.vector(base_and_grams(df, self.key, keep, self.brand), keep)

    def transform(self, df: DataFrame, keep=()) -> DataFrame:
        """(key, keep columns, features): the z-scored vector of every page."""
        return self.scaled(self.raw(df, keep), keep)

    def scaled(self, r: DataFrame, keep=()) -> DataFrame:
        """(key, keep columns, features) from the raw vectors."""
        m = F.array(*[F.lit(float(x)) for x in self.mean])
        s = F.array(*[F.lit(float(x)) for x in self.sd])
        z = F.zip_with(F.zip_with("raw", m, lambda x, a: x - a), s, lambda x, d: x / d)
        return r.select(self.key, *keep, z.alias("features"))

    def save(self, spark, path: str) -> None:
        """Write the state as a one-row text table (any file system Spark writes)."""
        state = json.dumps({"bounds": self.bounds, "vocabs": self.vocabs, "mean": self.mean, "sd": self.sd, "key": self.key,
                            "brand": self.brand})
        spark.createDataFrame([(state,)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, spark, path: str) -> "StructuralModel":
        s = json.loads(spark.read.text(path).first()["value"])  # one row: the bounded state
        return cls(s["bounds"], {k: [tuple(x) for x in v] for k, v in s["vocabs"].items()}, s["mean"], s["sd"], s["key"], s["brand"])


class StructuralFeaturizer:
    """fit(pages) -> StructuralModel; pages need ``key``, ``url``, ``html``."""

    def __init__(self, key: str = "page_id", clip_q: float = 0.99, brand: str = "difflib"):
        self.key, self.clip_q, self.brand = key, clip_q, brand

    def fit(self, pages: DataFrame) -> StructuralModel:
        return self._fitted(pages, ())[0]

    def fit_transform(self, pages: DataFrame, keep=()) -> tuple[StructuralModel, DataFrame]:
        """The fitted model and what its ``transform`` gives for the same pages, which are looked through once."""
        model, raw = self._fitted(pages, keep)
        return model, model.scaled(raw, keep)

    def _fitted(self, pages: DataFrame, keep) -> tuple[StructuralModel, DataFrame]:
        """The model and the raw vectors of its pages. The extraction and the vectors are tables in the
        shared folder: every step reads the columns it needs, and no executor has to hold them."""
        from pagelab.operators.models import _written
        k = self.key
        x = _written(base_and_tokens(pages, k, keep, self.brand))  # the one heavy pass
        ub = SC.clip_fit(x, BASE_28, self.clip_q).first()  # one row of 28 bounds
        bounds = [float(ub[f"{c}__ub"]) for c in BASE_28]
        # the five vocabularies in ONE grouped job (block = group)
        blocks = F.array(*[F.struct(F.lit(col).alias("block"), F.col(col).alias("g")) for col, _, _ in BLOCKS])
        d = _grams(x, k).select(k, F.explode(blocks).alias("s")).select("s.block", k, "s.g")
        limits = {col: size for col, _, size in BLOCKS}
        v = T.tfidf_fit(d, k, "g", max(limits.values()), groups=["block"], limits=limits).collect()  # <= 135 rows
        vocabs = {col: [(r["term"], float(r["idf"])) for r in sorted((r for r in v if r["block"] == col),
                                                                      key=lambda r: r["idx"])]
                  for col, _, _ in BLOCKS}
        model = StructuralModel(bounds, vocabs, key=k, brand=self.brand)
        raw = _written(model.vector(_grams(x, k, keep=[*BASE_28, *keep]), keep))
        n = len(model.feature_names())
        # one pass for all columns; Summarizer's variance is the sample's
        st = (raw.select(array_to_vector("raw").alias("v"))
              .agg(Summarizer.metrics("mean", "variance", "count").summary(F.col("v")).alias("s")).first()["s"])
        pages_n = int(st["count"])
        model.mean = [float(x) for x in st["mean"]] if pages_n else [0.0] * n
        sd = [math.sqrt(max(0.0, float(x)) * (pages_n - 1) / pages_n) for x in st["variance"]] if pages_n else [0.0] * n
        model.sd = [1.0 if math.isclose(x, 0.0, abs_tol=1e-12) else x for x in sd]
        return model, raw
