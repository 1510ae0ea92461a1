"""Hyper-parameter search by successive halving.

Trials are drawn from a space by hashes of (seed, trial, name). A rung scores them by the
mean accuracy over stratified folds on a share of the rows; the best of each ``eta``
go on to a rung with ``eta`` times the rows, and the last rung takes all rows. Rows of a rung
are those whose key hashes below the share, so rungs are nested, folds stay as
they are, and a trial that runs again gives the same score. Boosted trees fit all trials and folds of
a rung in common passes; other learners are fitted as concurrent Spark jobs.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelab.operators import models as M
from pagelab.operators.boost import Settings, Spec, fit_many
from pagelab.operators.network import Layer, ReluNetwork
from pagelab.operators.sample import hash_uniform, stratified_kfold

# ---------------------------------------------------------------------------
# Search spaces. ("choice", values), ("whole", low, high),
# ("real", low, high), ("log", low, high)
# ---------------------------------------------------------------------------
NETWORK_SPACE = {
    "units": ("choice", (32, 64, 128)),
    "layers": ("whole", 1, 3),
    "dropout": ("real", 0.2, 0.6),
    "rate": ("log", 1e-4, 1e-2),
    "batch": ("choice", (32, 64, 128)),
    "epochs": ("choice", (10, 20, 30)),
}
# ---------------------------------------------------------------------------
BOOSTED_SPACE = {
    "rounds": ("choice", (100, 200, 300)),
    "depth": ("whole", 3, 8),
    "rate": ("log", 0.02, 0.3),
    "reg_lambda": ("log", 0.1, 10.0),
    "row_share": ("real", 0.6, 1.0),
    "column_share": ("real", 0.6, 1.0),
}
FOREST_SPACE = {"numTrees": ("choice", (50, 100, 200)), "maxDepth": ("whole", 5, 20)}
LOGISTIC_SPACE = {"regParam": ("log", 1e-4, 1.0), "elasticNetParam": ("real", 0.0, 1.0)}

Scores = dict[int, list[tuple[int, int]]]  # trial: (rows, correct) of each fold that has rows


def draw(space: dict, trial: int, seed: int = 42) -> dict:
    """The settings of trial number ``trial``."""
    out = {}
    for name, (kind, *args) in space.items():
        h = hashlib.md5(f"{seed}:{trial}:{name}".encode()).digest()
        u = int.from_bytes(h[:6], "big") / (1 << 48)
        if kind == "choice":
            out[name] = args[0][int(u * len(args[0]))]
        elif kind == "whole":
            out[name] = args[0] + int(u * (args[1] - args[0] + 1))
        elif kind == "real":
            out[name] = args[0] + u * (args[1] - args[0])
        elif kind == "log":
            out[name] = math.exp(math.log(args[0]) + u * (math.log(args[1]) - math.log(args[0])))
        else:
            raise ValueError(f"unknown kind {kind!r} of {name!r}")
    return out


def rungs(trials: int, eta: int) -> list[tuple[int, float]]:
    """(trials, share of the rows) of each rung; the last has one trial and all rows."""
    kept = [trials]
    while kept[-1] > 1:
        kept.append(max(1, kept[-1] // eta))
    return [(n, float(eta) ** (i + 1 - len(kept))) for i, n in enumerate(kept)]


def _tally(scored: DataFrame) -> dict[tuple[int, int], tuple[int, int]]:
    """{(trial, fold): (rows, correct)} of (trial, fold, label, prediction)."""
    c = scored.groupBy("trial", "fold").agg(F.count(F.lit(1)).alias("n"), F.sum(
        (F.col("label").cast("double") == F.col("prediction")).cast("long")).alias("ok"))
    return {(r["trial"], r["fold"]): (r["n"], r["ok"]) for r in c.collect()}  # trials x folds rows


def boosted_scores(df: DataFrame, trials: dict[int, dict], folds: int, key: str) -> Scores:
    """All trials and folds in common passes, scored in one."""
    width = df.select(F.size(M.vector_to_array("features")).alias("n")).first()["n"]
    ids = list(trials)
    specs = [Spec(Settings(**trials[t]), tuple(range(width)), k) for k in range(folds) for t in ids]
    got = fit_many(df, specs, "label", "features", key, fold="fold")
    experts = {k: tuple(got[k * len(ids):(k + 1) * len(ids)]) for k in range(folds)}
    p = M._probabilities(df, experts, "fold").select("fold", "label", F.posexplode("_p").alias("at", "p"))
    named = F.element_at(F.array(*[F.lit(t) for t in ids]), F.col("at") + 1).alias("trial")
    n = _tally(p.select(named, "fold", "label", (F.col("p") > 0.5).cast("double").alias("prediction")))
    return {t: [n[t, k] for k in range(folds) if (t, k) in n] for t in ids}


def learner_scores(make: Callable[[dict], object], parallel: int = 4):
    """Scores of any estimator: one fit per trial and fold, ``parallel`` at a time."""
    def scores(df: DataFrame, trials: dict[int, dict], folds: int, key: str) -> Scores:
        held = {r["fold"] for r in df.select("fold").distinct().collect()}  # the folds

        def one(pair):
            t, k = pair
            model = make(trials[t]).setLabelCol("label").setFeaturesCol("features").fit(df.where(F.col("fold") != k))
            out = model.transform(df.where(F.col("fold") == k))
            return _tally(out.select(F.lit(t).alias("trial"), "fold", "label", F.col("prediction").cast("double").alias("prediction")))
        with ThreadPoolExecutor(max_workers=parallel) as pool:
            n = {at: c for part in pool.map(one, [(t, k) for t in trials for k in range(folds) if k in held]) for at, c in part.items()}
        return {t: [n[t, k] for k in range(folds) if (t, k) in n] for t in trials}
    return scores


def _network(s: dict) -> ReluNetwork:
    halves = [Layer(max(8, s["units"] >> i), False, s["dropout"]) for i in range(s["layers"])]
    return ReluNetwork(halves, s["epochs"], s["batch"], s["rate"])


#: Name of the searched model: its space and how its trials are scored.
SEARCHES = {
    "boosted_trees": (BOOSTED_SPACE, boosted_scores),
    "dense_network": (NETWORK_SPACE, learner_scores(_network)),
    "random_forest": (FOREST_SPACE, learner_scores(lambda s: M.create_model("structural_rf", **s))),
    "logistic_regression": (LOGISTIC_SPACE, learner_scores(lambda s: M.create_model("logistic_regression", **s))),
}


def successive_halving(df: DataFrame, model: str, trials: int = 9, eta: int = 3, folds: int = 3, key: str = "page_id",
                       label: str = "label", seed: int = 42) -> DataFrame:
    """(model, trial, rung, share, rows, settings, cv_accuracy, promoted, best): a row for each trial of
    each rung; ``best`` marks the trial that is left, in its last rung.

    Defined results: trials of equal accuracy go by their number; a rung's fold without rows is left
    out of the mean; a rung whose rows are fewer than two a fold takes all rows; an empty table and an unknown
    name raise ValueError."""
    if model not in SEARCHES:
        raise ValueError(f"no search space is known for {model!r}; names: {', '.join(sorted(SEARCHES))}")
    if trials < 1 or eta < 2 or folds < 2:
        raise ValueError("a search needs a trial, eta of 2 or more and 2 folds or more")
    space, scores = SEARCHES[model]
    x = df.select(key, F.col(label).alias("label"), "features")
    x = M._written(stratified_kfold(x, folds, "label", seed, key).withColumn("_share", hash_uniform(key, seed + 1)))
    total = x.count()
    if not total:
        raise ValueError("no rows to search on")
    left, rows = {t: draw(space, t, seed) for t in range(trials)}, []
    steps = rungs(trials, eta)
    for rung, (_, share) in enumerate(steps):
        part = x if share >= 1 else x.where(F.col("_share") < share)
        n = part.count()
        if n < 2 * folds:
            part, n, share = x, total, 1.0
        got = scores(part.drop("_share"), left, folds, key)
        mean = {t: sum(ok / m for m, ok in c) / len(c) if c else 0.0 for t, c in got.items()}
        order = sorted(left, key=lambda t: (-mean[t], t))
        on = order[:steps[rung + 1][0]] if rung + 1 < len(steps) else []
        rows += [(model, t, rung, share, n, json.dumps(left[t], sort_keys=True), mean[t], t in on,
                  rung + 1 == len(steps) and t == order[0]) for t in sorted(left)]
        left = {t: left[t] for t in sorted(on)}
    return df.sparkSession.createDataFrame(
        rows, "model string, trial int, rung int, share double, rows long, settings string, cv_accuracy double, promoted boolean, best boolean")
