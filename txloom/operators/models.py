"""Classifiers behind one interface, hyper-parameter search, fixed parameters, importances.

Tables have ``tx_id``, ``label`` (0 is the positive class), ``split`` and numeric
columns.  A fitted model adds ``p0``.
"""

from __future__ import annotations

import json
import math
import random
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txloom.functions.storage import drop, hash_key, hash_rank, materialize
from txloom.operators import boosting
from txloom.operators import metrics as M
from txloom.operators import preprocess as P
from txloom.operators import sampling as S

Params = dict[str, object]


@dataclass(frozen=True)
class Space:
    """Choices, or a range drawn on a logarithmic or linear scale."""

    options: tuple = ()
    low: float = 0.0
    high: float = 1.0
    log: bool = False

    def draw(self, r: random.Random):
        if self.options:
            return r.choice(self.options)
        return self.value(r.uniform(*self.ends()))

    def ends(self) -> tuple[float, float]:
        """The range on the scale that it is drawn on."""
        return (math.log(self.low), math.log(self.high)) if self.log else (self.low, self.high)

    def scaled(self, v: float) -> float:
        return math.log(v) if self.log else v

    def value(self, x: float) -> float:
        return min(self.high, max(self.low, math.exp(x) if self.log else x))


_PCA = Space((None, 16, 32, 48, 64, 0.95))

# Search spaces by model.
SPACES: dict[str, dict[str, Space]] = {
    "LR": {"penalty": Space(("l2", None)), "C": Space(low=1e-3, high=10, log=True), "balancing": Space(("none", "oversampling", "class_weights")), "emb_pca": _PCA},
    "MLP": {"hidden": Space(((64,), (128,), (256,), (64, 32), (128, 64), (256, 64), (256, 128))), "lr": Space(low=1e-4, high=5e-2, log=True), "balancing": Space(("none", "oversampling"))},
    "NB": {"var_smoothing": Space(low=1e-6, high=1e-1, log=True), "balancing": Space(("none", "oversampling", "class_prior")), "ratio": Space(low=0.5, high=1.0), "scaler": Space(("standard", "minmax"))},
    "RF": {"trees": Space(tuple(range(100, 601, 25))), "depth": Space((5, 10, 15, 20, 30)), "leaf": Space((1, 2, 3, 4, 5)), "features": Space(("sqrt", "log2", "all")), "balancing": Space(("none", "oversampling", "class_weights"))},
    "SVC": {"C": Space(low=1e-3, high=1e2, log=True), "gamma": Space(low=1e-4, high=10, log=True), "kernel": Space(("rbf",)), "balancing": Space(("class_weights",))},
    "XGB": {"trees": Space(tuple(range(50, 501, 25))), "depth": Space(tuple(range(2, 9))), "lr": Space(low=1e-2, high=3e-1, log=True), "subsample": Space(low=0.6, high=1.0), "columns": Space(low=0.6, high=1.0), "child": Space(low=1e-1, high=10, log=True), "gamma": Space(low=1e-3, high=1, log=True), "alpha": Space(low=1e-6, high=1, log=True), "lambda": Space(low=1e-3, high=10, log=True), "balancing": Space(("none", "oversampling"))},
}
#: Whether the threshold is chosen on a model that has seen the validation rows too.
THRESHOLD_FIT = {"LR": "train", "MLP": "train", "XGB": "train", "NB": "train_val", "RF": "train_val", "SVC": "train_val"}


@dataclass
class Fitted:
    """A model as a function that adds ``p0``, with intrinsic importances by column."""

    score: Callable[[DataFrame], DataFrame]
    importance: dict[str, float] = field(default_factory=dict)
    pipeline: PipelineModel | None = None
    #: What :func:`scorer` needs beside the pipeline, as plain values.
    state: dict = field(default_factory=dict)
    #: Parameters that training found, for a refit without validation rows.
    found: dict = field(default_factory=dict)


def balance(rows: DataFrame, params: Params, model: str) -> tuple[DataFrame, str | None]:
    """Training rows after the balancing strategy, and the weight column it adds."""
    how = params.get("balancing", "none")
    if how == "oversampling":
        rows = S.oversample(rows, "label", ratio=float(params.get("ratio", 1.0)), seed=int(params.get("seed", 42))).drop("draw")
    if model == "XGB":  # class 0 weighs n1 / n0, which is 1 after oversampling
        return S.ratio_weight(rows, "label"), "weight"
    if how == "class_weights":
        w = S.class_weights(rows, "label").select("label", "weight")
        return rows.join(F.broadcast(w), "label"), "weight"  # a row a class
    return rows, None


def _rbf(columns: list[str], gamma: float, features: int = 256, seed: int = 42):
    """Random Fourier features of an RBF kernel: one matrix product an Arrow batch."""
    r = np.random.default_rng(seed)
    w, b = r.normal(scale=math.sqrt(2 * gamma), size=(len(columns), features)), r.uniform(0, 2 * math.pi, features)

    @F.pandas_udf("array<double>")
    def lift(x: pd.Series) -> pd.Series:
        return pd.Series(list(math.sqrt(2 / features) * np.cos(np.stack(x.to_list()) @ w + b))) if len(x) else pd.Series([], dtype=object)

    return array_to_vector(lift(F.array(*[F.col(c).cast("double") for c in columns]))).alias("features")


def fit(model: str, train: DataFrame, columns: list[str], params: Params, held: DataFrame | None = None) -> Fitted:
    """Fits one model on ``train`` whose columns are scaled already; boosting stops early by ``held`` rows, where given."""
    rows, weight = balance(train, params, model)
    rows = rows.withColumn("target", (1 - F.col("label")).cast("double"))  # Spark's positive class is 1
    if model == "NB":
        part = train if params.get("balancing") != "oversampling" else rows
        priors = {0: 0.5, 1: 0.5} if params.get("balancing") == "class_prior" else None
        state = {"nb": P.nb_fit(part, columns, smoothing=float(params.get("var_smoothing", 1e-9)), priors=priors)}
        return Fitted(scorer(state), state=state)
    if model == "XGB":
        boosted = boosting.fit(rows, columns, params, held.withColumn("target", 1 - F.col("label")) if held is not None else None)
        importance, found = boosted.pop("importance"), {"trees": max(1, boosted["best"])} if held is not None else {}
        state = {"boost": boosted}
        return Fitted(scorer(state), importance, state=state, found=found)
    assembler, svc = VectorAssembler(inputCols=columns, outputCol="features"), None
    common = {"labelCol": "target", "featuresCol": "features"} | ({"weightCol": weight} if weight else {})
    seed = int(params.get("seed", 42))
    if model == "LR":
        reg = 0.0 if params.get("penalty", "l2") is None else 1 / (float(params.get("C", 1.0)) * max(1, rows.count()))
        est = LogisticRegression(regParam=reg, elasticNetParam=0.0, standardization=False, maxIter=int(params.get("max_iter", 200)), **common)
    elif model == "RF":
        est = RandomForestClassifier(numTrees=int(params.get("trees", 100)), maxDepth=min(30, int(params.get("depth", 10))), minInstancesPerNode=int(params.get("leaf", 1)), featureSubsetStrategy=str(params.get("features", "sqrt")), seed=seed, **common)
    elif model == "MLP":
        common.pop("weightCol", None)
        layers = [len(columns), *params.get("hidden", (64,)), 2]
        est = MultilayerPerceptronClassifier(layers=layers, stepSize=float(params.get("lr", 0.03)), maxIter=int(params.get("max_iter", 100)), seed=seed, **common)
    elif model == "SVC":
        svc = params.get("kernel", "linear") == "rbf"
        est = LinearSVC(regParam=1 / (float(params.get("C", 1.0)) * max(1, rows.count())), maxIter=int(params.get("max_iter", 100)), **common)
    else:
        raise ValueError(f"unknown model {model}")

    state: dict = {"kernel": {"columns": columns, "gamma": float(params.get("gamma", 0.1)), "seed": seed}} if svc else {}
    with_features = (lambda df: df.select("*", _rbf(**state["kernel"]))) if svc else assembler.transform
    fitted = est.fit(with_features(rows))
    importance: dict[str, float] = {}
    if model == "LR" or model == "SVC" and not svc:
        importance = dict(zip(columns, np.abs(fitted.coefficients.toArray()).tolist(), strict=True))
    elif model == "RF":
        importance = dict(zip(columns, fitted.featureImportances.toArray().tolist(), strict=True))
    elif model == "MLP":
        first = int(params.get("hidden", (64,))[0])
        importance = dict(zip(columns, np.abs(fitted.weights.toArray()[: len(columns) * first].reshape(len(columns), first)).mean(1).tolist(), strict=True))
    elif svc:
        importance = dict.fromkeys(columns, 0.0)

    pipeline = PipelineModel(stages=[fitted] if svc else [assembler, fitted])
    if model == "SVC":  # margins to probabilities by a logistic fit on the training margins
        margins = materialize(fitted.transform(with_features(rows)).select(vector_to_array("rawPrediction")[1].alias("margin"), "target"), "margins")
        platt = LogisticRegression(labelCol="target", featuresCol="m").fit(VectorAssembler(inputCols=["margin"], outputCol="m").transform(margins))
        state["platt"] = [float(platt.coefficients[0]), float(platt.intercept)]
        drop(margins)
    return Fitted(scorer(state, pipeline), importance, pipeline, state)


def scorer(state: dict, pipeline: PipelineModel | None = None) -> Callable[[DataFrame], DataFrame]:
    """The function that adds ``p0`` from a model's plain values and its pipeline, fitted now or stored before."""
    if "nb" in state:
        return lambda df: P.clip_proba(P.nb_score(df, state["nb"])).select(*df.columns, "p0")
    if "boost" in state:
        return lambda df: boosting.score(df, state["boost"])

    def score(df: DataFrame) -> DataFrame:
        out = pipeline.transform(df.select("*", _rbf(**state["kernel"])) if "kernel" in state else df)
        if "platt" in state:
            a, b = state["platt"]
            p0 = 1 / (1 + F.exp(-(F.lit(a) * vector_to_array("rawPrediction")[1] + F.lit(b))))
        else:
            p0 = vector_to_array("probability")[1]
        return out.withColumn("p0", p0).select(*df.columns, "p0")

    return score


def prepare_fit(df: DataFrame, columns: list[str], params: Params, train: str) -> dict:
    """Projection of embeddings and scale of the columns, fitted on the ``train`` rows, as plain values."""
    emb, pca = [c for c in columns if c.startswith("emb_")], None
    if params.get("emb_pca") and emb:
        pca = P.pca_fit(df, emb, params["emb_pca"], train)
        df = P.pca_apply(df, pca)
        columns = [c for c in columns if c not in emb] + [c for c in df.columns if c.startswith("emb_pca_")]
    how = "minmax" if params.get("scaler") == "minmax" else "standard"
    return {"pca": pca, "scale": P.scale_fit(df, columns, how, train)}


def prepare_apply(df: DataFrame, state: dict) -> DataFrame:
    return P.scale_apply(P.pca_apply(df, state["pca"]) if state["pca"] else df, state["scale"])


def prepare(df: DataFrame, columns: list[str], params: Params, train: str) -> tuple[DataFrame, list[str]]:
    """Embeddings projected and columns scaled, fitted on the ``train`` rows."""
    state = prepare_fit(df, columns, params, train)
    return prepare_apply(df, state), state["scale"]["columns"]


def load(spark: SparkSession, path: str) -> Callable[[DataFrame], DataFrame]:
    """The function that adds ``p0`` to raw rows with a model that a run stored."""
    state = json.loads("\n".join(r[0] for r in spark.read.text(f"{path}/params.json", wholetext=True).collect()))["state"]
    score = scorer(state, None if {"nb", "boost"} & state.keys() else PipelineModel.load(f"{path}/pipeline"))
    return lambda df: score(prepare_apply(df, state["prepare"]))


def trials(model: str, n: int, seed: int = 42) -> list[Params]:
    """``n`` seeded random draws from the model's space."""
    r = random.Random(f"{model}|{seed}")
    return [{k: s.draw(r) for k, s in SPACES[model].items()} for _ in range(n)]


def _kernels(points: list[float], low: float, high: float) -> list[tuple[float, float, float]]:
    """Centre, width and mass inside the range of a Parzen estimate: one over the whole range, and one a point.

    A point's width is the larger gap to its neighbours, so that lone points reach far.
    """
    span, ordered = high - low, [low, *sorted(points), high]
    least = span / min(100, len(points) + 2)
    wide = [(ordered[i], min(span, max(least, ordered[i] - ordered[i - 1], ordered[i + 1] - ordered[i]))) for i in range(1, len(ordered) - 1)]
    below = lambda x, c, s: (1 + math.erf((x - c) / (s * math.sqrt(2)))) / 2
    return [(c, s, below(high, c, s) - below(low, c, s)) for c, s in [((low + high) / 2, span), *wide]]


def _density(x: float, kernels: list[tuple[float, float, float]]) -> float:
    return sum(math.exp(-(((x - c) / s) ** 2) / 2) / (s * m) for c, s, m in kernels) / len(kernels)


def _suggest(space: Space, good: list, bad: list, r: random.Random, candidates: int):
    """Of draws from the density of the good values the one that is likeliest against the bad ones."""
    if space.options:
        share = lambda done: [done.count(o) + 1 for o in space.options]
        fine, poor = share(good), share(bad)
        drawn = r.choices(range(len(fine)), fine, k=candidates)
        return space.options[max(drawn, key=lambda i: fine[i] / poor[i])]
    low, high = space.ends()
    fine, poor = (_kernels([space.scaled(v) for v in done], low, high) for done in (good, bad))
    drawn = []
    while len(drawn) < candidates:
        c, s, _ = r.choice(fine)
        x = r.gauss(c, s)
        if low <= x <= high:
            drawn.append(x)
    return space.value(max(drawn, key=lambda x: _density(x, fine) / _density(x, poor)))


def propose(spaces: dict[str, Space], done: list[dict], r: random.Random, startup: int = 20, candidates: int = 24, share: float = 0.25) -> Params:
    """Parameters of the next trial by tree-structured Parzen estimates.

    The first ``startup`` trials are drawn at random.  Then the best ``share`` of the
    trials (by loss; those without a finite one are the worst) are the good ones, and
    every parameter is chosen by itself.
    """
    if len(done) < startup:
        return {k: s.draw(r) for k, s in spaces.items()}
    loss = lambda t: t["loss"] if t["loss"] is not None and math.isfinite(t["loss"]) else math.inf
    ordered = [t["params"] for t in sorted(done, key=lambda t: (loss(t), t["trial"]))]
    cut = max(1, math.ceil(share * len(ordered)))
    return {k: _suggest(s, [p[k] for p in ordered[:cut]], [p[k] for p in ordered[cut:]], r, candidates) for k, s in spaces.items()}


def minimise(loss: Callable[[Params], float], spaces: dict[str, Space], n: int, seed: int | str = 42, **how) -> list[dict]:
    """``n`` trials of a loss in turn, each with the parameters proposed after those before."""
    r, done = random.Random(str(seed)), []
    for k in range(n):
        params = propose(spaces, done, r, **how)
        done.append({"trial": k, "params": params, "loss": loss(params)})
    return done


def best(done: list[dict]) -> Params:
    """Parameters of the first trial with the least finite loss."""
    finite = [t for t in done if t["loss"] is not None and math.isfinite(t["loss"])]
    if not finite:
        raise ValueError("no trial gave a finite loss")
    return min(finite, key=lambda t: (t["loss"], t["trial"]))["params"]


def objective(scored: DataFrame, model: str) -> float:
    """What a search minimises: log loss, or 1 - ROC AUC for SVC."""
    return 1 - (M.roc_auc(scored).first()[0] or 0.0) if model == "SVC" else M.log_loss(scored).first()[0]


def stored(df: DataFrame, columns: list[str]) -> DataFrame:
    """The rows and columns that fitting reads, written once: every pass of a fit would compute them anew."""
    return materialize(df.select("tx_id", "label", "split", *columns), "model-rows")


def search(model: str, df: DataFrame, columns: list[str], n: int = 50, seed: int = 42) -> tuple[Params, list[dict]]:
    """Best parameters of ``n`` trials on the validation rows, and all trials; the rows are stored once for all of them."""
    df = stored(df, columns)

    def loss(params: Params) -> float:
        ready, used = prepare(df, columns, params, "split = 'train'")
        held = ready.filter("split = 'validation'")
        fitted = fit(model, ready.filter("split = 'train'"), used, params, held)
        return objective(fitted.score(held).withColumn("y_true", F.col("label")), model)

    done = minimise(loss, SPACES[model], n, f"{model}|{seed}")
    drop(df)
    return best(done), done


def run(model: str, df: DataFrame, columns: list[str], params: Params, steps: int = 100) -> dict:
    """Threshold on validation, refit on training and validation rows, test predictions and metrics.

    ``df`` may carry edge-variant columns; fixed parameters of a baseline are used by
    passing them as ``params``.  The rows are stored once and stay for the predictions.
    """
    df = stored(df, columns)
    seen = "split = 'train'" if THRESHOLD_FIT[model] == "train" else "split IN ('train', 'validation')"
    ready, used = prepare(df, columns, params, seen)
    held = ready.filter("split = 'validation'")
    first = fit(model, ready.filter(seen), used, params, held)
    validation = first.score(held).withColumn("y_true", F.col("label"))
    threshold = M.best_threshold(validation, steps=steps).first()["threshold"]
    before = prepare_fit(df, columns, params, "split IN ('train', 'validation')")
    ready, used = prepare_apply(df, before), before["scale"]["columns"]
    # without rows held back the first fit saw these rows, scaled alike, with the same parameters
    final = fit(model, ready.filter("split IN ('train', 'validation')"), used, params | first.found) if THRESHOLD_FIT[model] == "train" else first
    test = final.score(ready.filter("split = 'test'"))
    preds = test.select("tx_id", F.col("label").alias("y_true"), F.when(F.col("p0") >= threshold, 0).otherwise(1).alias("y_pred"), F.col("p0").alias("proba_fraud"), (1 - F.col("p0")).alias("proba_nofraud"))
    return {"model": model, "threshold": threshold, "predictions": preds, "importance": final.importance, "pipeline": final.pipeline, "params": params, "state": final.state | {"prepare": before}}


def metrics_document(result: dict, feature_set: str) -> dict:
    """Nested result document of a run."""
    p = result["predictions"].withColumn("p0", F.col("proba_fraud")).withColumn("k", F.lit(1))
    m = M.all_metrics(p, ["k"]).first()
    names = {"f1_fraud": "f1", "precision_fraud": "precision", "recall_fraud": "recall", "balanced_accuracy": "balanced_accuracy", "log_loss": "log_loss", "accuracy": "accuracy", "roc_auc_fraud": "roc_auc", "pr_auc_fraud": "average_precision"}
    return {
        "run_info": {"model": result["model"], "feature_set": feature_set, "threshold": result["threshold"]},
        "best_params": json.loads(json.dumps(result["params"], default=str)),
        "test_metrics": {k: m[v] for k, v in names.items()},
        "feature_importance": [{"feature": f, "importance": v, "rank": i + 1} for i, (f, v) in enumerate(sorted(result["importance"].items(), key=lambda x: (-x[1], x[0])))],
    }


def permutation_importance(fitted: Fitted, df: DataFrame, columns: list[str], threshold: float, repeats: int = 10, seed: int = 42) -> dict[str, float]:
    """Mean drop of F1 at the threshold when a column's values are dealt out anew by hash."""
    def f1(rows: DataFrame) -> float:
        scored = fitted.score(rows).select(F.col("label").alias("y_true"), F.when(F.col("p0") >= threshold, 0).otherwise(1).alias("y_pred"))
        return M.precision_recall_f1(scored).first()["f1"]

    base, out = f1(df), {}
    for c in columns:
        drops = []
        for k in range(repeats):
            a = hash_rank(df.withColumn("_k", hash_key(f"{seed}|{k}", "tx_id")), [], "_k", "_r").drop("_k", c)
            b = hash_rank(df.select("tx_id", F.col(c)).withColumn("_k", hash_key(f"{seed}|{k}|{c}", "tx_id")), [], "_k", "_r").select("_r", c)
            drops.append(base - f1(a.join(b, "_r").drop("_r")))
        out[c] = float(np.mean(drops))
    return out
