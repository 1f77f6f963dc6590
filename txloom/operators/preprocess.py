"""Scaling fitted on training rows, projection of embeddings, Gaussian naive Bayes in SQL."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def zscore(df: DataFrame, columns: list[str], train: str = "split = 'train'") -> DataFrame:
    """Columns centred and divided by the population deviation of the training rows (1 where it is 0).

    One aggregate row is fitted for all columns; what is not finite afterwards is 0.
    """
    fit = df.filter(train).agg(*[f for c in columns for f in (F.avg(c).alias(f"_m_{c}"), F.stddev_pop(c).alias(f"_s_{c}"))])
    scaled = {c: F.coalesce((F.col(c) - F.col(f"_m_{c}")) / F.coalesce(F.nullif(F.col(f"_s_{c}"), F.lit(0.0)), F.lit(1.0)), F.lit(0.0)) for c in columns}
    return df.crossJoin(F.broadcast(fit)).withColumns(scaled).select(*df.columns)


def minmax(df: DataFrame, columns: list[str], train: str = "split = 'train'") -> DataFrame:
    """Columns mapped so that the training rows span 0 … 1 (divided by 1 where they are constant)."""
    fit = df.filter(train).agg(*[f for c in columns for f in (F.min(c).alias(f"_m_{c}"), F.max(c).alias(f"_x_{c}"))])
    span = lambda c: F.coalesce(F.nullif(F.col(f"_x_{c}") - F.col(f"_m_{c}"), F.lit(0.0)), F.lit(1.0))
    return df.crossJoin(F.broadcast(fit)).withColumns({c: (F.col(c) - F.col(f"_m_{c}")) / span(c) for c in columns}).select(*df.columns)


def scale_fit(df: DataFrame, columns: list[str], how: str = "standard", train: str = "split = 'train'") -> dict:
    """Centre and width of every column over the training rows, as plain values: ``standard`` or ``minmax``."""
    two = (F.avg, F.stddev_pop) if how == "standard" else (F.min, F.max)
    row = df.filter(train).agg(*[f(c).cast("double").alias(f"{i}_{k}") for i, c in enumerate(columns) for k, f in enumerate(two)]).first() if columns else {}
    centre, other = ([row[f"{i}_{k}"] for i in range(len(columns))] for k in (0, 1))
    width = other if how == "standard" else [None if b is None else b - a for a, b in zip(centre, other, strict=True)]
    return {"how": how, "columns": list(columns), "centre": centre, "width": [w or 1.0 for w in width]}


def scale_apply(df: DataFrame, state: dict) -> DataFrame:
    """The columns on the scale of :func:`scale_fit`, as :func:`zscore` and :func:`minmax` give them."""
    scaled = {c: (F.col(c) - F.lit(m).cast("double")) / F.lit(float(w)) for c, m, w in zip(state["columns"], state["centre"], state["width"], strict=True)}
    if state["how"] == "standard":
        scaled = {c: F.coalesce(v, F.lit(0.0)) for c, v in scaled.items()}
    return df.withColumns(scaled) if scaled else df


def pca_fit(df: DataFrame, columns: list[str], k: int | float, train: str = "split = 'train'", prefix: str = "emb_pca_") -> dict:
    """Scale and principal components of the training rows; ``k`` is their number or, below 1, the share of variance they explain."""
    scale = scale_fit(df, columns, "standard", train)
    scaled = VectorAssembler(inputCols=columns, outputCol="_v").transform(scale_apply(df.filter(train), scale))
    most = min(len(columns), k if k >= 1 else len(columns))
    model = PCA(k=int(most), inputCol="_v", outputCol="_p").fit(scaled)
    share = model.explainedVariance.toArray().cumsum()
    wanted = int(most) if k >= 1 else min(len(share), int((share < k).sum()) + 1)
    return {"scale": scale, "components": model.pc.toArray()[:, :wanted].tolist(), "prefix": prefix}


def pca_apply(df: DataFrame, state: dict) -> DataFrame:
    """The fitted columns replaced by their principal components: one matrix product an Arrow batch."""
    columns, matrix = state["scale"]["columns"], np.array(state["components"])

    @F.pandas_udf("array<double>")
    def project(x: pd.Series) -> pd.Series:
        return pd.Series(list(np.stack(x.to_list()) @ matrix)) if len(x) else pd.Series([], dtype=object)

    rest = [c for c in df.columns if c not in columns]
    out = scale_apply(df, state["scale"]).select(*rest, project(F.array(*columns)).alias("_p"))
    return out.select(*rest, *[F.col("_p")[i].alias(f"{state['prefix']}{i}") for i in range(matrix.shape[1])])


def emb_pca(df: DataFrame, columns: list[str], k: int | float, train: str = "split = 'train'", prefix: str = "emb_pca_") -> DataFrame:
    """Columns z-scored on training rows and replaced by principal components.

    ``k`` is their number or, below 1, the share of variance they must explain.
    """
    return pca_apply(df, pca_fit(df, columns, k, train, prefix))


def gaussian_nb(df: DataFrame, columns: list[str], label: str = "label", train: str = "split = 'train'", smoothing: float = 1e-9, priors: dict[int, float] | None = None) -> DataFrame:
    """Adds ``p0, p1`` of a Gaussian naive Bayes model fitted on the training rows.

    Variances are raised by ``smoothing`` times the largest feature variance; the
    model is two rows of moments, the scores are column expressions.
    """
    return nb_score(df, nb_fit(df.filter(train), columns, label, smoothing, priors))


def nb_fit(rows: DataFrame, columns: list[str], label: str = "label", smoothing: float = 1e-9, priors: dict[int, float] | None = None) -> dict:
    """Log prior, means and variances of both classes, as plain values."""
    moments = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"), *[f for c in columns for f in (F.avg(c).alias(f"m_{c}"), F.var_pop(c).alias(f"v_{c}"))])
    by = {r[label]: r for r in moments.collect()}  # a row a class
    spread = rows.agg(*[F.var_pop(c) for c in columns]).first()
    extra = smoothing * max((x for x in spread if x is not None), default=0.0)
    total = sum(r["n"] for r in by.values())
    classes = [{"prior": math.log((priors or {}).get(c, by[c]["n"] / total)), "mean": [by[c][f"m_{f}"] for f in columns], "variance": [by[c][f"v_{f}"] + extra or 1e-300 for f in columns]} for c in (0, 1)]
    return {"columns": list(columns), "classes": classes}


def nb_score(df: DataFrame, state: dict) -> DataFrame:
    """Adds ``p0, p1`` of a model that :func:`nb_fit` made."""

    def log_joint(c: int):
        part = state["classes"][c]
        out = F.lit(part["prior"])
        for f, mean, var in zip(state["columns"], part["mean"], part["variance"], strict=True):
            out = out - F.lit(0.5 * math.log(2 * math.pi * var)) - F.pow(F.col(f) - F.lit(mean), 2) / F.lit(2 * var)
        return out

    scored = df.withColumns({"_j0": log_joint(0), "_j1": log_joint(1)})
    p0 = 1 / (1 + F.exp(F.least(F.lit(700.0), F.col("_j1") - F.col("_j0"))))
    return scored.withColumn("p0", p0).withColumn("p1", 1 - F.col("p0")).drop("_j0", "_j1")


def clip_proba(df: DataFrame, eps: float = 1e-10) -> DataFrame:
    """``p0, p1`` kept inside [eps, 1 - eps] and renormalised."""
    a, b = (F.least(F.greatest(F.col(c), F.lit(eps)), F.lit(1 - eps)) for c in ("p0", "p1"))
    return df.withColumns({"_a": a, "_b": b}).withColumns({"p0": F.col("_a") / (F.col("_a") + F.col("_b")), "p1": F.col("_b") / (F.col("_a") + F.col("_b"))}).drop("_a", "_b")
