"""Statistics over repeated runs: trimmed moments, wins, McNemar tests, deltas, pivots.

Metric tables are long: ``run, classifier, variant, value``.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Upper 5 % point of the chi-square distribution with one degree of freedom.
CHI2_05 = 3.841458820694124

# Metrics, whether more is better, and the names a result may use.
METRICS = {
    "logloss": ("lower", ["log_loss"]),
    "f1_fraud": ("higher", ["f1_fraud", "f1", "f1_score_fraud", "f1_score"]),
    "recall_fraud": ("higher", ["recall_fraud", "recall", "recall_score_fraud", "recall_score"]),
    "precision_fraud": ("higher", ["precision_fraud", "precision", "precision_score_fraud", "precision_score"]),
    "roc_auc_fraud": ("higher", ["roc_auc_fraud", "roc_auc"]),
    "pr_auc_fraud": ("higher", ["pr_auc_fraud", "pr_auc"]),
}
# Sections of a result document in the order they are looked through.
SECTIONS = ["metrics_test", "test_metrics", "final_test_metrics_argmax", "final_test_metrics_tuned", "final_test_metrics", "final_test_metrics.at_tau_star", "final_test_metrics.at_0_5", "test_results_tuned", "test_results_argmax", "validation_results_tuned", "validation_results_argmax"]


def extract_metric(doc: Column, metric: str) -> Column:
    """First number found under the metric's names, section by section, then at any depth.

    ``doc`` is JSON text; null where it is none or holds no such number.
    """
    names = METRICS[metric][1]
    paths = [f"$.{s}.{n}" for s in SECTIONS for n in names] + [f"$.{n}" for n in names]
    known = F.coalesce(*[F.get_json_object(doc, p).try_cast("double") for p in paths])
    deep = [F.regexp_extract(doc, rf'"{n}"\s*:\s*"?(-?[0-9.]+(?:[eE][-+]?[0-9]+)?)', 1).try_cast("double") for n in names]
    return F.coalesce(known, *deep)


def trimmed(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Mean and sample deviation after one least and one largest value are left out of groups of three or more.

    Both follow from sums, the extremes and the count, so no group is gathered.
    """
    rows = df.filter(F.col(value).isNotNull() & ~F.isnan(value))
    v = F.col(value)
    sums = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("m"), F.min(value).alias("lo"), F.max(value).alias("hi"))
    about = rows.join(sums, keys).groupBy(*keys).agg(F.max("n").alias("n"), F.max("m").alias("m"), F.max("lo").alias("lo"), F.max("hi").alias("hi"), F.sum(F.pow(v - F.col("m"), 2)).alias("q"), F.sum(v - F.col("m")).alias("s"))
    cut = F.when(F.col("n") >= 3, 1).otherwise(0)
    a, b = F.col("lo") - F.col("m"), F.col("hi") - F.col("m")
    k, s, q = F.col("n") - 2 * cut, F.col("s") - cut * (a + b), F.col("q") - cut * (a * a + b * b)
    std = F.when(k < 2, F.lit(0.0)).otherwise(F.sqrt(F.greatest(F.lit(0.0), q - s * s / k) / F.greatest(k - 1, F.lit(1))))
    return about.select(*keys, "n", (F.col("m") + s / k).alias("mean"), std.alias("std"))


def with_base(df: DataFrame, base: str, keys: list[str] = ("run", "classifier")) -> DataFrame:
    """Adds ``base``: the baseline variant's value of the same run and classifier."""
    ref = df.filter(F.col("variant") == base).groupBy(*keys).agg(F.avg("value").alias("base"))
    return df.join(ref, list(keys), "left")


def wins(df: DataFrame, base: str, better: str = "higher") -> DataFrame:
    """Runs in which a variant is strictly better than the baseline; null where no run has both."""
    avg = df.groupBy("run", "classifier", "variant").agg(F.avg("value").alias("value"))
    gain = F.col("value") > F.col("base") if better == "higher" else F.col("value") < F.col("base")
    both = with_base(avg, base)
    return both.groupBy("classifier", "variant").agg(F.sum(F.when(F.col("variant") == base, 0).when(F.col("base").isNotNull(), gain.cast("int"))).alias("wins"))


def matrix(df: DataFrame, variants: list[str], value: str = "mean") -> DataFrame:
    """A row a classifier, a column a variant in the given order; rows without any value go."""
    wide = df.groupBy("classifier").pivot("variant", variants).agg(F.avg(value))
    return wide.filter(F.coalesce(*[F.col(f"`{v}`") for v in variants]).isNotNull())


def ordered(names: list[str], preferred: list[str]) -> list[str]:
    """Preferred names first and in their order, the rest by alphabet."""
    return [n for n in preferred if n in names] + sorted(n for n in names if n not in preferred)


def top_classifiers(stats: DataFrame, base: str, better: str = "higher", k: int = 5) -> DataFrame:
    """The ``k`` classifiers with the best baseline mean."""
    order = F.col("mean").desc() if better == "higher" else F.col("mean")
    return stats.filter((F.col("variant") == base) & F.col("mean").isNotNull()).orderBy(order, "classifier").limit(k).select("classifier")


def top_average(stats: DataFrame, base: str, better: str = "higher", k: int = 5) -> DataFrame:
    """Per variant the mean over the top classifiers and its mean difference to their baseline."""
    top = stats.join(F.broadcast(top_classifiers(stats, base, better, k)), "classifier", "left_semi")  # k rows
    ref = top.filter(F.col("variant") == base).select("classifier", F.col("mean").alias("base"))
    return top.join(ref, "classifier").groupBy("variant").agg(F.avg("mean").alias("avg"), F.avg(F.col("mean") - F.col("base")).alias("delta"))


def color_code(stats: DataFrame, base: str, better: str = "higher") -> DataFrame:
    """0 for the baseline, 1 where a mean is at least as good, 2 where it is worse; null without baseline.

    ``intensity`` grows with the 0.7th power of the difference over the largest one.
    """
    ref = stats.filter(F.col("variant") == base).select("classifier", F.col("mean").alias("base"))
    d = F.col("mean") - F.col("base")
    good = d >= 0 if better == "higher" else d <= 0
    code = F.when(F.col("variant") == base, 0).when(d.isNotNull(), F.when(good, 1).otherwise(2))
    rows = stats.join(ref, "classifier", "left").withColumns({"delta": d, "code": code})
    most = rows.agg(F.max(F.abs("delta")).alias("_most"))
    strength = F.pow(F.abs("delta") / F.nullif("_most", F.lit(0.0)), 0.7)
    return rows.crossJoin(F.broadcast(most)).withColumn("intensity", F.lit(0.2) + F.lit(1.1) * F.coalesce(strength, F.lit(0.0))).drop("_most", "base")


def mcnemar(pred: DataFrame, base: str) -> DataFrame:
    """``run, classifier, variant, n01, n10, chi2, direction, significant`` against the baseline's predictions.

    Predictions are joined by id.  n01: baseline right, variant wrong.  Continuity
    corrected; no disagreement gives a null statistic, p 0 and direction 0.
    """
    right = pred.withColumn("ok", (F.col("y_true") == F.col("y_pred")).cast("int"))
    ref = right.filter(F.col("variant") == base).select("run", "classifier", "tx_id", F.col("ok").alias("base_ok"))
    both = right.filter(F.col("variant") != base).join(ref, ["run", "classifier", "tx_id"])
    n = both.groupBy("run", "classifier", "variant").agg(F.count_if((F.col("base_ok") == 1) & (F.col("ok") == 0)).alias("n01"), F.count_if((F.col("base_ok") == 0) & (F.col("ok") == 1)).alias("n10"))
    chi2 = F.pow((F.abs(F.col("n01") - F.col("n10")) - 1).cast("double"), 2) / F.nullif(F.col("n01") + F.col("n10"), F.lit(0))
    n = n.withColumn("chi2", chi2).withColumn("direction", F.signum(F.col("n10") - F.col("n01")).cast("int"))
    return n.withColumn("significant", F.coalesce(F.col("chi2") >= CHI2_05, F.lit(True)))


def p_values(tests: DataFrame) -> DataFrame:
    """Adds ``p_value``: the upper tail of chi-square with one degree of freedom."""

    @F.pandas_udf("double")
    def tail(x: pd.Series) -> pd.Series:
        return x.map(lambda v: 0.0 if v is None or v != v else math.erfc(math.sqrt(v / 2)))

    return tests.withColumn("p_value", tail("chi2"))


def significance_counts(tests: DataFrame) -> DataFrame:
    """Runs available, significantly better and significantly worse per classifier and variant."""
    hit = lambda d: F.count_if(F.col("significant") & (F.col("direction") == d))
    return tests.groupBy("classifier", "variant").agg(F.count(F.lit(1)).alias("available"), hit(1).alias("better"), hit(-1).alias("worse"))


def with_sums(counts: DataFrame) -> DataFrame:
    """Counts plus a row ``Σ`` over classifiers for every variant, and the net of better and worse."""
    rolled = counts.groupingSets([["classifier", "variant"], ["variant"]], "classifier", "variant").agg(F.sum("available").alias("available"), F.sum("better").alias("better"), F.sum("worse").alias("worse"), F.grouping("classifier").alias("g"))
    return rolled.select(F.when(F.col("g") == 1, "Σ").otherwise(F.col("classifier")).alias("classifier"), "variant", "available", "better", "worse", (F.col("better") - F.col("worse")).alias("net"))


def cell_summary(counts: DataFrame) -> DataFrame:
    """One row: cells improved, worsened, equal and without significance, and their shares in percent."""
    b, w = F.col("better"), F.col("worse")
    row = counts.agg(F.count(F.lit(1)).alias("cells"), F.count_if(b > w).alias("improved"), F.count_if(b < w).alias("worsened"), F.count_if((b == w) & (b > 0)).alias("equal"), F.count_if((b == 0) & (w == 0)).alias("none"))
    return row.withColumns({f"{c}_pct": F.col(c) * 100.0 / F.col("cells") for c in ("improved", "worsened", "equal", "none")})


def perfect(counts: DataFrame, runs: int = 10) -> DataFrame:
    """Classifiers that are significantly better in all runs, per variant."""
    return counts.groupBy("variant").agg(F.count_if(F.col("better") == runs).alias("perfect"))


def extremes(counts: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` variants with the largest and the ``k`` with the smallest net improvement."""
    net = counts.groupBy("variant").agg(F.sum(F.col("better") - F.col("worse")).alias("net"))
    top = net.orderBy(F.desc("net"), "variant").limit(k).withColumn("side", F.lit("top"))
    return top.unionByName(net.orderBy("net", "variant").limit(k).withColumn("side", F.lit("bottom")))


def delta_by_rate(stats: DataFrame, base: str) -> DataFrame:
    """``rate, classifier, variant, delta`` of means to the baseline at the same edge-removal rate."""
    ref = stats.filter(F.col("variant") == base).select("rate", "classifier", F.col("mean").alias("base"))
    return stats.filter(F.col("variant") != base).join(ref, ["rate", "classifier"]).select("rate", "classifier", "variant", (F.col("mean") - F.col("base")).alias("delta"))


def delta_topk(stats: DataFrame, base: str, k: int = 5) -> DataFrame:
    """Per rate and variant the mean over the top classifiers minus their baseline mean."""
    w = Window.partitionBy("rate").orderBy(F.desc("mean"), "classifier")  # a row a classifier
    top = stats.filter(F.col("variant") == base).withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k)
    top = top.select("rate", "classifier", F.col("mean").alias("base"))
    return stats.join(top, ["rate", "classifier"]).filter(F.col("variant") != base).groupBy("rate", "variant").agg((F.avg("mean") - F.avg("base")).alias("delta"))


def mean_delta(stats: DataFrame, base: str, without: tuple[str, ...] = ("NB",)) -> DataFrame:
    """Per variant its mean over classifiers minus the baseline's, some classifiers left out."""
    means = stats.filter(~F.col("classifier").isin(*without)).groupBy("variant").agg(F.avg("mean").alias("m"))
    ref = means.filter(F.col("variant") == base).select(F.col("m").alias("b"))
    return means.filter(F.col("variant") != base).crossJoin(F.broadcast(ref)).select("variant", (F.col("m") - F.col("b")).alias("delta")).orderBy(F.desc("delta"), "variant")


def best_per_variant(stats: DataFrame, base: str) -> DataFrame:
    """Best mean and its classifier per variant, and its difference to the best baseline."""
    best = stats.groupBy("variant").agg(F.max_by(F.struct("classifier", "mean"), F.struct("mean", F.col("classifier"))).alias("b")).select("variant", "b.classifier", F.col("b.mean").alias("best"))
    ref = best.filter(F.col("variant") == base).select(F.col("best").alias("_ref"))
    return best.crossJoin(F.broadcast(ref)).select("variant", "classifier", "best", (F.col("best") - F.col("_ref")).alias("delta"))


def importance_rank(df: DataFrame, keys: list[str] = (), value: str = "importance", feature: str = "feature") -> DataFrame:
    """Adds ``rank`` 1 … n by falling importance."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(value), feature)))


def allowed(df: DataFrame, categories: DataFrame, column: str = "variant") -> DataFrame:
    """Rows whose ``column`` has a category in ``categories(column, category)``, with it."""
    return df.join(categories, column)


def without_classifiers(df: DataFrame, *names: str) -> DataFrame:
    return df.filter(~F.col("classifier").isin(*names))


def groups_view(stats: DataFrame, groups: list[str], main: bool) -> DataFrame:
    """Rows of the main variants, or of those that stand for a group of signals."""
    is_group = F.col("variant").isin(*groups)
    return stats.filter(~is_group if main else is_group)


def matrix_runs(df: DataFrame, variants: list[str]) -> DataFrame:
    """A row a run and classifier, a column a variant; repeated values are averaged."""
    return df.groupBy("run", "classifier").pivot("variant", variants).agg(F.avg("value"))


def node_labels(nodes: DataFrame, labels: DataFrame, key: str = "id") -> DataFrame:
    """Nodes with their labels, null where there is none."""
    return nodes.join(labels, key, "left")
