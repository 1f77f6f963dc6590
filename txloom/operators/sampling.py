"""Splits and resampling, exact in count and independent of partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txloom.functions.storage import hash_key, hash_rank


def split_random(df: DataFrame, label: str, key: str = "tx_id", test: float = 0.2, validation: float = 0.2, seed: int = 1) -> DataFrame:
    """Adds ``split``: per class the first ``floor(test · n + .5)`` rows by hash are test, the next ones validation."""
    if not 0 < test + validation < 1:
        raise ValueError("test and validation shares must leave a part for training")
    ranked = hash_rank(df.withColumn("_key", hash_key(seed, key)), [label], "_key", "_rank")
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    n_test, n_val = F.floor(F.col("_n") * F.lit(test) + 0.5), F.floor(F.col("_n") * F.lit(validation) + 0.5)
    split = F.when(F.col("_rank") <= n_test, "test").when(F.col("_rank") <= n_test + n_val, "validation").otherwise("train")
    return ranked.join(F.broadcast(sizes), label).withColumn("split", split).drop("_key", "_rank", "_n")  # a row a class


def split_temporal(df: DataFrame, train: tuple[int, int], validation: tuple[int, int], test: tuple[int, int], step: str = "time_step") -> DataFrame:
    """Adds ``split`` by inclusive ranges of time steps; rows outside all of them go."""
    t = F.col(step)
    split = F.when(t.between(*train), "train").when(t.between(*validation), "validation").when(t.between(*test), "test")
    return df.withColumn("split", split).filter("split IS NOT NULL")


def oversample(df: DataFrame, label: str, key: str = "tx_id", ratio: float = 1.0, seed: int | str = 42) -> DataFrame:
    """Minority rows drawn with replacement until they are ``ratio`` times the majority; majority rows stay.

    Draw i takes the minority row number ``md5(seed|i) mod n``.  Adds ``draw`` (0 for
    majority rows).  Needs two classes; else the rows are returned as they are.
    """
    counts = {r[label]: r["count"] for r in df.groupBy(label).count().collect()}  # a row a class
    if len(counts) != 2:
        return df.withColumn("draw", F.lit(0).cast("long"))
    minority = min(counts, key=lambda c: (counts[c], c))
    n, wanted = counts[minority], round(max(v for c, v in counts.items() if c != minority) * ratio)
    if n >= wanted:
        return df.withColumn("draw", F.lit(0).cast("long"))
    small = hash_rank(df.filter(F.col(label) == minority).withColumn("_key", F.md5(F.col(key).cast("string"))), [], "_key", "_rank")
    h = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("draw").cast("string"))), 1, 15), 16, 10).cast("long")
    draws = df.sparkSession.range(1, wanted + 1).select(F.col("id").alias("draw")).withColumn("_rank", F.pmod(h, F.lit(n)) + 1)
    drawn = draws.join(small.drop("_key"), "_rank").drop("_rank")
    return df.filter(F.col(label) != minority).withColumn("draw", F.lit(0).cast("long")).unionByName(drawn)


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """``label, n, weight`` with weight N / (K · n)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("_all"), F.count(F.lit(1)).alias("_k"))
    return counts.crossJoin(F.broadcast(total)).select(label, "n", (F.col("_all") / (F.col("_k") * F.col("n"))).alias("weight"))


def ratio_weight(df: DataFrame, label: str) -> DataFrame:
    """Adds ``weight``: n1 / n0 for class 0 (1 where that class is empty), else 1."""
    n = df.agg(F.count_if(F.col(label) == 0).alias("_n0"), F.count_if(F.col(label) == 1).alias("_n1"))
    weight = F.when(F.col(label) == 0, F.coalesce(F.col("_n1") / F.nullif("_n0", F.lit(0)), F.lit(1.0))).otherwise(F.lit(1.0))
    return df.crossJoin(F.broadcast(n)).withColumn("weight", weight).drop("_n0", "_n1")


def label_counts(df: DataFrame, label: str = "class") -> DataFrame:
    """Rows per label, null included, and whether the rarest holds under a tenth of the rows."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("_all"), F.min("n").alias("_least"))
    return counts.crossJoin(F.broadcast(total)).select(label, "n", (F.col("_least") * 10 < F.col("_all")).alias("imbalanced"))


def oversample_epoch(df: DataFrame, label: str, epoch: int, key: str = "tx_id", ratio: float = 1.0, seed: int = 42) -> DataFrame:
    """:func:`oversample` with draws of their own in every epoch; a ratio above 1 counts as 1."""
    return oversample(df, label, key, min(ratio, 1.0), f"{seed}|{epoch}")
