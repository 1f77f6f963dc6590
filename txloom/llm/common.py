"""Helpers shared by the corpus operators: scratch tables, skew-safe joins, ranks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from txloom.functions.storage import drop, materialize, scratch_path  # noqa: F401  (operators store through this module)

#: Bytes of input that a Python worker holds at once.
BATCH_BYTES = "8m"
#: Rows that a Parquet reader decodes at once; packed records and long texts make rows of many kilobytes.
READ_ROWS = 256


def bound_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to BATCH_BYTES of input and Parquet's to READ_ROWS rows; a record limit that is set stays."""
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", READ_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def drop_scratch(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`materialize` that nothing reads any more."""
    drop(df)


def ensure_checkpoints(spark: SparkSession) -> None:
    """Names a folder for ``RDD.checkpoint`` where the session has none, as in tests; a cluster's own setting stays."""
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(scratch_path(spark, "checkpoints"))


def parts_for(spark: SparkSession, amount: int, each: int) -> int:
    """Shuffle partitions that leave at most about ``each`` of ``amount`` to one, at least the session's number."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-amount // each))


def document_rows(docs: DataFrame, *columns: str) -> DataFrame:
    """The named columns only, so that extra or clashing columns never reach an operator.

    A column name is taken literally; where the table has it twice the first counts.
    """
    names = docs.columns
    if len(set(names)) < len(names):
        docs = docs.toDF(*[n if n not in names[:i] else f"_again_{i}_{n}" for i, n in enumerate(names)])
    return docs.select(*[F.col(f"`{c}`") for c in columns])


def shadowed(docs: DataFrame) -> tuple[DataFrame, Callable[[str], str], Callable[[DataFrame], DataFrame]]:
    """``docs`` with neutral column names, what a name became, and the way back.

    An operator that keeps all columns can add its own to such a frame whatever the
    table's columns are called; of columns with the same name the first is meant.
    """
    names = docs.columns
    frame = docs.toDF(*[f"c{i}" for i in range(len(names))])
    return frame, lambda name: f"c{names.index(name)}", lambda df: df.select(*frame.columns).toDF(*names)


def identified(frame: DataFrame, id_col: str) -> DataFrame:
    """``frame`` with a column ``row`` that tells its rows apart: the id where it does so, else a stored number."""
    ids = frame.select(F.col(id_col).alias("id"))
    if ids.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 OR id IS NULL").head(1):
        return materialize(frame.withColumn("row", F.monotonically_increasing_id()), "numbered")
    return frame.withColumn("row", F.col(id_col))


def without(frame: DataFrame, dropped: DataFrame, on: Column | list[str], most: int = 200_000) -> DataFrame:
    """``frame`` without the rows that the stored table ``dropped`` matches; up to ``most`` of its rows are broadcast."""
    return frame.join(F.broadcast(dropped) if dropped.count() <= most else dropped, on, "left_anti")


def join_hot(rows: DataFrame, groups: DataFrame, keys: list[str], weight: str, total: int, salt: Column, how: str = "left", share: int = 1000) -> DataFrame:
    """Join many ``rows`` to at most one ``groups`` row a key; keys with a good part of the rows spread over tasks.

    ``weight`` of ``groups`` is the number of rows of the key, of ``total`` in all; it
    is dropped no more than other columns.  Keys with more than a ``share``-th of the
    rows, at most ``share`` of them, are broadcast with the number of their salts, one
    for every ``share``-th; only their groups are repeated.  ``salt`` is any
    deterministic integer column of ``rows``.
    """
    salts = F.ceil(F.col(weight) * share / F.lit(max(total, 1))).cast("int")
    hot = groups.filter(F.col(weight) * share > total).select(*keys, salts.alias("_salts"))
    left = rows.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.pmod(salt, F.coalesce("_salts", F.lit(1)).cast("long")).cast("int")).drop("_salts")
    right = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.greatest(salts, F.lit(1)) - 1)))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")
