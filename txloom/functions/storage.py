"""Stored intermediate tables and ranks that no single task computes alone."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Used only where a local session names no folder.
LOCAL_SCRATCH = "/tmp/txloom-scratch"


def scratch_path(spark: SparkSession, name: str) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("on a cluster spark.checkpoint.dir has to name a folder that driver and executors share")
        root = LOCAL_SCRATCH
    return f"{root.rstrip('/')}/txloom/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write and read back: cuts lineage at files that survive any executor."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Delete the files of a materialized table that nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles() if "/txloom/" in f}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def hash_key(seed: int | str, *keys: str) -> Column:
    """``md5(seed|key|…)`` in hex: the only source of randomness, the same in any engine and partitioning."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def hash_unit(key: Column) -> Column:
    """A uniform number in [0, 1) from the first 13 hex digits of a key."""
    return F.conv(F.substring(key, 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(16**13))


def hash_rank(df: DataFrame, groups: list[str], key: str, out: str, digits: int = 3, ties: list[str] = ()) -> DataFrame:
    """1-based rank by the hex column ``key`` inside ``groups``.

    Rows are cut by the first ``digits`` of the key; only the counts of the cuts are
    accumulated over a whole group, so a group that holds most rows still ranks in
    16^digits parts.
    """
    cut = df.withColumn("_cut", F.substring(key, 1, digits))
    sizes = cut.groupBy(*groups, "_cut").agg(F.count(F.lit(1)).alias("_size"))
    running = F.sum("_size").over(Window.partitionBy(*groups).orderBy("_cut")) if groups else F.sum("_size").over(Window.orderBy("_cut"))
    starts = sizes.withColumn("_start", running - F.col("_size")).drop("_size")
    inside = F.row_number().over(Window.partitionBy(*groups, "_cut").orderBy(key, *ties))
    return cut.withColumn("_in", inside).join(starts, [*groups, "_cut"]).withColumn(out, F.col("_start") + F.col("_in")).drop("_cut", "_in", "_start")


def dense_index(df: DataFrame, key: str, out: str, start: int = 0) -> DataFrame:
    """Consecutive numbers in the order of ``key``: a range-partitioned sort plus the sizes of its partitions."""
    spark = df.sparkSession
    placed = materialize(df.orderBy(key).withColumn("_at", F.monotonically_increasing_id()), "indexed")
    part, within = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("n")).orderBy("_part").collect()  # a row a partition
    starts, total = [], start
    for r in sizes:
        starts.append((r["_part"], total))
        total += r["n"]
    offsets = spark.createDataFrame(starts, "_part long, _first long")
    return placed.withColumn("_part", part).join(F.broadcast(offsets), "_part").withColumn(out, F.col("_first") + within).drop("_at", "_part", "_first")


def content_mark(df: DataFrame, *columns: str) -> tuple:
    """Number of rows and the sum of their hashes: equal for equal sets of rows."""
    return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*columns).cast("decimal(20,0)"))).first())


def join_hot(rows: DataFrame, groups: DataFrame, key: str, weight: str, total: int, salt: Column, share: int = 1000) -> DataFrame:
    """Inner join of many ``rows`` to one ``groups`` row a key; keys of a good part of the rows spread over tasks.

    ``weight`` is the number of rows of a key, of ``total`` in all.  Keys of more than a
    ``share``-th of the rows, at most ``share`` of them, are broadcast with their number
    of salts; only their groups are repeated.
    """
    salts = F.ceil(F.col(weight) * share / F.lit(max(total, 1))).cast("int")
    hot = groups.filter(F.col(weight) * share > total).select(key, salts.alias("_salts"))
    left = rows.join(F.broadcast(hot), key, "left").withColumn("_salt", F.pmod(salt, F.coalesce("_salts", F.lit(1)).cast("long")).cast("int")).drop("_salts")
    right = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.greatest(salts, F.lit(1)) - 1)))
    return left.join(right, [key, "_salt"]).drop("_salt", weight)
